"""Text to tokens and lexemes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.functions.stemmer import lexeme

TOKEN_PATTERN = r"([\p{L}\p{N}]+)"
# Tokens of an Arrow batch that are worked on at a time, whatever the number of its rows.
TOKENS_AT_A_TIME = 1 << 18
# Rows of an Arrow batch of postings.
POSTINGS_AT_A_TIME = 1 << 16


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 1), F.lower)


def rebuild_list(like: pa.Array, flat: pa.Array) -> pa.Array:
    """A list array shaped as ``like`` (NULL lists become empty) over other flat values."""
    lengths = pc.fill_null(pc.list_value_length(like), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, flat)


def english_of(flat: pa.Array) -> pa.Array:
    """Stems of many words, NULL for stop words; each distinct word of the batch is stemmed once."""
    coded = flat.dictionary_encode()
    stems = pa.array([lexeme(w) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def english_lexemes(words: pa.Array) -> pa.Array:
    """Stems of token lists; stop words become NULL elements, so that positions still count them."""
    return rebuild_list(words, english_of(words.flatten()))


POSITIONS_TYPE = T.ArrayType(T.StructType([
    T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def positions_column(words: Column, config: str) -> Column:
    """ARRAY<STRUCT<lexeme, positions>> of a token list: its distinct lexemes with their ascending positions.

    The grouping is within one row, so it needs no shuffle; it runs as one sort of integers per Arrow batch.
    """

    @F.arrow_udf(POSITIONS_TYPE)
    def grouped(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        coded = (english_of(flat) if config == "english" else flat).dictionary_encode()
        parts = [_grouped(lengths[rows], coded.indices[tokens], coded.dictionary) for rows, tokens in token_parts(lengths)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct(
            [("lexeme", pa.string()), ("positions", pa.list_(pa.int32()))])))

    return grouped(words)


def token_parts(lengths: np.ndarray, at_a_time: int | None = None) -> Iterator[tuple[slice, slice]]:
    """Slices of the rows of a batch that have some number of tokens, and of their tokens; one row may have more."""
    ends = np.cumsum(lengths)
    turn = (ends - lengths) // (at_a_time or TOKENS_AT_A_TIME)
    for first in np.unique(turn, return_index=True)[1]:
        last = np.searchsorted(turn, turn[first], side="right")
        yield slice(first, last), slice(ends[first] - lengths[first], ends[last - 1])


def _grouped(lengths: np.ndarray, indices: pa.Array, dictionary: pa.Array) -> pa.Array:
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(row)) - np.repeat(starts, lengths) + 1
    kept = indices.is_valid().to_numpy(zero_copy_only=False)
    code = indices.fill_null(0).to_numpy(zero_copy_only=False)[kept].astype(np.int64)
    row, position = row[kept], position[kept]
    order = np.argsort(row * max(len(dictionary), 1) + code, kind="stable")
    row, code, position = row[order], code[order], position[order]

    opens = np.ones(len(row), dtype=bool)
    opens[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    group = np.cumsum(opens) - 1
    group_start = np.flatnonzero(opens)
    per_group = np.bincount(group, minlength=len(group_start))
    positions = pa.ListArray.from_arrays(_offsets(per_group), pa.array(position.astype(np.int32)))
    lexemes = dictionary.take(pa.array(code[group_start]))
    entries = pa.StructArray.from_arrays([lexemes, positions], names=["lexeme", "positions"])
    per_row = np.bincount(row[group_start], minlength=len(lengths))
    return pa.ListArray.from_arrays(_offsets(per_row), entries)


def posting_rows(lists: pa.Array, place: np.ndarray, config: str, at_a_time: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(row, lexeme, positions) of each distinct lexeme of each token list, in batches, by ``place`` of the list, lexeme and row.

    ``at_a_time`` tokens are sorted together, by one number each.
    """
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    for rows, held in token_parts(lengths, at_a_time):
        part = flat[held]
        coded = (english_of(part) if config == "english" else part).dictionary_encode()
        words, size = coded.dictionary, rows.stop - rows.start
        by_word = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[by_word] = np.arange(len(words))
        starts = np.cumsum(lengths[rows]) - lengths[rows]
        kept = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(size), lengths[rows])[kept]
        code = rank[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)[kept]] if len(kept) else kept
        key = (place[rows][row] * max(len(words), 1) + code) * size + row
        order = np.argsort(key, kind="stable")
        key, position = key[order], (kept - starts[row] + 1)[order].astype(np.int32)
        opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        sizes = np.diff(np.append(opens, len(key)))
        for first in range(0, len(opens), POSTINGS_AT_A_TIME):
            some = slice(first, first + POSTINGS_AT_A_TIME)
            at = key[opens[some]]
            end = opens[first + POSTINGS_AT_A_TIME] if first + POSTINGS_AT_A_TIME < len(opens) else len(key)
            yield (pa.array(at % size + rows.start), words.take(pa.array(by_word[at // size % len(words)])),
                   pa.ListArray.from_arrays(_offsets(sizes[some]), pa.array(position[opens[first]:end])))


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def lexeme_array(text: Column, config: str) -> Column:
    """Lexemes of a text in order, NULL where a stop word stood."""
    if config == "simple":
        return tokens(text)
    if config == "english":
        return english_lexemes(tokens(text))
    raise ValueError(f"unknown text search configuration: {config}")
