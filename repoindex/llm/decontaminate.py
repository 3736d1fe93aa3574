"""Benchmark decontamination: a prefix-filtered join of benchmark windows with the texts that contain them.

A window is ten consecutive words of an item. As a set of three-word shingles it is contained in a text only if the
text has all of its shingles, so one of them suffices to find candidates: the one that is rarest in the corpus. Texts
are scanned for these prefix shingles only; a hit at an offset fixes where the window would have to begin, which must
be inside the text, and all its words are then compared.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.llm.batches import (
    add_columns, blocks, bound_batches, byte_table, coded_words, flat_text, ragged_take, staged, without, word_bounds,
)

WINDOW = 10
SHINGLE = 3
# Words of benchmark text that are matched in one pass over the corpus: what goes to every task is bounded by it.
# A larger benchmark takes several passes. Three word numbers below 2**21 fit one 64-bit shingle.
PASS_WORDS = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IS_WORD = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))

RESULT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hit_ranges", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType())),
]


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words of all texts, and at which word each text begins."""
    flat, bounds = flat_text(texts, end="\n")
    flat = LOWER[flat]
    starts, ends = word_bounds(flat, IS_WORD)
    return coded_words(flat, starts, ends, IS_WORD), np.searchsorted(starts, bounds)


class WindowIndex:
    """The windows of some items and the shingles they have, by numbers of their words."""

    def __init__(self, item_ids: list[str], texts: list[str]):
        coded, bounds = words_of(pa.array(texts, pa.large_string()))
        self.vocabulary = coded.dictionary
        self.items = item_ids
        words = coded.indices.to_numpy().astype(np.int64)
        # The windows of all items, short ones filled up with -1.
        lengths = np.diff(bounds)
        width = np.minimum(lengths, WINDOW)
        per_item = np.where(lengths > 0, lengths - width + 1, 0)
        item = np.repeat(np.arange(len(lengths)), per_item)
        begin = bounds[:-1][item] + np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        steps = np.arange(WINDOW)
        inside = steps < width[item][:, None]
        padded = np.append(words, np.full(WINDOW, -1))
        windows = np.where(inside, padded[begin[:, None] + steps], -1) if len(begin) else np.zeros((0, WINDOW), np.int64)
        self.windows, same = np.unique(windows, axis=0, return_inverse=True)
        self.lengths = (self.windows >= 0).sum(axis=1)
        # Which items have a window, as a ragged array.
        pairs = np.unique(np.stack([same.reshape(-1), item], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.window_items = pairs[:, 1]
        self.item_bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.sizes = sorted(set(np.minimum(self.lengths, SHINGLE).tolist()))
        self.shingles = {s: np.unique(self._window_shingles(s)[2]) for s in self.sizes}
        self.prefixes: dict = {}

    def codes(self, words: np.ndarray, size: int) -> np.ndarray:
        """One number per position for the ``size`` words from there on, -1 where one is foreign to the benchmark."""
        base = max(len(self.vocabulary), 1)
        if len(words) < size:
            return np.full(len(words), -1, np.int64)
        code, known = np.zeros(len(words) - size + 1, np.int64), np.ones(len(words) - size + 1, bool)
        for step in range(size):
            part = words[step:len(words) - size + 1 + step]
            code = code * base + part
            known &= part >= 0
        return np.where(known, code, -1)

    def _window_shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, offset, code) of every shingle of the windows that are matched by shingles of this size."""
        chosen = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == size)
        found = [(chosen[ok], np.full(int(ok.sum()), step), code[ok])
                 for step in range(WINDOW - size + 1)
                 for code in [self._row_codes(chosen, step, size)] for ok in [code >= 0]]
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def _row_codes(self, rows: np.ndarray, step: int, size: int) -> np.ndarray:
        base = max(len(self.vocabulary), 1)
        part = self.windows[rows, step:step + size]
        code = np.zeros(len(rows), np.int64)
        for column in range(size):
            code = code * base + part[:, column]
        return np.where((part >= 0).all(axis=1), code, -1)

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, -1 for those no item has, and at which word each text begins."""
        coded, bounds = words_of(texts)
        numbers = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy().astype(np.int64)
        return (numbers[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)), bounds

    def count(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """How often each shingle stands in the texts."""
        words, bounds = self.numbered(texts)
        return {size: np.bincount(self._find(self.shingles[size], words, bounds, size)[1],
                                  minlength=len(self.shingles[size])) for size in self.sizes}

    def _find(self, codes: np.ndarray, words: np.ndarray, bounds: np.ndarray, size: int):
        """Positions at which one of the sorted codes stands, within a text, and which."""
        here = self.codes(words, size)
        # A shingle must not reach into the next text.
        for step in range(1, size):
            over = bounds[1:-1] - step
            here[over[(over >= 0) & (over < len(here))]] = -1
        at = np.flatnonzero(here >= 0)
        place = np.minimum(np.searchsorted(codes, here[at]), max(len(codes) - 1, 0))
        ok = codes[place] == here[at] if len(codes) else np.zeros(len(at), bool)
        return at[ok], place[ok]

    def choose_prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """Take the rarest shingle of each window; of equally rare ones the smaller number."""
        for size in self.sizes:
            window, offset, code = self._window_shingles(size)
            rarity = counts[size][np.searchsorted(self.shingles[size], code)]
            order = np.lexsort((offset, code, rarity, window))
            first = order[np.append(True, np.diff(window[order]) != 0)]
            by_code = first[np.argsort(code[first], kind="stable")]
            codes, begins = np.unique(code[by_code], return_index=True)
            self.prefixes[size] = (codes, np.append(begins, len(by_code)), window[by_code], offset[by_code])

    def match(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At which word each text begins, and (window, first word) of every occurrence."""
        words, bounds = self.numbered(texts)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size in self.sizes:
            codes, begins, windows, offsets = self.prefixes[size]
            at, place = self._find(codes, words, bounds, size)
            rows, row_bounds = ragged_take(np.arange(len(windows)), begins, place)
            window = windows[rows]
            start = np.repeat(at, np.diff(row_bounds)) - offsets[rows]
            text = np.searchsorted(bounds, np.repeat(at, np.diff(row_bounds)), side="right") - 1
            ok = (start >= bounds[text]) & (start + self.lengths[window] <= bounds[text + 1])
            window, start = window[ok], start[ok]
            for step in range(WINDOW):
                want = self.windows[window, step]
                ok = (want < 0) | (words[np.minimum(start + step, len(words) - 1)] == want)
                window, start = window[ok], start[ok]
            found.append((window, start))
        return bounds, *(np.concatenate(part) for part in zip(*found, strict=True))

    def results(self, columns: list[pa.Array]) -> list[pa.Array]:
        """n_words, n_hit, hit_ranges, item_ids of each text; earlier ranges and ids (columns 1 and 2) are joined in."""
        texts = columns[0]
        bounds, window, start = self.match(texts)
        size = int(bounds[-1])
        change = np.zeros(size + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, start + self.lengths[window], -1)
        text = np.searchsorted(bounds, start, side="right") - 1
        items: list[set] = [set() for _ in range(len(texts))]
        pairs = np.unique(np.stack([text, window], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
        found, found_bounds = ragged_take(self.window_items, self.item_bounds, pairs[:, 1])
        for row, item in zip(np.repeat(pairs[:, 0], np.diff(found_bounds)).tolist(), found.tolist(), strict=True):
            items[row].add(self.items[item])
        if len(columns) > 1:
            for row, (ranges, ids) in enumerate(zip(columns[1].to_pylist(), columns[2].to_pylist(), strict=True)):
                items[row].update(ids)
                base = int(bounds[row])
                for begin, end in zip(ranges[0::2], ranges[1::2], strict=True):
                    change[base + begin] += 1
                    change[base + end] -= 1
        hit = np.cumsum(change)[:size] > 0
        # Ranges end where a text ends, so runs are cut at the texts' bounds.
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        before = np.append(False, hit[:-1])
        after = np.append(hit[1:], False)
        begins = np.flatnonzero(hit & (~before | edge[:size]))
        ends = np.flatnonzero(hit & (~after | edge[1:])) + 1
        range_bounds = np.searchsorted(begins, bounds)
        base = np.repeat(bounds[:-1], np.diff(range_bounds))
        ranges = np.stack([begins - base, ends - base], axis=1).reshape(-1).astype(np.int32)
        total = np.append(0, np.cumsum(hit))
        return [
            pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]]),
            pa.ListArray.from_arrays(pa.array((2 * range_bounds).astype(np.int32)), pa.array(ranges)),
            pa.array([sorted(found) for found in items], pa.list_(pa.string())),
        ]


def _indexes(benchmark: DataFrame, item_id: str, text: str, pass_words: int) -> Iterator[WindowIndex]:
    """Indexes of at most ``pass_words`` words (or one item), read partition by partition."""
    ids, texts, words = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col(text), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        size = len(words_of(pa.array([row["t"]], pa.large_string()))[0])
        if texts and words + size > pass_words:
            yield WindowIndex(ids, texts)
            ids, texts, words = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        words += size
    yield WindowIndex(ids, texts)


def count_shingles(docs: DataFrame, index: WindowIndex, text: str) -> dict[int, np.ndarray]:
    """Occurrences of the benchmark's shingles in all documents; tasks send sums, one per shingle they have seen."""

    def run(batches):
        sums = {size: np.zeros(len(codes), np.int64) for size, codes in index.shingles.items()}
        for whole in batches:
            for batch in blocks(whole, 0):
                for size, counts in index.count(batch.column(0)).items():
                    sums[size] += counts
        for size, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), size)), pa.array(seen), pa.array(counts[seen])], ["size", "place", "n"])

    sums = bound_batches(docs).select(text).mapInArrow(run, "size long, place long, n long").groupBy("size", "place").agg(
        F.sum("n").alias("n"))
    counts = {size: np.zeros(len(codes), np.int64) for size, codes in index.shingles.items()}
    for row in sums.toLocalIterator():
        counts[row["size"]][row["place"]] = row["n"]
    return counts


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """Add n_words, n_hit, hit_ranges (begin and end of each run of hit words, in turn) and item_ids (sorted).

    A word is hit if it is inside an occurrence of a window of any item. A null or empty text has no words and no
    hits; an item without words has no window, one of fewer than ten words is one window. Items with a null id count
    under the empty id, repeated ids once. An empty benchmark hits nothing. Rows are handled one by one, so repeated
    rows give repeated results. Columns named like the new ones are replaced.
    """
    inputs = [text]
    for turn, index in enumerate(_indexes(benchmark, item_id, item_text, pass_words)):
        if turn:
            docs = staged(docs, "decontaminate")
            inputs = [text, "_hit_ranges", "_item_ids"]
            docs = without(docs, ["_hit_ranges", "_item_ids"]).withColumnsRenamed({"hit_ranges": "_hit_ranges", "item_ids": "_item_ids"})
        index.choose_prefixes(count_shingles(docs, index, text))
        docs = add_columns(docs, inputs, RESULT, index.results)
    return docs.drop("_hit_ranges", "_item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with the columns they came with, whatever their names.

    Null and empty texts have no words and stay, repeated rows stay or go together, an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"), F.col("text").alias("text"))
    return find_contamination(rows, benchmark).where(F.col("n_hit") == 0).select("_kept.*")
