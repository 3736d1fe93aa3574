"""Lexeme rows and the postings table."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoindex.functions.tokens import lexeme_array, positions_column, posting_rows, tokens

# Tokens that are sorted at a time: those of the text that a task of the store makes postings of.
SORTED_TOKENS = 1 << 21


def lexemes(df: DataFrame, config: str = "english", text_col: str = "text") -> DataFrame:
    """One row per lexeme occurrence, with its 1-based position; stop words are counted, then left out.

    No shuffle: the stemmer runs on the token array of each row.
    """
    keep = [c for c in df.columns if c != text_col]
    return (
        df.select(*keep, F.posexplode(lexeme_array(F.col(text_col), config)).alias("pos", "lexeme"))
        .where("lexeme IS NOT NULL")
        .withColumn("pos", F.col("pos") + 1)
    )


def build_postings(chunks: DataFrame, config: str = "english") -> DataFrame:
    """(namespace, kind, id, lexeme, positions), one row per lexeme and chunk, and ``bucket`` if chunks have it.

    All positions are kept. A map-side operation: all tokens of a chunk are in one row, so they are grouped there. Whoever writes the
    table decides its layout.
    """
    words = positions_column(tokens(F.col("text")), config)
    keys = ["namespace", "kind", "id"] + (["bucket"] if "bucket" in chunks.columns else [])
    return chunks.select(*keys, F.explode(words).alias("entry")).select(*keys, "entry.lexeme", "entry.positions")


def sorted_postings(chunks: DataFrame, config: str, keys: list[str]) -> DataFrame:
    """(*keys, id, lexeme, positions) of ``build_postings``, sorted by keys and lexeme for ``SORTED_TOKENS`` of a task at a time.

    They are sorted where they are made, as numbers; a sort of the rows would compare keys, words and ids again and again.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.zeros(batch.num_rows, np.int64)
            for key in keys:
                code = batch[key].dictionary_encode().indices.fill_null(batch.num_rows).to_numpy(zero_copy_only=False)
                place = np.unique(place * (batch.num_rows + 1) + code, return_inverse=True)[1]
            for row, lexemes, positions in posting_rows(batch["words"], place, config, SORTED_TOKENS):
                yield pa.RecordBatch.from_arrays([*(batch[c].take(row) for c in [*keys, "id"]), lexemes, positions],
                                                 names=[*keys, "id", "lexeme", "positions"])

    fields = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in [*keys, "id"])
    words = chunks.select(*keys, "id", tokens(F.col("text")).alias("words"))
    return words.mapInArrow(rows, f"{fields}, lexeme string, positions array<int>")
