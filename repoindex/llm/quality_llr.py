"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are counted, one over
trusted texts and one over all texts; a document's score is the mean log ratio of its n-grams. The zero of these
scores moves with the corpus, so the threshold is taken from the scores of the trusted texts themselves: it lies as far
below their ``QUANTILE`` as that below their median, and decides about every document. Copies of a text count once.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.functions.sizing import small_side
from repoindex.llm.batches import add_columns, blocks, bound_batches
from repoindex.llm.text_stats import IS_LEAD, IS_SYMBOL, NOT_SPACE, Block

BUCKETS = 1 << 14
# Added to every bucket's count.
SMOOTHING = 1.0
# Low quantile of the trusted texts' scores that sets the threshold, and the steps of scores it is looked for in, per nat.
QUANTILE = 0.01
STEPS = 10_000
MIN_WORDS = 50
PAIR_FACTOR = np.uint64(0x9E3779B97F4A7C15)

BASE = [T.StructField(name, T.LongType()) for name in
        ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def ngram_buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the text it belongs to."""
    spelled = block.words.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in spelled), np.uint64, len(spelled))[block.codes]
    text = block.text_of_word
    pairs = (hashes[:-1] * PAIR_FACTOR) ^ hashes[1:]
    pairs = pairs * PAIR_FACTOR
    within = text[:-1] == text[1:]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([hashes >> shift, (pairs >> shift)[within]]).astype(np.int64),
            np.concatenate([text, text[:-1][within]]))


def base_counts(block: Block) -> list[np.ndarray]:
    return [block.n_words, block.count_bytes(NOT_SPACE & IS_LEAD), block.count_bytes(IS_SYMBOL),
            block.duplicate_lines(), block.repeated_words()]


def count_buckets(docs: DataFrame, text: str, trusted: str) -> np.ndarray:
    """Counts of all buckets over all documents (row 0) and over trusted ones (row 1); tasks send sums."""

    def run(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for whole in batches:
            for batch in blocks(whole, 0):
                bucket, row = ngram_buckets(Block.of(batch.column(0)))
                flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                sums[1] += np.bincount(bucket[flags[row]], minlength=BUCKETS)
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(sums[0, seen]), pa.array(sums[1, seen])], ["bucket", "raw", "target"])

    sums = bound_batches(docs).select(text, trusted).mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, BUCKETS), np.int64)
    for row in sums.collect():
        counts[:, row["bucket"]] = row["raw"], row["target"]
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw); all zero without a trusted document."""
    if not counts[1].any():
        return np.zeros(BUCKETS)
    smooth = counts + SMOOTHING
    shares = smooth / smooth.sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def trusted_threshold(scored: DataFrame, text: str, quantile: float) -> float:
    """As far below the quantile of the scores as that is below the median, in whole steps.

    Texts that fail the base rules are not asked, equal ones count once. Without any, nothing falls below it.
    """
    step = F.floor(F.col("llr") * STEPS).cast("long")
    steps = scored.where("NOT base_failed").select(step.alias("step"), F.xxhash64(text).alias("h")).distinct().groupBy(
        "step").agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    if not steps:
        return float("-inf")
    totals = np.cumsum([r["n"] for r in steps])
    low, middle = (steps[int(np.searchsorted(totals, share * totals[-1], side="right"))]["step"] for share in (quantile, 0.5))
    return (2 * low - middle) / STEPS


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  quantile: float = QUANTILE) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept to every document.

    Trusted are the texts of all documents whose id has a label ``quality`` of 1. Kept are documents that pass the base
    rules and score no less than ``trusted_threshold`` of the trusted texts that pass them. The score of a text without words, null
    included, is 0; it fails the base rule of 50 words. Labels with a null id or quality, and repeated ones, add nothing;
    without any trusted document all scores are 0, so the base rules decide. Equal texts
    are counted once, but each document gets its row. Columns named like the new ones are replaced.
    """
    ids = small_side(labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted_id")).distinct())
    flagged = docs.select(text, doc_id).join(ids, F.col(doc_id) == F.col("_trusted_id"), "left").select(
        text, F.col("_trusted_id").isNotNull().alias("_trusted"))
    trusted = flagged.where("_trusted").select(text)
    # Copies fall together before the shuffle, whose only wide rows are the distinct texts.
    distinct = flagged.groupBy(text).agg(F.max("_trusted").alias("_trusted"))
    ratios = log_ratios(count_buckets(distinct, text, "_trusted"))

    def make(columns):
        block = Block.of(columns[0])
        bucket, row = ngram_buckets(block)
        size = len(columns[0])
        sums = np.bincount(row, weights=ratios[bucket], minlength=size)
        # Sums are rounded so that the order of addition never decides.
        mean = np.round(sums / np.maximum(np.bincount(row, minlength=size), 1), 9)
        return [pa.array(counts.astype(np.int64)) for counts in base_counts(block)] + [pa.array(mean)]

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def score(rows):
        return add_columns(rows, [text], [*BASE, T.StructField("llr", T.DoubleType())], make).withColumn("base_failed", failed)

    threshold = trusted_threshold(score(trusted), text, quantile)
    return score(docs).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
