"""Reproducible shuffle and sharding: a keyed Feistel permutation over global row numbers, in column expressions only.

Row numbers depend on the rows, not on how they are laid out in files or partitions: rows are counted per hash bucket
of their content, and a row's number is its bucket's first number plus its rank in the bucket. The permutation is a
Feistel network over pairs (left, right) of a grid that holds all numbers; a result outside is permuted again until
it is inside. Shard and slot follow from the permuted number alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoindex.llm.batches import staged, without

ROUNDS = 4
# Buckets in which rows are numbered; their counts are the only table that is broadcast.
BUCKETS = 4096
# Copies of one row that are numbered in one step; more are dealt out as blocks.
COPIES_PER_BLOCK = 10_000


def _round_value(half: Column, key: int, turn: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), F.lit(turn), half), modulus)


def _one_pass(state: Column, key: int, rows: Column, cols: Column) -> Column:
    """The permutation of the grid, for use inside a lambda: the state is one number."""
    turns = F.array(*[F.lit(t) for t in range(ROUNDS)])
    halves = F.struct(F.floor(state / cols).cast("long").alias("l"), F.pmod(state, cols).alias("r"))

    def turn(s, t):
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(key), F.lit(2) * t, s["r"]), rows), rows)
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(key), F.lit(2) * t + 1, left), cols), cols)
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(turns, halves, turn, lambda s: s["l"] * cols + s["r"])


def permute(df: DataFrame, number: str, total: str, key: int, into: str) -> DataFrame:
    """Add ``into``: the place of row ``number`` among ``total`` rows, a bijection of 0 .. total - 1 for each key.

    The grid has fewer than sqrt(total) + 1 numbers too many, so a walk is needed by about that many rows and is at
    most that long: the work is linear in the rows, and no walk is cut short.
    """
    rows = F.ceil(F.sqrt(F.col(total).cast("double"))).cast("long")
    cols = F.ceil(F.col(total) / F.col("_rows")).cast("long")
    df = df.withColumn("_rows", F.greatest(rows, F.lit(1))).withColumn("_cols", F.greatest(cols, F.lit(1)))
    df = df.withColumns({"_l": F.floor(F.col(number) / F.col("_cols")).cast("long"),
                         "_r": F.pmod(F.col(number), F.col("_cols"))})
    for t in range(ROUNDS):
        df = df.withColumn("_l", F.pmod(F.col("_l") + _round_value(F.col("_r"), key, 2 * t, F.col("_rows")),
                                        F.col("_rows")))
        df = df.withColumn("_r", F.pmod(F.col("_r") + _round_value(F.col("_l"), key, 2 * t + 1, F.col("_cols")),
                                        F.col("_cols")))
    df = df.withColumn(into, F.col("_l") * F.col("_cols") + F.col("_r"))
    spare = F.col("_rows") * F.col("_cols") - F.col(total)
    walk = F.aggregate(
        F.sequence(F.lit(0).cast("long"), spare), F.col(into),
        lambda state, _: F.when(state < F.col(total), state).otherwise(
            _one_pass(state, key, F.col("_rows"), F.col("_cols"))))
    return df.withColumn(into, F.when(F.col(into) < F.col(total), F.col(into)).otherwise(walk)).drop(
        "_rows", "_cols", "_l", "_r")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """First number of each bucket and the total, from at most ``BUCKETS`` rows (_bucket, _count)."""
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_first"),
        F.sum("_count").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        .alias("_total"))


def number_rows(df: DataFrame, columns: list[str], copies: str) -> DataFrame:
    """Add ``_first_number`` and ``_total`` to distinct rows that each stand for ``copies`` rows: a shuffle by bucket."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)))
    starts = bucket_starts(df.groupBy("_bucket").agg(F.sum(copies).alias("_count")))
    before = W.partitionBy("_bucket").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    ranked = df.withColumn("_rank", F.coalesce(F.sum(copies).over(before), F.lit(0)))
    return ranked.join(F.broadcast(starts), "_bucket").withColumn(
        "_first_number", F.col("_first") + F.col("_rank")).drop("_bucket", "_first", "_rank")


def expand_copies(df: DataFrame, copies: str, number: str) -> DataFrame:
    """One row per copy with its own number. Rows of very many copies are first dealt out in blocks."""
    few = df.where(F.col(copies) <= COPIES_PER_BLOCK).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    many = df.where(F.col(copies) > COPIES_PER_BLOCK).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES_PER_BLOCK).cast("long"))))
    many = many.repartition(F.col("_from"), F.col("_first_number")).withColumn(
        "_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES_PER_BLOCK, F.col(copies)) - 1)))
    return few.unionByName(many.drop("_from")).withColumn(number, F.col("_first_number") + F.col("_copy")).drop(
        "_copy", "_first_number", copies)


def shard_rows(df: DataFrame, shards: int, key: int, columns: list[str] | None = None) -> DataFrame:
    """Add ``row_number``, ``position``, ``shard`` and ``slot``: position is the permuted row number, and shards take
    positions in turn, so their sizes differ by one at most and slots run from 0 without a gap.

    ``columns`` (default: all) say what a row is; they are what comes back. Rows that agree in all of them, nulls
    included, are copies of one row and get a place each. The same rows give the same result in any order and
    partitioning. The distinct rows are staged once, in the shared folder. An empty table gives an empty table. Existing columns of the new names are replaced.
    """
    df = without(df, ["row_number", "position", "shard", "slot"])
    columns = columns or df.columns
    distinct = staged(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")), "shard-rows")
    numbered = expand_copies(number_rows(distinct, columns, "_copies"), "_copies", "row_number")
    placed = permute(numbered, "row_number", "_total", key, "position").drop("_total")
    return placed.withColumns({"shard": F.pmod("position", F.lit(shards)).cast("int"),
                               "slot": F.floor(F.col("position") / shards).cast("long")})


def document_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bytes of the text plus one, CRC-32 of the text: what stands for a document. Null texts count as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
