"""Training-order materialisation: token sequences in a keyed global order, as fixed-stride binary shards.

Texts become sequences of a fixed number of token ids; every sequence gets a global slot by a Feistel permutation of its
number, which follows from the rows alone, not from their layout. Shard ``slot // per_shard`` holds it at byte ``slot % per_shard * stride``, so a reader that knows the slot it
stopped at goes on from there by position, and a whole epoch is read front to back. Spark's own writer makes the files:
a record is the little-endian ids of a sequence and one line feed, which the writer puts between records.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoindex.llm.batches import blocks, bound_batches, staged
from repoindex.llm.bpe import ByteBpe
from repoindex.llm.sharding import permute
from repoindex.session import scratch_path

SEQUENCE = 256
PER_SHARD = 1 << 16
# Shards are written in so many turns: the shuffle of one turn is on disk at a time.
TURNS = 3
# Buckets of documents by content in which sequences are numbered; their counts are the only table that is broadcast.
BUCKETS = 1 << 16
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def token_type(model: ByteBpe) -> np.dtype:
    return np.dtype("<u2" if model.size <= 1 << 16 else "<u4")


def stride(model: ByteBpe, length: int = SEQUENCE) -> int:
    return length * token_type(model).itemsize + 1


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The files of a shuffle go as soon as the query that made them has ended."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def by_content(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, doc_id, text) in an order that follows from the rows: whole buckets one after the other in each task,
    documents by id and text within.

    A bucket is a hash of id and text, so copies of a text under ids of their own are spread over all of them.
    """
    rows = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(BUCKETS)).cast("int").alias("bucket"),
                       F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text")


def sequences(docs: DataFrame, model: ByteBpe, end: int, length: int = SEQUENCE) -> DataFrame:
    """(bucket, doc_id, sequence, n_tokens, payload) of rows (bucket, doc_id, text): a text's ids and the end token, cut into
    sequences of ``length`` ids.

    The last sequence of a text is filled up with the end token; n_tokens counts what is not filling. Whole texts are
    encoded; a null or empty text is one sequence of nothing but the end.
    """
    kind = token_type(model)

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, 2):
                ids, bounds = model.encode(batch.column(2))
                sizes = np.diff(bounds) + 1
                counts = -(-sizes // length)
                first = np.cumsum(counts) - counts
                rows = np.full(int(counts.sum()) * length, end, kind)
                rows[np.arange(len(ids)) + np.repeat(first * length - bounds[:-1], np.diff(bounds))] = ids
                owner = np.repeat(np.arange(len(sizes)), counts)
                place = np.arange(len(owner)) - first[owner]
                width = length * kind.itemsize
                payload = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(width), len(owner), [None, pa.py_buffer(rows.view(np.uint8))]).cast(pa.binary())
                whose = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(whose), batch.column(1).take(whose), pa.array(place),
                     pa.array(np.minimum(sizes[owner] - place * length, length)), payload],
                    ["bucket", "doc_id", "sequence", "n_tokens", "payload"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"bucket int, doc_id {id_type}, sequence long, n_tokens long, payload binary")


def order_sequences(staged_sequences: DataFrame, key: int, per_shard: int = PER_SHARD) -> DataFrame:
    """Add slot and shard to staged sequences. Their number is that of their bucket's first sequence and their place in the
    bucket.

    ``place`` says where a sequence was written: those of a bucket stand one after the other in one task. What is joined
    is how far numbers and places of each bucket are apart, ``BUCKETS`` rows at most, staged once for all turns.
    """
    counts = staged_sequences.groupBy(F.col("bucket").alias("_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shifts = staged(counts.select(
        "_bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("n").over(everything).alias("_total")), "shard-buckets")
    numbered = staged_sequences.join(F.broadcast(shifts), F.col("bucket") == F.col("_bucket")).withColumn(
        "_number", F.col("place") + F.col("_shift"))
    return permute(numbered, "_number", "_total", key, "slot").withColumn(
        "shard", F.floor(F.col("slot") / per_shard).cast("int")).drop(
            "bucket", "_bucket", "_shift", "_total", "_number", "place")


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a writer left its success mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def turn_size(shards: int, turns: int) -> int:
    return max(1, -(-shards // turns))


def write_shards(ordered: DataFrame, path: str, shards: int, turns: int = TURNS) -> None:
    """Write ``path/turn=../shard=../part-*``: one file per shard, records by slot, a range of shards in each turn.

    A turn that was finished earlier (its directory has the writer's success mark) is not written again; one that was
    broken off is.
    """
    spark = ordered.sparkSession
    size = turn_size(shards, turns)
    with _shuffles_removed(spark):
        for first in range(0, shards, size):
            if _finished(spark, f"{path}/turn={first}"):
                continue
            part = ordered.where(F.col("shard").between(first, first + size - 1)).select("shard", "slot", "payload")
            part.repartitionById(size, F.col("shard") - first).sortWithinPartitions("shard", "slot").select(
                "shard", F.col("payload").cast("string").alias("value")).write.mode("overwrite").partitionBy(
                    "shard").text(f"{path}/turn={first}")


def place_of(slot: int, model: ByteBpe, per_shard: int = PER_SHARD, length: int = SEQUENCE) -> tuple[int, int]:
    """Shard and byte offset of a slot."""
    return slot // per_shard, slot % per_shard * stride(model, length)


def read_records(data: bytes, model: ByteBpe, length: int = SEQUENCE) -> np.ndarray:
    """The ids of whole records, one row each."""
    kind = token_type(model)
    return np.frombuffer(data, np.dtype([("ids", kind, length), ("end", "u1")]))["ids"]


def materialise(docs: DataFrame, model: ByteBpe, key: int, end: int, path: str | None = None,
                length: int = SEQUENCE, per_shard: int = PER_SHARD, turns: int = TURNS) -> DataFrame:
    """Write all shards below ``path`` (default: a new folder in the shared one) and return their manifest.

    One row per sequence: slot (0 .. total - 1, each once), shard, the folder of its one file below ``path``, offset in
    bytes, doc_id, sequence, n_tokens and the CRC-32 of the ids. The same rows and key give the same slots, however the rows
    are laid out in files and partitions; sequences are encoded once and staged in the shared folder. A call on the path of
    one that was broken off goes on with what that staged and finished; one with other parameters is refused, and the
    documents are taken to be the same. Repeated documents have sequences of their own (rows alike in id and text are one
    bucket), null ids stay null, an empty table writes nothing and returns no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    job = f"key={key} end={end} length={length} per_shard={per_shard} turns={turns} vocabulary={model.size}"
    if not _finished(spark, f"{path}/job"):
        spark.createDataFrame([(job,)], "job string").coalesce(1).write.mode("overwrite").text(f"{path}/job")
    elif [r[0] for r in spark.read.text(f"{path}/job").collect()] != [job]:
        raise ValueError(f"{path} holds the shards of another job")
    made = sequences(by_content(bound_batches(docs)), model, end, length).withColumn(
        "place", F.monotonically_increasing_id())
    if not _finished(spark, f"{path}/staged"):
        with _shuffles_removed(spark):
            made.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/staged")
    made = spark.read.schema(made.schema).parquet(f"{path}/staged")
    total = made.count()
    ordered = order_sequences(made, key, per_shard)
    shards = -(-total // per_shard)
    write_shards(ordered, f"{path}/shards", shards, turns)
    turn = F.col("shard") - F.pmod("shard", F.lit(turn_size(shards, turns)))
    folder = F.format_string("shards/turn=%d/shard=%d", turn, F.col("shard"))
    offset = F.pmod("slot", F.lit(per_shard)) * stride(model, length)
    return ordered.select("slot", "shard", folder.alias("folder"), offset.cast("long").alias("offset"), "doc_id", "sequence", "n_tokens",
                          F.crc32("payload").alias("ids_crc32"))
