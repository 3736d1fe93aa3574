"""Fixity of WARC replicas: Merkle trees over ordered records, compared from the root down.

A page becomes a WARC response record; records have a place (file and number) and an offset range in their file. The
leaves of a replica's tree are digests of single records, a node covers ``FANOUT`` children in order, the offsets they
span included. Two replicas are compared by their roots; only children of nodes that differ are read on the next level,
so the digests that are joined follow the damage, not the archive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoindex.functions.sizing import small_side
from repoindex.llm.batches import staged
from repoindex.llm.sharding import expand_copies, number_rows

FANOUT = 16
# A file is what is written, numbered and checked as one piece.
RECORDS_PER_FILE = 20_000
# The record format.
VERSION = "WARC/1.1"
LINE_END = "\r\n"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """The record of a page: header, empty line, body, two line ends. Null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    header = F.concat_ws(
        LINE_END, F.lit(VERSION), F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(header, F.lit(2 * LINE_END), body, F.lit(2 * LINE_END))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, content, length, digest): one record per page row."""
    rows = pages.select("page_id", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("content"))
    return rows.withColumns({"length": F.octet_length("content").cast("long"), "digest": F.sha2("content", 256)})


def manifest(rows: DataFrame, columns: list[str], per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Add file, record, start and end to the rows of an archive: ``per_file`` records to a file, one after the other.

    ``columns`` are what is kept of a row; ``length`` must be among them. Rows are numbered by hash buckets of what is
    kept, so the archive does not depend on their order, and repeated pages are records of their own, spread over
    files. Only kept columns are shuffled, no contents.
    """
    distinct = staged(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")), "warc-records")
    numbered = expand_copies(number_rows(distinct, columns, "_copies"), "_copies", "number").drop("_total")
    placed = numbered.withColumns({"file": F.floor(F.col("number") / per_file).cast("long"),
                                   "record": F.pmod("number", F.lit(per_file)).cast("long")}).drop("number")
    up_to = W.partitionBy("file").orderBy("record").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("end", F.sum("length").over(up_to)).withColumn("start", F.col("end") - F.col("length"))


def merkle_levels(leaves: DataFrame, most_records: int) -> list[DataFrame]:
    """The tree of every file, leaves first: (file, node, start, end, digest) per level, up to one root per file.

    Each level is staged in the shared folder, and is a sixteenth of the one below.
    """
    level = staged(leaves.select("file", F.col("record").alias("node"), "start", "end", "digest"), "merkle")
    levels, width = [level], most_records
    while width > 1:
        parent = level.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).groupBy("file", "parent").agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.array_sort(F.collect_list(F.struct("node", "start", "end", "digest"))).alias("children"))
        line = F.transform("children", lambda c: F.concat_ws(":", c["node"], c["start"], c["end"], c["digest"]))
        level = staged(parent.select("file", F.col("parent").alias("node"), "start", "end", F.sha2(
            F.array_join(line, "\n"), 256).alias("digest")), "merkle")
        levels.append(level)
        width = -(-width // FANOUT)
    return levels


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """The damaged records: (file, record, start, end, fault, digest, replica_digest, replica_start, replica_end).

    Both sides are (file, record, start, end, digest). ``start`` and ``end`` are those of the original, of an extra record
    those of the replica. ``fault`` is ``changed`` (another digest), ``moved`` (the same digest in another range),
    ``missing`` (the original has it, the replica has not) or ``extra``; what is not there is null. Equal replicas, empty ones too, give no rows.
    A place may be there once per side; of repeated places the smallest digest, start and end count.
    """
    def once(side: DataFrame) -> DataFrame:
        return side.groupBy("file", "record").agg(F.min(F.struct("digest", "start", "end")).alias("r")).select(
            "file", "record", "r.start", "r.end", "r.digest")

    left, right = staged(once(original), "merkle-original"), staged(once(replica), "merkle-replica")
    most = max((side.agg(F.max("record")).first()[0] or 0) + 1 for side in (left, right))
    trees = [merkle_levels(side, most) for side in (left, right)]
    differ = None
    for mine, other in zip(*(reversed(tree) for tree in trees), strict=True):
        if differ is not None:
            keys = small_side(differ.select("file", F.col("node").alias("parent")))
            mine, other = (side.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(
                keys, ["file", "parent"], "left_semi") for side in (mine, other))
        a, b = mine.alias("a"), other.alias("b")
        both = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.node") == F.col("b.node")), "full_outer")
        # Digests of nodes cover the ranges of their children, those of records do not.
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("digest", "start", "end")]
        differ = staged(both.where(~(same[0] & same[1] & same[2])).select(
            F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.node", "b.node").alias("node"),
            F.coalesce("a.start", "b.start").alias("start"), F.coalesce("a.end", "b.end").alias("end"),
            F.col("a.digest").alias("digest"), F.col("b.digest").alias("replica_digest"),
            F.col("b.start").alias("replica_start"),
            F.col("b.end").alias("replica_end")), "merkle-differ")
        if differ.isEmpty():
            break
    fault = F.when(F.col("digest").isNull(), "extra").when(F.col("replica_digest").isNull(), "missing").when(
        F.col("digest") != F.col("replica_digest"), "changed").otherwise("moved")
    return differ.select("file", F.col("node").alias("record"), "start", "end", fault.alias("fault"), "digest",
                         "replica_digest", "replica_start", "replica_end")
