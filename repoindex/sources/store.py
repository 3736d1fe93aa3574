"""The index on disk: chunks, postings and registry as Parquet, in versions.

    chunks/run=R/namespace=…/kind=…/bucket=…      rows written by one commit
    postings/run=R/namespace=…/kind=…/bucket=…    the same buckets, by lexeme
    gone/run=R                                    keys of rows of earlier runs that the commit replaced or dropped
    registry/run=R                                whole registry as of that commit
    live/run=R                                    which runs hold rows of each (namespace, kind, bucket) as of that commit,
                                                  and which hold keys of rows that are gone
    versions/N                                    a file with the R of version N; made last, and only if it is absent
    cells/at=N, lexemes/at=N                      indexes of the vectors and postings of version N, if they were made

A commit writes its new rows and the keys of those that go, in folders of its own name R, and is seen when its file of the
next version is there. Rows that stay are copied only where most of a bucket's rows are gone, or lie in many short files. Of two writers of one version the second cannot make the file and fails; what it wrote is in nobody's
live table. Readers look for the last file, then at one live table, which prunes partitions, and pass over what is gone.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.functions.columns import sanitise
from repoindex.functions.sizing import having, keys_apart, small_side
from repoindex.operators.postings import sorted_postings
from repoindex.operators.text_index import TextIndex, read_text_index, write_text_index
from repoindex.operators.upserts import refuse_duplicates
from repoindex.operators.vector_cells import CellIndex, fit_cells, read_cells, write_cells
from repoindex.schemas import CHUNK_SCHEMA, POSTING_SCHEMA, REGISTRY_SCHEMA

BUCKETS = 16
ROWS_PER_BUCKET_BLOCK = 4096
# Bytes of text whose postings a task makes and sorts.
TEXT_PER_TASK = 8 << 20
# Bytes of a row group of chunk files, and of the splits from which postings are made: text takes about a fourth of its length.
ROW_GROUP = TEXT_PER_TASK // 4
# Bytes of text for a byte of chunk files, from which such splits would hold too much of it.
TEXT_PER_BYTE = 8
# Bytes of chunk files whose kept rows a task copies.
KEPT_SPLIT = 16 << 20
# Rows of a bucket are copied once more than one in this many is gone.
ROWS_PER_GONE = 2
# They are also copied, gathered by bucket so that files merge, where a bucket has more files than this, shorter on average than that.
FILES_PER_BUCKET, SHORT_FILE = 16, 4 << 20
# Ids are hashes, which the default codec leaves as long as they are.
CODEC = "zstd"
# Files of postings that a task holds open.
OPEN_FILES = 32
BUCKET_KEYS = ["namespace", "kind", "bucket"]
ROW_KEYS = [*BUCKET_KEYS, "run", "id"]

_LIVE_SCHEMA = "namespace string, kind string, bucket int, run string, gone boolean"
_GONE_SCHEMA = "namespace string, kind string, bucket int, run string, id string"


def bucket_of(path: Column, index: Column, buckets: int) -> Column:
    """By path; a file of very many chunks goes on to other buckets."""
    block = F.floor(index / ROWS_PER_BUCKET_BLOCK)
    return F.pmod(F.xxhash64(path, block), F.lit(buckets)).cast("int")


def _with_layout(schema: T.StructType) -> T.StructType:
    """A table schema as it lies on disk: bucket and run are partition columns too."""
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()),
                         T.StructField("run", T.StringType())])


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system, whatever store that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, store: str) -> int | None:
    """The last version there is: one listing of a folder of small files."""
    if not _folder_exists(spark, f"{store}/versions"):
        return None
    place, files = _folder(spark, f"{store}/versions")
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return max((int(name) for name in names if name.isdigit()), default=None)


def _folder_exists(spark: SparkSession, path: str) -> bool:
    place, files = _folder(spark, path)
    return files.exists(place)


def _run_of(spark: SparkSession, store: str, version: int) -> str:
    return spark.read.text(f"{store}/versions/{version}").first()[0]


def _publish(spark: SparkSession, store: str, version: int, run: str) -> None:
    """Make a version out of what a run wrote: the one step that either happens or does not."""
    place, files = _folder(spark, f"{store}/versions/{version}")
    try:
        stream = files.create(place, False)
    except Py4JJavaError as taken:
        if "FileAlreadyExists" not in taken.java_exception.getClass().getName() and not files.exists(place):
            raise
        raise RuntimeError(f"version {version} of {store} was made by another writer; nothing of this commit is seen")
    stream.write(bytearray(run.encode()))
    stream.close()


def ensure_store(spark: SparkSession, store: str) -> int:
    """Make the store if it is absent; the first version holds an empty registry and no buckets."""
    version = current_version(spark, store)
    if version is not None:
        return version
    run = uuid.uuid4().hex
    spark.createDataFrame([], REGISTRY_SCHEMA).write.parquet(f"{store}/registry/run={run}")
    spark.createDataFrame([], _LIVE_SCHEMA).write.parquet(f"{store}/live/run={run}")
    _publish(spark, store, 0, run)
    return 0


def _live(spark: SparkSession, store: str, run: str) -> DataFrame:
    return spark.read.schema(_LIVE_SCHEMA).parquet(f"{store}/live/run={run}")


def _holders(live: DataFrame) -> DataFrame:
    """(namespace, kind, bucket, run) of the folders that hold rows."""
    return live.where("NOT coalesce(gone, false)").select(*BUCKET_KEYS, "run")


def _runs(live: DataFrame) -> list[str]:
    return sorted(row["run"] for row in live.select("run").distinct().collect())


def _stored_files(spark: SparkSession, store: str, table: str, layout: T.StructType, live: DataFrame) -> DataFrame:
    """Rows in the folders that are live, gone or not; only these are listed."""
    rows = spark.read.schema(layout).option("basePath", f"{store}/{table}")
    return _live_rows(rows.parquet(*[f"{store}/{table}/run={run}" for run in _runs(_holders(live))]), _holders(live))


def _gone(spark: SparkSession, store: str, live: DataFrame) -> DataFrame | None:
    """Keys of the rows that lie in live folders and are gone."""
    runs = _runs(live.where("gone"))
    if not runs:
        return None
    return _live_rows(spark.read.schema(_GONE_SCHEMA).parquet(*[f"{store}/gone/run={run}" for run in runs]), _holders(live))


def _live_files(spark: SparkSession, store: str, table: str, layout: T.StructType, live: DataFrame) -> DataFrame:
    """Live rows. Keys of gone ones are told apart by those of the chunks, so postings are read once."""
    rows, gone = _stored_files(spark, store, table, layout, live), _gone(spark, store, live)
    if gone is None:
        return rows
    keys = rows if table == "chunks" else _stored_files(spark, store, "chunks", _with_layout(CHUNK_SCHEMA), live)
    return keys_apart(keys, gone, ROW_KEYS).without(rows)


def _registry_rows(spark: SparkSession, store: str, run: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{store}/registry/run={run}")


def _read_table(spark, store, table, schema, namespaces, kinds) -> DataFrame:
    version = current_version(spark, store)
    live = None if version is None else _live(spark, store, _run_of(spark, store, version))
    layout = _with_layout(schema)
    if live is None or live.isEmpty():
        rows = spark.createDataFrame([], layout)
    else:
        rows = _live_files(spark, store, table, layout, live)
    if namespaces is not None:
        rows = rows.where(F.col("namespace").isin(*[sanitise(F.lit(n)) for n in namespaces]))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds))
    return rows.select(*schema.names, "bucket")


def _live_rows(rows: DataFrame, live: DataFrame) -> DataFrame:
    return rows.join(small_side(live), [*BUCKET_KEYS, "run"], "left_semi")


def read_chunks(spark: SparkSession, store: str, namespaces: list[str] | None = None,
                kinds: list[str] | None = None) -> DataFrame:
    """Live chunks of the given namespaces and kinds; a missing store or namespace reads as empty."""
    return _read_table(spark, store, "chunks", CHUNK_SCHEMA, namespaces, kinds)


def read_postings(spark: SparkSession, store: str, namespaces: list[str] | None = None,
                  kinds: list[str] | None = None) -> DataFrame:
    return _read_table(spark, store, "postings", POSTING_SCHEMA, namespaces, kinds)


def read_registry(spark: SparkSession, store: str) -> DataFrame:
    version = current_version(spark, store)
    if version is None:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return _registry_rows(spark, store, _run_of(spark, store, version))


def stage(df: DataFrame, store: str) -> DataFrame:
    """Write rows that several later jobs need into the store's folder, and read them back."""
    path = f"{store}/staging/{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _spread_by_text(chunks: DataFrame) -> DataFrame:
    """Chunks by bucket, large buckets cut into parts of about ``TEXT_PER_TASK``."""
    bytes_ = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    sizes = chunks.groupBy(*BUCKET_KEYS).agg(bytes_.alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    large = sizes.where(F.col("bytes") > TEXT_PER_TASK).select(
        *BUCKET_KEYS, F.ceil(F.col("bytes") / TEXT_PER_TASK).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    cut = chunks.join(small_side(large), BUCKET_KEYS, "left_outer").withColumn("part", part)
    return cut.repartition(-(-total // TEXT_PER_TASK) or 1, *BUCKET_KEYS, "part").select(*chunks.columns)


@contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _splits_of(spark: SparkSession, size: int):
    """What is scanned meanwhile is cut into splits of this many bytes."""
    return _setting(spark, "spark.sql.files.maxPartitionBytes", size)


def _space(spark: SparkSession, paths: list[str]) -> tuple[int, int]:
    """How many files lie in folders, and their bytes."""
    found = [files.getContentSummary(place) for place, files in (_folder(spark, path) for path in paths)]
    return sum(f.getFileCount() for f in found), sum(f.getLength() for f in found)


def commit(
    spark: SparkSession,
    store: str,
    incoming: DataFrame | None = None,
    deletes: DataFrame | None = None,
    cleared: DataFrame | None = None,
    registry: DataFrame | None = None,
    config: str = "english",
    buckets: int = BUCKETS,
) -> int:
    """One new version: drop ``deletes`` (namespace, file_path) and the namespaces in ``cleared``, upsert
    ``incoming`` chunk rows (read once, as they are written), replace the registry. Namespaces may be spelled
    in any way. An id that occurs twice in ``incoming`` fails the commit, and so does a version that another writer
    has made in the meantime.

    Rows that stay are left where they are, unless most of their bucket is gone; only ids and paths are read of them.
    """
    version = ensure_store(spark, store)
    before, run = _run_of(spark, store, version), uuid.uuid4().hex
    live = _live(spark, store, before)
    incoming, deletes, cleared, registry = (
        None if df is None else df.withColumn("namespace", sanitise(F.col("namespace")))
        for df in (incoming, deletes, cleared, registry))
    if incoming is not None or deletes is not None or cleared is not None:
        live = _write_buckets(spark, store, run, live, incoming, deletes, cleared, config, buckets)
    if registry is None:
        registry = _registry_rows(spark, store, before)
    registry.select(*REGISTRY_SCHEMA.names).write.parquet(f"{store}/registry/run={run}")
    live.select(*BUCKET_KEYS, "run", "gone").write.parquet(f"{store}/live/run={run}")
    _publish(spark, store, version + 1, run)
    return version + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _write_buckets(spark, store, run, live, incoming, deletes, cleared, config, buckets) -> DataFrame:
    """Write the incoming rows and the keys of those that go; returns the live table of the new version.

    Incoming rows are shuffled by bucket and written first. Kept rows of a bucket are copied beside them, as they lie, if the
    bucket is written anew.
    """
    columns = [*CHUNK_SCHEMA.names, "bucket"]
    layout = _with_layout(CHUNK_SCHEMA)
    target = f"{store}/chunks/run={run}"

    def stored() -> DataFrame:
        return spark.read.schema(layout).option("basePath", f"{store}/chunks").parquet(target).select(*columns)

    if incoming is not None:
        placed = incoming.withColumn("bucket", bucket_of(F.col("file_path"), F.col("chunk_index"), buckets)).select(*columns)
        _write_chunks(_gathered(placed), target)
        incoming = stored()
        refuse_duplicates(incoming, ["namespace", "id"])
    listed = None if deletes is None else deletes.select("namespace", "file_path").distinct()
    filled = spark.createDataFrame([], live.select(*BUCKET_KEYS).schema) if incoming is None else incoming.select(*BUCKET_KEYS)

    if not live.isEmpty():
        base = _live_files(spark, store, "chunks", layout, live).select(*columns, "run")
        paths, touched = base.select(*BUCKET_KEYS, "file_path"), [filled]
        for keys in (incoming, listed):
            if keys is not None:
                named = small_side(keys.select("namespace", "file_path").distinct())
                touched.append(paths.join(named, ["namespace", "file_path"], "left_semi").select(*BUCKET_KEYS))
        if cleared is not None:
            touched.append(live.join(small_side(cleared), "namespace", "left_semi").select(*BUCKET_KEYS))
        # The filter is always true; with it the optimizer takes the side for selective and prunes partitions by it.
        written = stage(_union(touched).distinct(), store).where("bucket >= 0")
        concerned, scattered = base.join(small_side(written), BUCKET_KEYS, "left_semi"), _scattered(spark, store, live)
        gone = _write_gone(spark, store, run, concerned, listed, incoming)
        anew = written if scattered else stage(_worn(spark, store, live, written, gone, cleared), store).where("bucket >= 0")
        if not anew.isEmpty():
            kept, in_place = concerned.join(small_side(anew), BUCKET_KEYS, "left_semi"), not scattered
            if cleared is not None:
                kept = kept.join(small_side(cleared.select("namespace")), "namespace", "left_anti")
            for keys, on in ((listed, ["namespace", "file_path"]), (incoming, ["namespace", "id"])):
                if keys is not None:
                    side = keys_apart(kept, keys, on)
                    kept, in_place = side.without(kept), in_place and side.small
            with _splits_of(spark, KEPT_SPLIT):
                _write_chunks((kept if in_place else _gathered(kept)).select(*columns), target)
            filled = filled.unionByName(anew)
            live = live.join(small_side(anew), BUCKET_KEYS, "left_anti")
        marked = gone.select(*BUCKET_KEYS).distinct().join(small_side(anew), BUCKET_KEYS, "left_anti")
        live = live.unionByName(marked.withColumns({"run": F.lit(run), "gone": F.lit(True)}))
    if _folder_exists(spark, target):
        _write_postings(spark, store, run, stored().select(*BUCKET_KEYS, "id", "text"), target, config)
    return live.unionByName(filled.distinct().withColumns({"run": F.lit(run), "gone": F.lit(False)}))


def _write_gone(spark, store, run, rows, listed, incoming) -> DataFrame:
    """Write the keys of the stored rows that are listed by path or come anew by id, and read them back."""
    found = [spark.createDataFrame([], _GONE_SCHEMA)]
    for keys, on in ((listed, ["namespace", "file_path"]), (incoming, ["namespace", "id"])):
        if keys is not None:
            found.append(having(rows.select(*ROW_KEYS, "file_path"), keys.select(*on), on).select(*ROW_KEYS))
    path = f"{store}/gone/run={run}"
    _union(found).distinct().write.option("compression", CODEC).parquet(path)
    return spark.read.schema(_GONE_SCHEMA).parquet(path)


def _worn(spark, store, live, written, gone, cleared) -> DataFrame:
    """The touched buckets to be written anew: most of their rows are gone, or a row that is gone has no id to be known by."""
    before = _gone(spark, store, live)
    lost = (gone if before is None else gone.unionByName(before)).groupBy(*BUCKET_KEYS).agg(
        F.count("*").alias("lost"), F.count_if(F.col("id").isNull()).alias("unnamed"))
    rows = _stored_files(spark, store, "chunks", _with_layout(CHUNK_SCHEMA), live).groupBy(*BUCKET_KEYS).agg(
        F.count("*").alias("rows"))
    worn = written.join(rows.join(lost, BUCKET_KEYS).where(
        (F.col("lost") * ROWS_PER_GONE > F.col("rows")) | (F.col("unnamed") > 0)), BUCKET_KEYS, "left_semi")
    if cleared is None:
        return worn
    return worn.unionByName(written.join(small_side(cleared), "namespace", "left_semi").select(*BUCKET_KEYS)).distinct()


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows by bucket; AQE cuts oversized buckets into several tasks and merges small ones."""
    return rows.hint("rebalance", *BUCKET_KEYS)


def _scattered(spark: SparkSession, store: str, live: DataFrame) -> bool:
    """Whether many commits have left buckets in many short files, of rows or of keys that are gone."""
    folders = [f"{store}/chunks/run={run}" for run in _runs(_holders(live))]
    files, length = _space(spark, folders + [f"{store}/gone/run={run}" for run in _runs(live.where("gone"))])
    return files > FILES_PER_BUCKET * live.select(*BUCKET_KEYS).distinct().count() and length < SHORT_FILE * files


def _write_chunks(rows: DataFrame, target: str) -> None:
    rows.sortWithinPartitions(*BUCKET_KEYS, "file_path", "chunk_index").write.mode("append").option(
        "compression", CODEC).option("parquet.block.size", ROW_GROUP).partitionBy(*BUCKET_KEYS).parquet(target)


def _write_postings(spark: SparkSession, store: str, run: str, texts: DataFrame, target: str, config: str) -> None:
    """Postings of the texts that lie in ``target``, made where these are read, a row group or so at a time.

    Only texts so alike that a split would hold very much of them are shuffled first.
    """
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    _, file_bytes = _space(spark, [target])
    cut = text_bytes > TEXT_PER_TASK
    if cut and text_bytes > TEXT_PER_BYTE * file_bytes:
        texts, cut = _spread_by_text(texts), False
    rows = sorted_postings(texts, config, BUCKET_KEYS).write.option("compression", CODEC).partitionBy(*BUCKET_KEYS)
    # Rows come sorted; Spark is not to sort them again by folder as long as a task writes into few.
    with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES), _splits_of(spark, ROW_GROUP) if cut else nullcontext():
        rows.parquet(f"{store}/postings/run={run}")


def write_chunks(df: DataFrame, store: str, config: str = "english", buckets: int = BUCKETS) -> int:
    """Upsert a batch of embedded chunk rows into a store, as one version."""
    return commit(df.sparkSession, store, incoming=df, config=config, buckets=buckets)


def write_indexes(spark: SparkSession, store: str) -> None:
    """Make the indexes of the present version and keep them with it: cells of its vectors, slots of its postings.

    A later version needs its own; the searches that use none go on meanwhile.
    """
    version = ensure_store(spark, store)
    write_cells(fit_cells(read_chunks(spark, store)), f"{store}/cells/at={version}")
    write_text_index(read_postings(spark, store), f"{store}/lexemes/at={version}")


def read_indexes(spark: SparkSession, store: str) -> tuple[TextIndex, CellIndex]:
    """The indexes of the present version; a version without them is an error."""
    version = current_version(spark, store)
    return (read_text_index(spark, f"{store}/lexemes/at={version}"), read_cells(spark, f"{store}/cells/at={version}"))
