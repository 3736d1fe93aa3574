"""Trees of files as a table, hidden files included.

Spark's own file sources drop every path part that starts with ``_`` or ``.``, so directories are walked in tasks. Listing
and reading are separate: the listing holds paths and sizes only, and contents are read after the skip and routing
rules, by tasks of equal share whatever the directories look like.
"""

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.functions import columns as C
from repoindex.functions.sizing import small_side
from repoindex.session import scratch_path

LISTING_SCHEMA = "namespace string, root string, file_path string, size long"
DIRECTORIES_PER_TASK = 256
BYTES_PER_TASK = 256 << 20
_WALK_SCHEMA = "namespace string, root string, path string, size long"
_ROWS_PER_BATCH = 4096
_BYTES_PER_BATCH = 16 << 20


def open_root(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, for a local path or a URI."""
    if "://" in path or path.startswith("file:"):
        filesystem, root = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    else:
        filesystem, root = pafs.LocalFileSystem(), os.path.abspath(path)
    return filesystem, root.rstrip("/")


def _entries(filesystem: pafs.FileSystem, directory: str) -> Iterator[tuple[str, int | None]]:
    """(name, size) of the files of one directory, (name, None) of its sub-directories. Links to directories are passed over."""
    if isinstance(filesystem, pafs.LocalFileSystem):
        with os.scandir(directory) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, None
                elif entry.is_file():
                    yield entry.name, entry.stat().st_size
    else:
        for entry in filesystem.get_file_info(pafs.FileSelector(directory)):
            if entry.type == pafs.FileType.Directory:
                yield entry.base_name, None
            elif entry.type == pafs.FileType.File:
                yield entry.base_name, entry.size


def _walk(directories: DataFrame, per_task: int, tasks: int) -> DataFrame:
    """Files below the given (namespace, root, path) with their sizes, and directories not opened yet, without one.

    A task opens at most ``per_task`` directories; what it has found by then and not opened it hands back.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, opened = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[], [], [], []]
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()])],
                                   names=["namespace", "root", "path", "size"])

        for batch in batches:
            pending = list(zip(*(batch[c].to_pylist() for c in ("namespace", "root", "path"))))
            while pending:
                space, root, path = pending.pop()
                if opened >= per_task:
                    rows.append((space, root, path, None))
                else:
                    opened += 1
                    filesystem, top = open_root(root)
                    for name, size in _entries(filesystem, f"{top}/{path}" if path else top or "/"):
                        below = f"{path}/{name}" if path else name
                        if size is None:
                            pending.append((space, root, below))
                        else:
                            rows.append((space, root, below, size))
                            if len(rows) >= _ROWS_PER_BATCH:
                                yield flush()
                if len(rows) >= _ROWS_PER_BATCH:
                    yield flush()
        yield flush()

    return directories.select("namespace", "root", "path").repartition(tasks).mapInArrow(walk, _WALK_SCHEMA)


def list_trees(roots: DataFrame, per_task: int = DIRECTORIES_PER_TASK) -> DataFrame:
    """(namespace, root, file_path, size) of every regular file below the roots of a table (namespace, root).

    All trees are walked in one job. Directories that a task has no turn for are dealt out anew, to all tasks and with
    twice the turns, so one huge tree is as spread as many small ones, and jobs grow with the logarithm of the
    directories. The listing is written in the shared folder: a snapshot that later steps read again without another walk.
    Repeated rows of ``roots`` count once; rows without a root are passed over; a root that does not exist is an error.
    """
    spark = roots.sparkSession
    place, turn = scratch_path(spark, "listing"), 0
    tasks = 4 * spark.sparkContext.defaultParallelism
    pending = roots.where("root IS NOT NULL").select(
        C.sanitise(F.col("namespace")).alias("namespace"), "root", F.lit("").alias("path")).distinct()
    while turn == 0 or not pending.isEmpty():
        _walk(pending, per_task << turn, tasks).write.parquet(f"{place}/turn={turn}")
        pending = spark.read.schema(_WALK_SCHEMA).parquet(f"{place}/turn={turn}").where("size IS NULL")
        turn += 1
    return spark.read.schema(_WALK_SCHEMA).parquet(place).where("size IS NOT NULL").select(
        "namespace", "root", F.col("path").alias("file_path"), "size")


def list_repo(spark: SparkSession, path: str, namespace: str, per_task: int = DIRECTORIES_PER_TASK) -> DataFrame:
    """(namespace, root, file_path, size) of every regular file below ``path``."""
    return list_trees(spark.createDataFrame([(namespace, path)], "namespace string, root string"), per_task)


def listed_files(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """(namespace, root, file_path) of listed paths (namespace, file_path) below the roots of their namespace, once each.

    Whether there is a file is seen when it is read. Paths that lead out of the tree are left out.
    """
    def named(df: DataFrame, column: str) -> DataFrame:
        return df.where(f"{column} IS NOT NULL").select(C.sanitise(F.col("namespace")).alias("namespace"), column).distinct()

    inside = ~F.col("file_path").rlike(r"^/|(^|/)\.\.(/|$)")
    return named(paths, "file_path").where(inside).join(small_side(named(roots, "root")), "namespace").select(
        "namespace", "root", "file_path")


def indexed_paths(listing: DataFrame) -> DataFrame:
    """Rows of the files that an index uses, and of manifests."""
    name = F.col("file_path")
    return listing.where(C.keep_path(name) & (C.route_kind(name).isNotNull() | C.is_manifest(name)))


def read_contents(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add ``content`` to rows with (namespace, root, file_path); NULL for what cannot be read.

    Paths are spread evenly, so one huge directory is no task; where the rows have a ``size``, about 256 MB go to one.
    """
    if tasks is None:
        tasks = 4 * listing.sparkSession.sparkContext.defaultParallelism
        if "size" in listing.columns:
            total = listing.agg(F.sum("size")).first()[0] or 0
            tasks = max(tasks, -(-total // BYTES_PER_TASK))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None, None, None
        for batch in batches:
            start, held, bodies = 0, 0, []
            for at, (root, name) in enumerate(zip(batch["root"].to_pylist(), batch["file_path"].to_pylist())):
                if root != opened[0]:
                    opened = root, *open_root(root)
                try:
                    with opened[1].open_input_stream(f"{opened[2]}/{name}") as stream:
                        bodies.append(stream.read())
                except OSError:
                    bodies.append(None)
                held += len(bodies[-1] or b"")
                if held >= _BYTES_PER_BATCH or at == batch.num_rows - 1:
                    part = batch.slice(start, len(bodies))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(bodies, pa.binary())], names=[*part.schema.names, "content"])
                    start, held, bodies = at + 1, 0, []

    schema = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())])
    return listing.repartition(tasks, "namespace", "file_path").mapInArrow(load, schema)


def read_repo(spark: SparkSession, path: str, namespace: str, indexed_only: bool = True,
              tasks: int | None = None) -> DataFrame:
    """(namespace, file_path, content) of a tree. By default only of files an index uses, and of manifests."""
    listing = list_repo(spark, path, namespace)
    rows = read_contents(indexed_paths(listing) if indexed_only else listing, tasks)
    return rows.select("namespace", "file_path", "content")
