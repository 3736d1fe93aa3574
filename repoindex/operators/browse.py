"""Catalogue and browse reads over the chunk table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoindex.functions.columns import iso_timestamp, sanitise
from repoindex.functions.sizing import small_side
from repoindex.operators.fusion import CHUNK_SEPARATOR, kind_order


def _in_namespace(chunks: DataFrame, namespace: str | None) -> DataFrame:
    return chunks if namespace is None else chunks.where(F.col("namespace") == sanitise(F.lit(namespace)))


def list_namespaces(chunks: DataFrame) -> DataFrame:
    """Namespaces that hold code."""
    return chunks.where("kind = 'code'").select("namespace").distinct().orderBy("namespace")


def table_stats(chunks: DataFrame) -> DataFrame:
    """Exact distinct files and chunks per namespace and kind.

    Spark first groups by (namespace, kind, file_path), so a large namespace is spread by path.
    """
    return chunks.groupBy("namespace", "kind").agg(
        F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


def namespace_info(chunks: DataFrame, registry: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One health row per namespace that is indexed or registered: counts per kind, and what the registry says.

    With ``asked`` (namespace), in any spelling, one row for each of these instead: zeros for one that nobody knows.
    """
    if asked is not None:
        asked = asked.select(sanitise(F.col("namespace")).alias("namespace")).where("namespace IS NOT NULL").distinct()
        side = small_side(asked)
        chunks, registry = (df.join(side, "namespace", "left_semi") for df in (chunks, registry))
    stats = table_stats(chunks)

    def of_kind(kind: str, column: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    counts = stats.groupBy("namespace").agg(
        of_kind("code", "files").alias("code_files"), of_kind("code", "chunks").alias("code_chunks"),
        of_kind("docs", "files").alias("doc_files"), of_kind("docs", "chunks").alias("doc_chunks"),
    )
    known = registry.select(
        "namespace", "repo_url", "last_commit_sha",
        iso_timestamp(F.col("last_indexed_at")).alias("last_indexed_at"))
    names = ["code_files", "code_chunks", "doc_files", "doc_chunks"]
    joined = counts.join(known, "namespace", "full_outer")
    if asked is not None:
        joined = asked.join(joined, "namespace", "left_outer")
    filled = joined.select(
        "namespace", "repo_url", "last_commit_sha", "last_indexed_at",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return filled.withColumn("total_chunks", F.col("code_chunks") + F.col("doc_chunks"))


def distinct_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("namespace", "file_path").distinct()


def list_files(chunks: DataFrame, namespace: str | None = None, prefix: str = "") -> DataFrame:
    """Distinct paths with a literal prefix, sorted by code point; the prefix reaches the scan."""
    rows = _in_namespace(chunks, namespace)
    if prefix:
        rows = rows.where(F.startswith(F.col("file_path"), F.lit(prefix)))
    return distinct_paths(rows).orderBy("namespace", "file_path")


def repo_tree(chunks: DataFrame, namespace: str | None = None, depth: int = 2) -> DataFrame:
    """Directories down to ``depth`` (with a final slash), and the files no deeper than them."""
    paths = distinct_paths(_in_namespace(chunks, namespace))
    parts = F.split("file_path", "/")
    levels = F.least(F.size(parts) - 1, F.lit(depth))
    dirs = F.when(levels >= 1, F.transform(
        F.sequence(F.lit(1), levels),
        lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    own = F.when(F.size(parts) <= depth + 1, F.array("file_path"))
    none = F.array().cast("array<string>")
    entries = F.concat(F.coalesce(dirs, none), F.coalesce(own, none))
    return paths.select("namespace", F.explode(entries).alias("entry")).distinct().orderBy("namespace", "entry")


def get_file(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """(namespace, file_path, content) for the asked paths: heading, then the chunks, code before docs.

    Chunks overlap and keep their separators, so this is the indexed text, not the byte-exact file. A group
    is one file, whose whole text was one cell before it was cut. Paths without chunks get a message.
    """
    wanted = paths.select(sanitise(F.col("namespace")).alias("namespace"), "file_path").distinct()
    marked = small_side(wanted)
    found = (
        chunks.select("namespace", "file_path", "kind", "chunk_index", "text")
        .join(marked, ["namespace", "file_path"], "left_semi")
        .groupBy("namespace", "file_path")
        .agg(F.array_sort(F.collect_list(
            F.struct(kind_order(F.col("kind")).alias("kind_no"), "chunk_index", "text"))).alias("pieces"))
        .select("namespace", "file_path",
                F.array_join(F.transform("pieces", lambda p: p["text"]), CHUNK_SEPARATOR).alias("body"))
    )
    heading = F.concat(F.lit("# "), F.col("file_path"), F.lit("\n\n"), F.col("body"))
    absent = F.concat(F.lit("(No content found for '"), F.col("file_path"), F.lit("' in namespace '"),
                      F.col("namespace"), F.lit("')"))
    return wanted.join(found, ["namespace", "file_path"], "left_outer").select(
        "namespace", "file_path", F.coalesce(heading, absent).alias("content"))
