"""Ingest, reindex and sync: files to chunk rows to a new version of a store."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoindex.functions import columns as C
from repoindex.functions.columns import sanitise
from repoindex.functions.embedding import EMBED_BATCH, embed
from repoindex.functions.sizing import small_side
from repoindex.operators.changes import effective_changes, sync_plan
from repoindex.operators.chunk_checks import check_chunks, violations
from repoindex.operators.chunking import ChunkRule, DEFAULT_RULES, chunk_files, routed_files
from repoindex.operators.packages import manifests_above, nearest_package
from repoindex.operators.registry import advance_sha, register
from repoindex.operators.upserts import delete_paths, deleted_counts
from repoindex.schemas import CHUNK_SCHEMA, EMBEDDING_DIM
from repoindex.session import staged
from repoindex.sources.readers import decode_text, read_manifests, restrict_to
from repoindex.sources.store import (
    BUCKETS, commit, current_version, ensure_store, read_chunks, read_registry, stage,
)
from repoindex.sources.tree import list_trees, listed_files, read_contents


@dataclass(frozen=True)
class IndexOptions:
    """How files become rows: chunk rules, the embedding backend, the text search configuration."""

    rules: dict[str, ChunkRule] = field(default_factory=lambda: dict(DEFAULT_RULES))
    dim: int = EMBEDDING_DIM
    fn: object = None
    loader: object = None
    batch: int = EMBED_BATCH
    config: str = "english"
    buckets: int = BUCKETS


def chunk_rows(files: DataFrame, manifests: DataFrame | None = None,
               rules: dict[str, ChunkRule] | None = None) -> DataFrame:
    """Files (namespace, file_path, text) to chunk rows without embeddings.

    Files may come with their ``kind`` and ``package``, as those of ``tree_files`` do; manifests decide on the package anew.
    """
    known = [c for c in ("kind", "package") if manifests is None and c in files.columns]
    files = files.select(sanitise(F.col("namespace")).alias("namespace"), "file_path", "text", *known)
    if manifests is not None:
        files = nearest_package(routed_files(files), manifests)
    return chunk_files(files, rules)


def ingest_rows(files: DataFrame, manifests: DataFrame | None = None, options: IndexOptions = IndexOptions(),
                null_on_error: bool = False) -> DataFrame:
    """Files to embedded chunk rows. Nothing but the package lookup may shuffle."""
    chunks = chunk_rows(files, manifests, options.rules)
    embedded = embed(chunks, "text", options.fn, loader=options.loader, batch=options.batch, dim=options.dim,
                     null_on_error=null_on_error)
    return embedded.select(*CHUNK_SCHEMA.names)


def reindex_rows(base: DataFrame, files: DataFrame, changes: DataFrame, manifests: DataFrame | None = None,
                 options: IndexOptions = IndexOptions()) -> DataFrame:
    """Base rows without the changed and deleted paths, and fresh rows for the changed paths that exist."""
    changed = effective_changes(changes)
    fresh = ingest_rows(restrict_to(files, changed.where("op = 'changed'")), manifests, options)
    return delete_paths(base, changed).unionByName(fresh.select(*base.columns))


def tree_files(roots: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(namespace, file_path, kind, package, text) of the files an index uses, below the roots of a table (namespace, root).

    Kinds and packages are decided on paths; of contents, manifests are read first, and then each file once. With ``only``
    (namespace, file_path) no tree is walked: the listed files are opened, and the manifests above them. Listed paths that
    lead out of the tree, and those without a file, are passed over.
    """
    if only is None:
        listing = list_trees(roots)
        manifest_paths = listing.where(C.keep_path(F.col("file_path")) & C.is_manifest(F.col("file_path")))
    else:
        listing = listed_files(roots, only)
        manifest_paths = manifests_above(listing)
    manifests = staged(read_manifests(decode_text(read_contents(manifest_paths))), "manifests")
    named = nearest_package(routed_files(listing), manifests)
    return decode_text(read_contents(named)).select("namespace", "file_path", "kind", "package", "text")


def ingest_trees(spark: SparkSession, store: str, roots: DataFrame, mode: str = "upsert",
                 options: IndexOptions = IndexOptions(), registration: DataFrame | None = None,
                 now: Column | None = None) -> int:
    """Index the trees of a table (namespace, root) as one version; ``replace`` also clears namespaces whose tree is empty."""
    return ingest(spark, store, tree_files(roots), None, mode, options, registration, now, namespaces=roots)


def reindex_trees(spark: SparkSession, store: str, roots: DataFrame, changes: DataFrame,
                  options: IndexOptions = IndexOptions()) -> int:
    """Apply (namespace, file_path, op) changes to a store. The work grows with the changes, not with the trees."""
    changes = stage(effective_changes(changes), store)
    return _reindex(spark, store, tree_files(roots, changes.where("op = 'changed'")), changes, None, options)


def ingest(spark: SparkSession, store: str, files: DataFrame, manifests: DataFrame | None = None,
           mode: str = "upsert", options: IndexOptions = IndexOptions(), registration: DataFrame | None = None,
           now: Column | None = None, namespaces: DataFrame | None = None) -> int:
    """Index files into a store. ``upsert`` leaves the rows of files that are gone; ``replace`` clears the
    namespaces of the files first, or those in ``namespaces``. ``registration`` (namespace, repo_url, sha) is recorded in the
    same version."""
    if mode not in ("upsert", "replace"):
        raise ValueError(f"unknown ingest mode: {mode}")
    rows = check_chunks(ingest_rows(files, manifests, options), options.dim)
    named = files if namespaces is None else namespaces
    cleared = named.select(sanitise(F.col("namespace")).alias("namespace")).distinct() if mode == "replace" else None
    registry = None if registration is None else register(read_registry(spark, store), registration, now)
    return commit(spark, store, incoming=rows, cleared=cleared, registry=registry, config=options.config,
                  buckets=options.buckets)


def reindex(spark: SparkSession, store: str, files: DataFrame, changes: DataFrame,
            manifests: DataFrame | None = None, options: IndexOptions = IndexOptions()) -> int:
    """Apply (namespace, file_path, op) changes to a store; ``files`` is the present state of the trees."""
    changes = stage(effective_changes(changes), store)
    return _reindex(spark, store, restrict_to(files, changes.where("op = 'changed'")), changes, manifests, options)


def _reindex(spark: SparkSession, store: str, files: DataFrame, changes: DataFrame, manifests: DataFrame | None,
             options: IndexOptions) -> int:
    incoming = check_chunks(ingest_rows(files, manifests, options), options.dim)
    return commit(spark, store, incoming=incoming, deletes=changes, config=options.config,
                  buckets=options.buckets)


def sync(spark: SparkSession, store: str, heads: DataFrame, diffs: DataFrame, changes: DataFrame,
         files: DataFrame, manifests: DataFrame | None = None, full_mode: str = "upsert",
         now: Column | None = None, options: IndexOptions = IndexOptions(),
         names: list[str] | None = None) -> DataFrame:
    """Bring every registered namespace, or those in ``names``, to its head in one job; a report row per namespace.

    ``heads`` (namespace, sha), ``diffs`` (namespace, ahead_by, files), ``changes`` (namespace, file_path, op)
    and ``files`` describe one snapshot. Namespaces that fail (no head, no comparison, a text without a valid
    embedding) keep their rows and their recorded commit; the others go on.
    """
    ensure_store(spark, store)
    registry = read_registry(spark, store)
    files = files.withColumn("namespace", sanitise(F.col("namespace")))
    due = registry if names is None else registry.where(F.col("namespace").isin(*[sanitise(F.lit(n)) for n in names]))
    plan = stage(sync_plan(due, heads, diffs), store)
    full = plan.where("action IN ('full_baseline', 'full_too_large')").select("namespace")
    partial = plan.where("action = 'incremental'").select("namespace")

    listed = stage(effective_changes(changes).join(small_side(partial), "namespace", "left_semi"), store)
    due = files.join(small_side(full), "namespace", "left_semi").unionByName(
        restrict_to(files, listed.where("op = 'changed'")))
    rows = stage(ingest_rows(due, manifests, options, null_on_error=True), store)
    broken = violations(rows.withColumn("id", F.col("namespace")), options.dim).select(
        F.col("id").alias("namespace")).distinct()
    failed = stage(
        plan.where("action = 'failed'").select("namespace").unionByName(broken).distinct(), store)

    def sound(df: DataFrame) -> DataFrame:
        return df.join(small_side(failed), "namespace", "left_anti")

    incoming, deletes = sound(rows), sound(listed)
    gone = stage(deleted_counts(read_chunks(spark, store), deletes).where("namespace IS NOT NULL")
                 .groupBy("namespace").agg(F.sum("deleted").alias("deleted")), store)
    moved = sound(plan.where("action NOT IN ('failed', 'up_to_date')"))
    based = register(registry, moved.where("action = 'full_baseline'").select(
        "namespace", "repo_url", F.col("head").alias("sha")), now)
    advanced = advance_sha(based, moved.where("action != 'full_baseline'").select(
        "namespace", F.col("head").alias("sha")), now)
    cleared = sound(full) if full_mode == "replace" else None
    commit(spark, store, incoming=incoming, deletes=deletes, cleared=cleared, registry=advanced,
           config=options.config, buckets=options.buckets)

    added = incoming.groupBy("namespace").agg(F.count("*").alias("chunks"))
    return (
        plan.select("namespace", "action", "short_head")
        .join(failed.withColumn("failed", F.lit(True)), "namespace", "left_outer")
        .join(gone, "namespace", "left_outer").join(added, "namespace", "left_outer")
        .select("namespace", "action", "short_head",
                F.when(F.col("failed"), "failed").otherwise("ok").alias("status"),
                F.coalesce("deleted", F.lit(0)).alias("deleted"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    )


def failed_namespaces(report: DataFrame) -> DataFrame:
    return report.where("status = 'failed'").select("namespace")


__all__ = [
    "IndexOptions", "chunk_rows", "current_version", "failed_namespaces", "ingest", "ingest_rows", "ingest_trees", "reindex",
    "reindex_rows", "reindex_trees", "sync", "tree_files",
]
