"""Commit comparisons to changes, and the decision what each namespace needs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoindex.functions.columns import sanitise, short_sha

# Beyond these a comparison may be cut off.
MAX_COMMITS = 250
MAX_FILES = 300


def changes_from_lists(lists: DataFrame) -> DataFrame:
    """(namespace, file_path, op) from space-separated ``changed`` and ``deleted`` path lists."""
    def of(column: str, op: str) -> DataFrame:
        words = F.split(F.coalesce(column, F.lit("")), r"\s+")
        return lists.select(sanitise(F.col("namespace")).alias("namespace"), F.explode(words).alias("file_path"),
                            F.lit(op).alias("op"))

    return of("changed", "changed").unionByName(of("deleted", "deleted")).where("file_path != ''")


def classify_diff(files: DataFrame) -> DataFrame:
    """Changes from (namespace, status, filename, previous_filename): a rename deletes the old path."""
    def change(path: str, op: str):
        return F.struct(F.col(path).alias("file_path"), F.lit(op).alias("op"))

    ops = (
        F.when(F.col("status") == "removed", F.array(change("filename", "deleted")))
        .when(F.col("status") == "renamed",
              F.array(change("previous_filename", "deleted"), change("filename", "changed")))
        .otherwise(F.array(change("filename", "changed")))
    )
    namespace = sanitise(F.col("namespace")).alias("namespace")
    return files.select(namespace, F.explode(ops).alias("c")).select("namespace", "c.file_path", "c.op")


def effective_changes(changes: DataFrame) -> DataFrame:
    """One row per path. A path both deleted and changed (a rename swap) exists, so it counts as changed."""
    return changes.groupBy(sanitise(F.col("namespace")).alias("namespace"), "file_path").agg(F.min("op").alias("op"))


def diff_too_large(diffs: DataFrame, max_commits: int = MAX_COMMITS, max_files: int = MAX_FILES) -> DataFrame:
    """Add ``too_large`` to (namespace, ahead_by, files), files being a count."""
    return diffs.withColumn(
        "too_large",
        (F.coalesce("ahead_by", F.lit(0)) > max_commits) | (F.coalesce("files", F.lit(0)) >= max_files))


def diff_summary(comparison_files: DataFrame) -> DataFrame:
    """(namespace, ahead_by, files) from exploded comparison rows; a comparison without files counts 0."""
    return comparison_files.groupBy("namespace").agg(
        F.max("ahead_by").alias("ahead_by"), F.count("filename").alias("files"))


def sync_plan(registry: DataFrame, heads: DataFrame, diffs: DataFrame, max_commits: int = MAX_COMMITS,
              max_files: int = MAX_FILES) -> DataFrame:
    """(namespace, repo_url, last_commit_sha, head, short_head, action) per registered namespace.

    Actions, in this order: failed (no head known), up_to_date, full_baseline (no commit recorded),
    full_too_large, noop_advance (nothing changed), incremental; failed also when the comparison is missing.
    """
    sized, namespace = diff_too_large(diffs, max_commits, max_files), sanitise(F.col("namespace")).alias("namespace")
    joined = (
        registry.select(namespace, "repo_url", "last_commit_sha")
        .join(heads.select(namespace, F.col("sha").alias("head")), "namespace", "left_outer")
        .join(sized.select(namespace, "files", "too_large"), "namespace", "left_outer")
    )
    action = (
        F.when(F.col("head").isNull(), "failed")
        .when(F.col("head") == F.col("last_commit_sha"), "up_to_date")
        .when(F.col("last_commit_sha").isNull(), "full_baseline")
        .when(F.col("too_large"), "full_too_large")
        .when(F.col("files") == 0, "noop_advance")
        .when(F.col("files") > 0, "incremental")
        .otherwise("failed")
    )
    return joined.select("namespace", "repo_url", "last_commit_sha", "head",
                         short_sha(F.col("head")).alias("short_head"), action.alias("action"))


def latest_heads(commits: DataFrame) -> DataFrame:
    """(namespace, sha) of the latest commit; equal times are decided by the sha."""
    return commits.groupBy("namespace").agg(F.max_by("sha", F.struct("committed_at", "sha")).alias("sha"))
