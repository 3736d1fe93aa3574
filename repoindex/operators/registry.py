"""The namespace registry."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoindex.functions.columns import sanitise
from repoindex.operators.upserts import upsert


def register(registry: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """Upsert (namespace, repo_url, sha). An empty sha is NULL: the next sync then runs in full."""
    stamped = updates.select(
        sanitise(F.col("namespace")).alias("namespace"), "repo_url",
        F.nullif(F.col("sha"), F.lit("")).alias("last_commit_sha"),
        (F.current_timestamp() if now is None else now).alias("last_indexed_at"))
    return upsert(registry, stamped, ["namespace"])


def advance_sha(registry: DataFrame, shas: DataFrame, now: Column | None = None) -> DataFrame:
    """Set (namespace, sha) on namespaces that are registered; others are not added."""
    fresh = shas.select(sanitise(F.col("namespace")).alias("namespace"), F.col("sha").alias("new_sha"), F.lit(True).alias("hit"))
    stamp = F.current_timestamp() if now is None else now
    return registry.join(fresh, "namespace", "left_outer").select(
        "namespace", "repo_url",
        F.when(F.col("hit"), F.col("new_sha")).otherwise(F.col("last_commit_sha")).alias("last_commit_sha"),
        F.when(F.col("hit"), stamp).otherwise(F.col("last_indexed_at")).alias("last_indexed_at"))


def registered(registry: DataFrame, name: str | None = None) -> DataFrame:
    rows = registry if name is None else registry.where(F.col("namespace") == sanitise(F.lit(name)))
    return rows.select("namespace", "repo_url", "last_commit_sha").orderBy("namespace")
