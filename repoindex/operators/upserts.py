"""Row maintenance: upsert by key, delete by path."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoindex.functions.columns import sanitise
from repoindex.functions.sizing import small_side


def unique_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """The same rows; the job fails when a key occurs twice.

    Only the keys are shuffled, after a map-side count. One repeated key is enough to fail, so the side that
    is joined back is one row at most, and rows do not move.
    """
    repeated = df.groupBy(*key).agg(F.count("*").alias("_copies")).where("_copies > 1").limit(1)
    message = F.concat(F.lit("duplicate key in batch: "), F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    marked = df.join(F.broadcast(repeated), key, "left_outer")
    once = F.when(F.col("_copies") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return marked.where(once).select(*df.columns)


def refuse_duplicates(df: DataFrame, key: list[str]) -> None:
    """Raise if a key occurs twice: one job over the keys, counted map-side first."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("_copies")).where("_copies > 1").first()
    if repeated is not None:
        raise ValueError("duplicate key in batch: " + ":".join(str(repeated[k]) for k in key))


def upsert(base: DataFrame, updates: DataFrame, key: list[str], checked: bool = False) -> DataFrame:
    """Base rows whose key is not updated, and the updates. ``checked`` says the keys are known to be unique."""
    incoming = updates if checked else unique_rows(updates, key)
    kept = base.join(small_side(updates.select(*key)), key, "left_anti")
    return kept.unionByName(incoming.select(*base.columns))


def touched_paths(changes: DataFrame) -> DataFrame:
    """Changed and deleted paths alike, once each."""
    return changes.select(sanitise(F.col("namespace")).alias("namespace"), "file_path").distinct()


def delete_paths(base: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of both kinds whose path is not listed."""
    return base.join(small_side(touched_paths(paths)), ["namespace", "file_path"], "left_anti")


def deleted_counts(base: DataFrame, paths: DataFrame) -> DataFrame:
    """(namespace, file_path, deleted) per path that had rows, and one total row with NULL keys."""
    return (
        base.select("namespace", "file_path")
        .join(small_side(touched_paths(paths)), ["namespace", "file_path"], "left_semi")
        .groupBy("namespace", "file_path").agg(F.count("*").alias("deleted"))
        .groupingSets([["namespace", "file_path"], []], "namespace", "file_path")
        .agg(F.sum("deleted").alias("deleted"))
    )
