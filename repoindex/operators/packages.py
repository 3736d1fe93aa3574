"""Package names from the nearest manifest above a file."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoindex.functions.columns import keep_path, parent_dir, sanitise
from repoindex.functions.sizing import small_side


def _ancestors(dirs: DataFrame) -> DataFrame:
    """Add each directory at or above ``dir`` as ``above``, with its ``depth``; the repository root is none of them."""
    parts = F.split("dir", "/")
    return dirs.where("dir != ''").select(
        "*",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                                 lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "above"),
    )


def manifests_above(listing: DataFrame) -> DataFrame:
    """(namespace, root, file_path) where a manifest may be that names the package of a listed file."""
    dirs = listing.select("namespace", "root", parent_dir(F.col("file_path")).alias("dir")).distinct()
    return _ancestors(dirs).select(
        "namespace", "root", F.concat("above", F.lit("/package.json")).alias("file_path")).where(
            keep_path(F.col("file_path"))).distinct()


def package_of_dirs(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(namespace, dir, package) for the directories that have a manifest at or above them.

    Works on distinct directories, so a directory that holds a third of all files is one row here.
    The repository root is not looked at.
    """
    dirs = files.select(sanitise(F.col("namespace")).alias("namespace"), parent_dir(F.col("file_path")).alias("dir")).distinct()
    named = manifests.where("dir != '' AND name != ''").select(
        sanitise(F.col("namespace")).alias("namespace"), F.col("dir").alias("above"), "name")
    return (
        _ancestors(dirs).join(named, ["namespace", "above"])
        .groupBy("namespace", "dir").agg(F.max_by("name", "depth").alias("package"))
    )


def nearest_package(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Add ``package``: the name in the closest named manifest above each file, '' when there is none."""
    named_dirs = package_of_dirs(files, manifests)
    return (
        files.withColumns({"dir": parent_dir(F.col("file_path")), "_namespace": sanitise(F.col("namespace"))})
        .join(small_side(named_dirs.withColumnRenamed("namespace", "_namespace")), ["_namespace", "dir"], "left_outer")
        .select(*files.columns, F.coalesce("package", F.lit("")).alias("package"))
    )
