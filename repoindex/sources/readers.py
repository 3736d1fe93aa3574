"""Small readers over tables of files and JSON payloads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoindex.functions import columns as C
from repoindex.functions.sizing import having
from repoindex.schemas import COMPARE_SCHEMA


def decode_text(files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``text``; files that could not be read are left out."""
    return files.where("content IS NOT NULL").withColumn("text", C.decode_utf8(F.col("content"))).drop("content")


def restrict_to(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files whose path is listed, under whatever spelling of the namespace; listed paths without a file are ignored."""
    keys = changes.select(C.sanitise(F.col("namespace")).alias("_namespace"), "file_path").distinct()
    named = files.withColumn("_namespace", C.sanitise(F.col("namespace")))
    return having(named, keys, ["_namespace", "file_path"]).select(*files.columns)


def read_manifests(files: DataFrame) -> DataFrame:
    """(namespace, dir, name) of package manifests with a truthy name; broken JSON and lists are passed over.

    The whole document has to parse, and a JSON false, 0, null or empty value is no name.
    """
    document = F.try_parse_json("text")
    value = F.try_variant_get(document, "$.name", "string")
    falsy = F.coalesce(F.schema_of_variant(F.try_variant_get(document, "$.name", "variant")), F.lit("")) != "STRING"
    return (
        files.where(C.is_manifest(F.col("file_path")))
        .select("namespace", C.parent_dir(F.col("file_path")).alias("dir"), value.alias("name"),
                falsy.alias("not_text"))
        .where((F.col("name") != "") & ~(F.col("not_text") & F.col("name").isin("false", "0", "[]", "{}")))
        .drop("not_text")
    )


def explode_compare(comparisons: DataFrame) -> DataFrame:
    """One row per changed file; a comparison without files keeps one row with NULL file columns."""
    return comparisons.select("namespace", "ahead_by", F.explode_outer("files").alias("f")).select(
        "namespace", "ahead_by", "f.status", "f.filename", "f.previous_filename")


def read_compare(spark: SparkSession, path: str) -> DataFrame:
    """Commit comparisons stored as JSON lines, exploded to their files."""
    return explode_compare(spark.read.schema(COMPARE_SCHEMA).json(path))
