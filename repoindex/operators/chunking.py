"""Files to chunk rows."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.functions import columns as C
from repoindex.functions.splitter import split_text


@dataclass(frozen=True)
class ChunkRule:
    size: int
    overlap: int


# Characters per chunk and overlap.
CODE_RULE = ChunkRule(2000, 200)
DOCS_RULE = ChunkRule(4000, 400)
# Texts of an Arrow batch that are Python strings at a time.
FILES_AT_A_TIME = 256
DEFAULT_RULES = {"code": CODE_RULE, "docs": DOCS_RULE}

# Suffixes with separators of their own.
LANGUAGE_SUFFIXES = {"ts": [".ts", ".tsx"], "js": [".js", ".jsx"], "python": [".py"]}


def splitter_language(path: Column) -> Column:
    suffix = C.path_suffix(path)
    language = F.lit("default")
    for name, suffixes in LANGUAGE_SUFFIXES.items():
        language = F.when(suffix.isin(suffixes), name).otherwise(language)
    return language


def split_column(text: Column, language: Column, kind: Column, rules: dict[str, ChunkRule]) -> Column:
    """Chunks of each text as an array, one Python call per Arrow batch."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array, languages: pa.Array, kinds: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), FILES_AT_A_TIME):
            out = []
            for body, lang, k in zip(*(c.slice(start, FILES_AT_A_TIME).to_pylist() for c in (texts, languages, kinds))):
                out.append(split_text(body, lang, rules[k].size, rules[k].overlap))
            parts.append(pa.array(out, pa.list_(pa.string())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return split(text, language, kind)


def routed_files(files: DataFrame) -> DataFrame:
    """Files whose path is indexed, with ``kind``. Looks at paths only."""
    path = F.col("file_path")
    return files.where(C.keep_path(path)).withColumn("kind", C.route_kind(path)).where("kind IS NOT NULL")


def chunk_files(files: DataFrame, rules: dict[str, ChunkRule] | None = None) -> DataFrame:
    """Chunk rows (namespace, kind, id, file_path, package, chunk_index, text) of a table of files.

    Files are routed here unless they come with a ``kind``. A map-side operation: no shuffle, and the rows of a file come from one text that is already one cell.
    """
    rules = rules or DEFAULT_RULES
    if "package" not in files.columns:
        files = files.withColumn("package", F.lit(""))
    if "kind" not in files.columns:
        files = routed_files(files)
    pieces = split_column(F.col("text"), splitter_language(F.col("file_path")), F.col("kind"), rules)
    rows = files.where(C.has_text(F.col("text"))).select(
        "namespace", "kind", "file_path", "package", F.posexplode(pieces).alias("chunk_index", "text"))
    return rows.select(
        "namespace", "kind",
        C.chunk_id(F.col("namespace"), F.col("file_path"), F.col("chunk_index")).alias("id"),
        "file_path", "package", "chunk_index", "text",
    )
