"""Defaults and constraints of chunk rows, and their counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoindex.functions.embedding import EMBED_BATCH
from repoindex.schemas import EMBEDDING_DIM


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Package '' and chunk index 0 where they are absent."""
    for name, default in (("package", F.lit("")), ("chunk_index", F.lit(0))):
        value = F.coalesce(F.col(name), default) if name in chunks.columns else default
        chunks = chunks.withColumn(name, value)
    return chunks


def violations(chunks: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """(id, violation) for every broken NOT NULL or dimension rule."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is null"))
             for c in ("id", "embedding", "text", "file_path", "package", "chunk_index")]
    rules.append(F.when(F.size("embedding") != dim, F.lit("embedding dimension")))
    return chunks.select("id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def check_chunks(chunks: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """The same rows; a broken rule fails the job when its row is reached."""
    broken = (F.col("id").isNull() | F.col("embedding").isNull() | F.col("text").isNull()
              | F.col("file_path").isNull() | F.col("package").isNull() | F.col("chunk_index").isNull()
              | (F.size("embedding") != dim))
    message = F.concat(F.lit("chunk constraint violated: "), F.coalesce("id", F.lit("NULL")))
    return chunks.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count("*").alias("chunks"))


def batch_counts(chunks: DataFrame, batch: int = EMBED_BATCH) -> DataFrame:
    """Backend calls needed per namespace and kind."""
    return (
        chunks.groupBy("namespace", "kind").agg(F.count("*").alias("chunks"))
        .withColumn("batches", F.ceil(F.col("chunks") / batch))
    )
