"""Corpus pipeline: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage works on all rows its predecessor kept; between stages the rows are a Parquet table in the shared folder.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoindex.llm import bpe, decontaminate, language_id, pii_bootstrap, simhash_vp
from repoindex.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: null, without a letter, or with few of the n-grams that texts of the
    likeliest language have. Their number does not matter, nor does a text's length beyond chance.

    The model is fitted on the documents' own languages. Kept rows stay as they are, repeated ones too.
    """
    model = language_id.fit_languages(docs)
    found = language_id.predict_language(
        docs.withColumns({"_kept": F.struct(*docs.columns)}).select("_kept", F.col("text").alias("text")), model)
    return found.where("recognised").select("_kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest doc_id, of every group that operator 5 links: three-word SimHashes within three
    bits of each other, directly or over others."""
    return simhash_vp.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a word inside a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars counts the new text."""
    clean = pii_bootstrap.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text they stand for: doc_id, lang, source, n_tokens, token_ids, text, exact."""
    model = bpe.ByteBpe.from_file(public_tokenizers.path(TOKENIZER))
    decoded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), model)
    return decoded.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.col("decoded").alias("text"),
                          (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("bpe", encode_and_decode),
]

# String kernels, fingerprints and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
