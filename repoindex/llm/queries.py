"""Registered queries over the operators of this subpackage, and the SQL of those that SQL can state."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoindex.llm import (
    bpe, decontaminate, filter_audit, language_id, pii_bootstrap, pu_quality, quality_llr, sharding, simhash_vp,
    source_divergence, token_shards, warc_fixity, winnowing,
)
from repoindex.llm.batches import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 8
SHUFFLE_KEY = 20_240_607


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> bpe.ByteBpe:
    return bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_feistel_shards(spark, sf_dir):
    keys = sharding.document_keys(table(spark, sf_dir, "documents"))
    return sharding.shard_rows(keys, SHARDS, SHUFFLE_KEY).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


@query
def op5_simhash_vp_trees(spark, sf_dir):
    found = simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_vp.hex_of("simhash").alias("fingerprint"), "component_id")


@query
def op8_byte_bpe(spark, sf_dir):
    model = byte_bpe()
    docs = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    decoded = docs.withColumns({"ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2("decoded", 256)})
    return decoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op10_prefix_filter_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op1_ngram_likelihood_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_llr.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "llr")


def fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(parts))


@query
def op6_pu_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(3) == 1
    model = pu_quality.learn_quality(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = pu_quality.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_string_kernel_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(4) == 2
    model = language_id.fit_languages(docs.where(~held_out))
    found = language_id.predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_bootstrapped_pii(spark, sf_dir):
    found = pii_bootstrap.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda span: span["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}")
              for n, kind in enumerate(pii_bootstrap.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii_bootstrap.span_string(F.col("base")), 256).alias("base_sha256"),
        pii_bootstrap.span_string(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query
def op4_warc_merkle_fixity(spark, sf_dir):
    """Two replicas of the archive of all pages; the second has bytes changed, records lost, moved and too many."""
    rows = warc_fixity.records(table(spark, sf_dir, "pages"))
    turn = F.pmod(F.crc32(F.encode(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "UTF-8")), F.lit(50))
    changed = F.sha2(F.concat(F.expr("left(content, length(content) - 5)"), F.lit("#\r\n\r\n")), 256)
    rows = rows.withColumn("replica_digest", F.when(turn == 7, changed).when(turn != 8, F.col("digest")))
    placed = staged(warc_fixity.manifest(rows, ["page_id", "length", "digest", "replica_digest"]), "warc-manifest")
    original = placed.select("file", "record", "start", "end", "digest")
    padding = F.when(turn == 9, 4).otherwise(0)
    replica = placed.where("replica_digest IS NOT NULL").select(
        "file", "record", (F.col("start") + padding).alias("start"), (F.col("end") + padding).alias("end"),
        F.col("replica_digest").alias("digest"))
    extra = placed.where(F.col("page_id") % 500 == 0).select(
        "file", (F.col("record") + warc_fixity.RECORDS_PER_FILE).alias("record"), "start", "end", "digest")
    found = warc_fixity.audit(original, replica.unionByName(extra))
    ids = placed.select("file", "record", "page_id")
    return found.join(ids, ["file", "record"], "left").select(
        "file", "record", "start", "end", "fault", "digest", "replica_digest", "page_id",
        "replica_start", "replica_end")


@query
def op3_training_order_shards(spark, sf_dir):
    model = byte_bpe()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_shards.materialise(docs, model, SHUFFLE_KEY, model.specials[b"<|endoftext|>"])


@query
def op11_filter_interaction_audit(spark, sf_dir):
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_source_divergence_audit(spark, sf_dir):
    return source_divergence.source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@query
def op13_winnowing_fingerprints(spark, sf_dir):
    return winnowing.compare_successors(table(spark, sf_dir, "documents").select("doc_id", "text"))
