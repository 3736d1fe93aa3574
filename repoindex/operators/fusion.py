"""Reciprocal rank fusion of vector and text hits, and what is made of the result."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoindex.functions.columns import chunk_label

# Fusion constants, result size, separators and the hint for an empty answer.
RRF_CONSTANT = 60
MISSING_RANK = 100
TOP_K = 6
SCORE_DIGITS = 9
CHUNK_SEPARATOR = "\n\n---\n\n"
CONTEXT_HEADING = "\n\n## Retrieved context\n\n"
EMPTY_HINT = "(No relevant context found: index the repository first.)"
DEFAULT_SYSTEM = "Answer the question from the retrieved context below, and say so where the context has no answer."

HIT_KEYS = ["query_id", "namespace", "kind", "id"]


def rrf_join(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Full outer join of the two hit lists: (hit keys, v_rn, f_rn)."""
    left = vector_hits.select(*HIT_KEYS, F.col("rn").alias("v_rn"))
    right = text_hits.select(*HIT_KEYS, F.col("rn").alias("f_rn"))
    return left.join(right, HIT_KEYS, "full_outer")


def rrf_fuse(vector_hits: DataFrame, text_hits: DataFrame, k0: int = RRF_CONSTANT,
             missing: int = MISSING_RANK) -> DataFrame:
    """Add ``score`` to the joined hits; a hit absent from one list counts as rank ``missing`` there."""
    def share(rank: str):
        return 1.0 / (k0 + F.coalesce(rank, F.lit(missing))).cast("double")

    return rrf_join(vector_hits, text_hits).withColumn("score", F.round(share("v_rn") + share("f_rn"), SCORE_DIGITS))


def best_fused(fused: DataFrame, k: int = TOP_K, across: tuple[str, ...] = ("namespace", "kind")) -> DataFrame:
    """The k best fused hits of a question within each of ``across`` (nothing: over all), numbered from 1."""
    order = Window.partitionBy("query_id", *across).orderBy(F.desc("score"), "id")
    return fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def kind_order(kind):
    """Code comes before docs."""
    return F.when(kind == "code", 0).otherwise(1)


def context_string(results: DataFrame, queries: DataFrame, hint: str = EMPTY_HINT) -> DataFrame:
    """(query_id, context): labelled chunks in result order, or the hint for questions without results.

    A group is one question's results: k per namespace and kind.
    """
    entry = F.struct(
        F.col("namespace"), kind_order(F.col("kind")).alias("kind_no"), F.col("place"),
        F.concat(F.lit("# "), chunk_label(F.col("package"), F.col("file_path")), F.lit("\n"), F.col("text"))
        .alias("body"),
    )
    ordered = F.array_sort(F.collect_list(entry))
    contexts = results.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["body"]), CHUNK_SEPARATOR).alias("context"))
    return queries.select("query_id").join(contexts, "query_id", "left_outer").withColumn(
        "context", F.coalesce("context", F.lit(hint)))


def prompt_rows(contexts: DataFrame, questions: DataFrame, history: DataFrame | None = None,
                system: str = DEFAULT_SYSTEM) -> DataFrame:
    """Messages of every prompt as rows (query_id, part, turn, role, content), to be read in (part, turn) order.

    Part 0 is the system text with the context, part 1 the history (query_id, turn, role, text), part 2
    the question. Rows, not one array: a long conversation is never gathered in one cell.
    """
    opening = contexts.select(
        "query_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"),
        F.concat(F.lit(system + CONTEXT_HEADING), F.col("context")).alias("content"))
    asked = questions.select(
        "query_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"),
        F.col("question").alias("content"))
    prompts = opening.unionByName(asked)
    if history is not None:
        prompts = prompts.unionByName(history.select(
            "query_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role",
            F.col("text").alias("content")))
    return prompts
