"""Hybrid search: the nearest and the best matching chunks of every question, fused."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoindex.functions.columns import sanitise
from repoindex.functions.sizing import MAX_BROADCAST_ROWS, small_side
from repoindex.operators.fulltext import CANDIDATES, fts_match, fts_rank, fts_topk, query_clauses, query_forms
from repoindex.operators.fusion import TOP_K, best_fused, rrf_fuse
from repoindex.operators.text_index import TextIndex, text_topk, untouched_topk
from repoindex.operators.vector_cells import RECALL, CellIndex, cell_topk
from repoindex.operators.vector_search import vector_topk
from repoindex.sources.store import read_chunks, read_indexes, read_postings


def _with_texts(fused: DataFrame, chunks: DataFrame, bound: int) -> DataFrame:
    """Text, path and package of the fused hits, whose number is bounded by questions × groups × k.

    Where chunks lie in buckets, the narrow id column tells the buckets first and prunes the text scan.
    """
    def marked(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if bound <= MAX_BROADCAST_ROWS else df

    keys = ["namespace", "kind", "id"]
    if "bucket" in chunks.columns:
        fused = chunks.select(*keys, "bucket").join(marked(fused.where("place >= 1")), keys)
        keys = [*keys, "bucket"]
    return chunks.select(*keys, "file_path", "package", "text").join(
        marked(fused.where("place >= 1")), keys).drop("bucket")


def text_hits(postings: DataFrame | TextIndex, clauses: DataFrame, chunks: DataFrame, k: int, config: str) -> DataFrame:
    """The k best text hits per question, namespace and kind, from postings or from an index of them."""
    if isinstance(postings, TextIndex):
        return text_topk(postings, clauses, k, chunks, config)
    ranked = fts_rank(fts_match(postings, clauses))
    if not query_forms(clauses).where("open_ended").isEmpty():
        ranked = ranked.unionByName(untouched_topk(chunks, clauses, k, config))
    return fts_topk(ranked, k)


def hybrid_topk(
    chunks: DataFrame,
    postings: DataFrame | TextIndex,
    queries: DataFrame,
    k: int = TOP_K,
    *,
    namespaces: list[str] | None = None,
    kinds: list[str] | None = None,
    candidates: int = CANDIDATES,
    across_all: bool = False,
    config: str = "english",
    index: CellIndex | None = None,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, namespace, kind, place, id, score, file_path, package, text) for (query_id, question, embedding).

    The k best per namespace and kind, or with ``across_all`` the k best of all; ``namespaces`` and ``kinds`` limit the
    search. A column ``namespaces`` (array) of the questions limits each to its own: namespaces nobody asks for are not
    searched, a null array asks for all. Text is read only for the fused hits, embeddings only by the vector branch,
    which is exact, or with an ``index`` of the chunks' vectors approximate, to the share ``recall`` of the neighbours.
    """
    asked = None
    if "namespaces" in queries.columns:
        each = F.transform(F.array_distinct("namespaces"), sanitise)
        asked = queries.select("query_id", each.alias("own"))
        queries = queries.drop("namespaces")
        if asked.where("own IS NULL").isEmpty():
            named = small_side(asked.select(F.explode("own").alias("namespace")).distinct())
            chunks = chunks.join(named, "namespace", "left_semi").select(*chunks.columns)
            if not isinstance(postings, TextIndex):
                postings = postings.join(named, "namespace", "left_semi").select(*postings.columns)
            index = None if index is None else index.join_semi(named, "namespace")
    wanted = []
    if kinds is not None:
        wanted.append(F.col("kind").isin(kinds))
    if namespaces is not None:
        names = F.array_distinct(F.array(*[sanitise(F.lit(n)) for n in namespaces]))
        wanted.append(F.array_contains(names, F.col("namespace")))
    for condition in wanted:
        chunks, postings = chunks.where(condition), postings.where(condition)
        index = None if index is None else index.where(condition)
    groups = 2 * len(namespaces) if namespaces is not None else chunks.select("namespace", "kind").distinct().count()
    vectors = chunks.select("namespace", "kind", "id", "embedding")
    asked_vectors = queries.select("query_id", "embedding")
    by_vector = (vector_topk(vectors, asked_vectors, candidates) if index is None
                 else cell_topk(index, asked_vectors, candidates, recall))
    clauses = query_clauses(queries.select("query_id", "question"), config)
    by_text = text_hits(postings, clauses, chunks.select("namespace", "kind", "id", "text"), candidates, config)
    fused = rrf_fuse(by_vector, by_text)
    if asked is not None:
        fused = fused.join(small_side(asked), "query_id").where(
            F.col("own").isNull() | F.array_contains("own", F.col("namespace"))).drop("own")
    fused = best_fused(fused, k, () if across_all else ("namespace", "kind"))
    bound = queries.count() * groups * k
    return _with_texts(fused, chunks, bound).select(
        "query_id", "namespace", "kind", "place", "id", "score", "file_path", "package", "text")


def hybrid_store(spark: SparkSession, store: str, queries: DataFrame, k: int = TOP_K, *, indexed: bool = False,
                 namespaces: list[str] | None = None, kinds: list[str] | None = None, **options) -> DataFrame:
    """``hybrid_topk`` over the present version of a store: its chunks and postings or, if ``indexed``, the indexes that
    ``write_indexes`` made of them; the vector branch is approximate then."""
    chunks = read_chunks(spark, store, namespaces, kinds)
    postings, index = read_indexes(spark, store) if indexed else (read_postings(spark, store, namespaces, kinds), None)
    return hybrid_topk(chunks, postings, queries, k, namespaces=namespaces, kinds=kinds, index=index, **options)
