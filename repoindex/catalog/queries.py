"""One function per registered query; each takes (spark, sf_dir) and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoindex.catalog.views import table, view, write_tree
from repoindex.functions import columns as C
from repoindex.functions.embedding import embed, hash_embed
from repoindex.functions.vectors import cosine_distance
from repoindex.operators import browse, changes as ch, chunk_checks, registry as reg, upserts
from repoindex.operators.fulltext import fts_match, fts_rank, fts_topk, query_clauses
from repoindex.operators.fusion import best_fused, context_string, prompt_rows, rrf_fuse
from repoindex.operators.packages import nearest_package
from repoindex.operators.postings import build_postings, lexemes
from repoindex.operators.text_index import read_text_index, text_topk, write_text_index
from repoindex.operators.vector_cells import cell_topk, fit_cells, read_cells, recall_of, write_cells
from repoindex.operators.vector_search import vector_topk
from repoindex.plans import indexing
from repoindex.plans.indexing import IndexOptions, chunk_rows, ingest, ingest_rows, reindex, sync
from repoindex.plans.search import hybrid_store, hybrid_topk, text_hits
from repoindex.schemas import CHANGE_SCHEMA
from repoindex.session import scratch_path
from repoindex.sources.readers import decode_text, explode_compare, read_manifests, restrict_to
from repoindex.sources.store import commit, read_chunks, read_postings, read_registry, write_indexes
from repoindex.sources.tree import list_trees, read_contents, read_repo
from repoindex.streaming.feed import latest_change, stream_reindex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIM = 64
# The ordinary chunk rules.
CHUNKED = IndexOptions(dim=DIM, config="simple", buckets=4)
CHUNK_KEYS = ["namespace", "kind", "id"]
ROW_COLUMNS = ["namespace", "kind", "id", "file_path", "package", "chunk_index", "text"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs ----


def _files(spark, sf_dir):
    return view(spark, sf_dir, "v_files").select("namespace", "file_path", "text")


def _manifests(spark, sf_dir):
    return view(spark, sf_dir, "v_manifests")


def _chunks(spark, sf_dir):
    return view(spark, sf_dir, "v_chunks")


def _embedded_chunks(spark, sf_dir):
    return embed(_chunks(spark, sf_dir), "text", dim=DIM)


def _questions(spark, sf_dir):
    return view(spark, sf_dir, "v_queries").select("query_id", "question")


def _embedded_questions(spark, sf_dir):
    rows = embed(view(spark, sf_dir, "v_queries"), "passage", mode="query", dim=DIM)
    return rows.select("query_id", "question", "embedding")


def _changes(spark, sf_dir):
    rows = view(spark, sf_dir, "v_changes")
    return ch.classify_diff(rows.withColumnRenamed("file_path", "filename"))


def _latest_changes(spark, sf_dir):
    return latest_change(_feed(view(spark, sf_dir, "v_changes")))


def _feed(changes):
    op = F.when(F.col("status") == "removed", "deleted").otherwise("changed")
    return changes.select("namespace", "file_path", op.alias("op"), "ts", "event_id")


def _comparisons(spark, sf_dir):
    """One comparison per event, of one file, under a namespace per day; the day of the year counts as commits."""
    rows = view(spark, sf_dir, "v_changes")
    return rows.select(
        F.concat("namespace", F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("namespace"),
        F.dayofyear("ts").alias("ahead_by"),
        F.array(F.struct("status", F.col("file_path").alias("filename"), "previous_filename")).alias("files"))


def _diffs(spark, sf_dir):
    return view(spark, sf_dir, "v_changes").groupBy("namespace").agg(
        F.countDistinct(F.to_date("ts")).alias("ahead_by"), F.countDistinct("file_path").alias("files"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.lit("corpus").alias("namespace"), F.lit("code").alias("kind"), F.col("vec_id").cast("string").alias("id"),
        "embedding", "label")


def _centroids(vectors):
    """The mean vector of each label as a question."""
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells")).select(
        F.col("label").cast("long").alias("query_id"), F.transform("cells", lambda c: c["x"]).alias("embedding"))


def _paths(spark, sf_dir):
    """Repository-like paths from page addresses: host, then the path of the page."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))


# ---- sources ----


@query
def scan_files(spark, sf_dir):
    path = scratch_path(spark, "tree")
    write_tree(_files(spark, sf_dir), path)
    found = decode_text(read_repo(spark, path, "corpus", indexed_only=False))
    return found.select("namespace", "file_path", F.sha2("text", 256).alias("text_hash"))


def _roots(spark, sf_dir):
    """A tree per namespace, manifests included, as a table (namespace, root)."""
    path = scratch_path(spark, "trees")
    manifests = _manifests(spark, sf_dir).select(
        "namespace", F.concat("dir", F.lit("/package.json")).alias("file_path"), F.to_json(F.struct("name")).alias("text"))
    write_tree(_files(spark, sf_dir).unionByName(manifests), path)
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("ns_"), "lang").alias("namespace")).distinct()
    return names.where("namespace IS NOT NULL").select("namespace", F.concat(F.lit(f"{path}/"), "namespace").alias("root"))


@query
def scan_trees(spark, sf_dir):
    """Every file of many trees, listed in one job and read by its size."""
    found = decode_text(read_contents(list_trees(_roots(spark, sf_dir), per_task=4)))
    return found.select("namespace", "file_path", "size", F.sha2("text", 256).alias("text_hash"))


@query
def ingest_trees(spark, sf_dir):
    """Trees into a store with the ordinary chunk rules, packages by the manifests in the trees."""
    store = scratch_path(spark, "from-trees")
    indexing.ingest_trees(spark, store, _roots(spark, sf_dir), options=CHUNKED)
    return read_chunks(spark, store).select(*ROW_COLUMNS)


@query
def reindex_trees(spark, sf_dir):
    """Changes applied from the trees: only the changed files are opened, and the manifests above them."""
    store = _old_store(spark, sf_dir, "changed-trees")
    indexing.reindex_trees(spark, store, _roots(spark, sf_dir), _latest_changes(spark, sf_dir), CHUNKED)
    return read_chunks(spark, store).select(*ROW_COLUMNS)


@query
def changed_files(spark, sf_dir):
    changed = _latest_changes(spark, sf_dir).where("op = 'changed'")
    return restrict_to(_files(spark, sf_dir), changed).select("namespace", "file_path", F.length("text").alias("chars"))


@query
def decode_text_files(spark, sf_dir):
    """Texts stored with the two other line ends, as bytes."""
    stored = _files(spark, sf_dir).select(
        "namespace", "file_path",
        F.regexp_replace(F.regexp_replace("text", "\n", "\r\n"), " ", "\r").cast("binary").alias("content"))
    return decode_text(stored)


@query
def manifests(spark, sf_dir):
    """A manifest per source directory: named, without a name, broken, or a list, by the length of its name."""
    dirs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("ns_"), "lang").alias("namespace"), "source").distinct()
    shape = F.pmod(F.substring("source", 4, 9).cast("int"), F.lit(4))
    body = (
        F.when(shape == 0, F.concat(F.lit('{"version": "1", "name": "@corpus/'), "source", F.lit('"}')))
        .when(shape == 1, F.lit('{"name": ""}'))
        .when(shape == 2, F.concat(F.lit('{"name": "@corpus/'), "source", F.lit('"')))
        .otherwise(F.concat(F.lit('["name", "'), "source", F.lit('"]')))
    )
    files = dirs.select("namespace", F.concat(F.lit("packages/"), "source", F.lit("/package.json")).alias("file_path"),
                        body.alias("text"))
    return read_manifests(files)


@query
def compare_files(spark, sf_dir):
    return explode_compare(_comparisons(spark, sf_dir))


@query
def latest_heads(spark, sf_dir):
    commits = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("namespace"),
        F.md5(F.col("event_id").cast("string")).alias("sha"), F.col("ts").alias("committed_at"))
    return ch.latest_heads(commits)


@query
def missing_namespace_empty(spark, sf_dir):
    chunks = read_chunks(spark, f"{sf_dir}/no_such_store", ["ns_absent"])
    files = _files(spark, sf_dir)
    return files.join(chunks, ["namespace", "file_path"], "left_semi").select("namespace", "file_path")


@query
def parse_path_lists(spark, sf_dir):
    """Each conversation turn taken for a space-separated list."""
    lists = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("namespace"), F.col("text").alias("changed"), F.lit("").alias("deleted"))
    return ch.changes_from_lists(lists).groupBy("namespace", "file_path", "op").agg(F.count("*").alias("times"))


# ---- projections and filters ----


@query
def sanitise_namespace(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.sanitise(F.col("url")).alias("namespace"))


@query
def skip_filter(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files.where(C.keep_path(F.col("file_path"))).select("namespace", "file_path")


@query
def route_kind(spark, sf_dir):
    return _files(spark, sf_dir).select("namespace", "file_path", C.route_kind(F.col("file_path")).alias("kind"))


@query
def drop_blank(spark, sf_dir):
    """Lines of all documents that hold text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(C.has_text(F.col("text"))).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum("line").alias("line_sum"))


@query
def parse_repo_url(spark, sf_dir):
    parts = C.parse_repo_url(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", parts["owner"].alias("owner"), parts["repo"].alias("repo"))


@query
def chunk_label(spark, sf_dir):
    files = nearest_package(_files(spark, sf_dir), _manifests(spark, sf_dir))
    return files.select("namespace", "file_path", C.chunk_label(F.col("package"), F.col("file_path")).alias("label"))


@query
def chunk_ids(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    made = C.chunk_id(F.col("namespace"), F.col("file_path"), F.col("chunk_index"))
    return chunks.select("namespace", "file_path", "chunk_index", made.alias("id"))


@query
def constraint_violations(spark, sf_dir):
    """Documents with the vector of their number as chunks: most have none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = view(spark, sf_dir, "v_files").join(vectors, "doc_id", "left_outer").select(
        C.chunk_id(F.col("namespace"), F.col("file_path"), F.lit(0)).alias("id"),
        F.when(F.length("text") < 2000, F.col("embedding")).otherwise(F.slice("embedding", 1, 63)).alias("embedding"),
        F.nullif(F.substring_index("file_path", ".", -1), F.lit("md")).alias("text"), "file_path")
    return chunk_checks.violations(chunk_checks.with_defaults(rows), DIM)


@query
def batch_counts(spark, sf_dir):
    return chunk_checks.batch_counts(_chunks(spark, sf_dir))


# ---- chunking ----


def _real_chunks(spark, sf_dir):
    return chunk_rows(_files(spark, sf_dir), _manifests(spark, sf_dir))


@query
def chunk_code(spark, sf_dir):
    rows = _real_chunks(spark, sf_dir).where("kind = 'code'")
    return rows.where(F.endswith("file_path", F.lit(".go")) | F.endswith("file_path", F.lit(".sql")))


@query
def chunk_docs(spark, sf_dir):
    return _real_chunks(spark, sf_dir).where("kind = 'docs'")


@query
def chunk_lang(spark, sf_dir):
    rows = _real_chunks(spark, sf_dir).where("kind = 'code'")
    return rows.where(C.path_suffix(F.col("file_path")).isin(".py", ".ts", ".js"))


@query
def chunk_rows_all(spark, sf_dir):
    return _real_chunks(spark, sf_dir)


@query
def chunk_invariants(spark, sf_dir):
    """Per file: whether sizes, contents and indexes of its chunks are as they must be, and how much text they hold."""
    files = _files(spark, sf_dir)
    limit = F.when(F.col("kind") == "code", 2000).otherwise(4000)
    rows = _real_chunks(spark, sf_dir)
    per_file = rows.join(files.withColumnRenamed("text", "body"), ["namespace", "file_path"]).groupBy(
        "namespace", "file_path").agg(
        F.bool_and(F.length("text") <= limit).alias("within_limit"),
        F.bool_and(C.has_text(F.col("text"))).alias("no_blank"),
        F.bool_and(F.contains("body", F.col("text"))).alias("substrings"),
        (F.max("chunk_index") + 1 == F.count("*")).alias("contiguous"),
        (F.countDistinct("id") == F.count("*")).alias("unique_ids"),
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))
    return per_file


# ---- embedding ----


def _components(df, key):
    """Non-zero vector components as rows."""
    return df.select(key, F.posexplode("embedding").alias("dim", "x")).where("x != 0").select(
        key, "dim", F.round(F.col("x").cast("double"), 5).alias("x"))


@query
def embed_chunks(spark, sf_dir):
    return _components(_embedded_chunks(spark, sf_dir), "id")


@query
def embed_queries(spark, sf_dir):
    return _components(embed(view(spark, sf_dir, "v_queries"), "passage", mode="query", dim=DIM), "query_id")


def _letter_counts(texts: list[str], mode: str) -> list[list[float]]:
    """A stand-in for a model: length, spaces and line ends of each text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query
def embed_backend(spark, sf_dir):
    """Any Python callable as a backend, 64 texts a call."""
    rows = embed(_chunks(spark, sf_dir), "text", _letter_counts, dim=3)
    return rows.select("id", *[F.get("embedding", F.lit(i)).cast("double").alias(n)
                               for i, n in enumerate(("chars", "spaces", "lines"))])


@query
def hash_embed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _components(docs.select("doc_id", hash_embed(F.col("text"), DIM).alias("embedding")), "doc_id")


# ---- joins and aggregates ----


@query
def nearest_package_names(spark, sf_dir):
    return nearest_package(_files(spark, sf_dir), _manifests(spark, sf_dir)).select("namespace", "file_path", "package")


@query
def table_stats(spark, sf_dir):
    return browse.table_stats(_chunks(spark, sf_dir))


@query
def chunk_counts(spark, sf_dir):
    return chunk_checks.chunk_counts(_chunks(spark, sf_dir))


@query
def deleted_counts(spark, sf_dir):
    return upserts.deleted_counts(_chunks(spark, sf_dir), _changes(spark, sf_dir))


# ---- full text ----


@query
def lexemes_simple(spark, sf_dir):
    return lexemes(_chunks(spark, sf_dir).select("id", "text"), "simple")


@query
def lexemes_english(spark, sf_dir):
    return lexemes(_chunks(spark, sf_dir).select("id", "text"), "english")


@query
def postings(spark, sf_dir):
    rows = build_postings(_chunks(spark, sf_dir), "simple")
    return rows.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query
def postings_english(spark, sf_dir):
    rows = build_postings(_chunks(spark, sf_dir), "english")
    return rows.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query
def query_clauses_simple(spark, sf_dir):
    """Questions with every operator, ``first "second third" or -fourth``, from every four words of the passages; the
    last four go on with the first words again."""
    rows = view(spark, sf_dir, "v_queries").select(
        "query_id", F.regexp_extract_all("passage", F.lit("[A-Za-z]+"), 0).alias("w")).where(F.size("w") > 0)
    rows = rows.select("query_id", "w", F.explode(F.sequence(
        F.lit(0), F.ceil(F.size("w") / 4).cast("int") - 1)).alias("four"))
    a, b, c, d = (F.get("w", F.pmod(4 * F.col("four") + n, F.size("w"))) for n in range(4))
    question = F.concat(a, F.lit(' "'), b, F.lit(" "), c, F.lit('" or -'), d)
    return query_clauses(rows.select(
        (F.col("query_id") * 1000 + F.col("four")).alias("query_id"), question.alias("question")), "simple")


def _matches(spark, sf_dir, question):
    """Matches of a frequent pair of neighbouring words of each benchmark text, put together by ``question``."""
    words = F.split("pair", " ")
    asked = view(spark, sf_dir, "v_queries").select(
        "query_id", question(F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("question"))
    return fts_match(build_postings(_chunks(spark, sf_dir), "simple"), query_clauses(asked, "simple"))


def _any_word_matches(spark, sf_dir):
    """Matches of any of all words of each benchmark text."""
    return fts_match(build_postings(_chunks(spark, sf_dir), "simple"), query_clauses(_questions(spark, sf_dir), "simple"))


@query
def fts_match_all(spark, sf_dir):
    rows = _matches(spark, sf_dir, lambda a, b: F.concat_ws(" ", a, b))
    return rows.select("query_id", *CHUNK_KEYS)


@query
def fts_match_phrase(spark, sf_dir):
    rows = _matches(spark, sf_dir, lambda a, b: F.concat(F.lit('"'), F.concat_ws(" ", a, b), F.lit('"')))
    return rows.select("query_id", *CHUNK_KEYS)


@query
def fts_match_any(spark, sf_dir):
    return _any_word_matches(spark, sf_dir).select("query_id", *CHUNK_KEYS)


@query
def fts_match_not(spark, sf_dir):
    rows = _matches(spark, sf_dir, lambda a, b: F.concat_ws(" -", a, b))
    return rows.select("query_id", *CHUNK_KEYS)


@query
def fts_ranks(spark, sf_dir):
    return fts_rank(_matches(spark, sf_dir, lambda a, b: F.concat_ws(" ", a, b)))


@query
def fts_ranks_any(spark, sf_dir):
    return fts_rank(_any_word_matches(spark, sf_dir))


@query
def fts_topk_hits(spark, sf_dir):
    return fts_topk(fts_rank(_matches(spark, sf_dir, lambda a, b: F.concat_ws(" ", a, b))))


def _text_index(spark, sf_dir):
    path = scratch_path(spark, "text-index")
    write_text_index(build_postings(_chunks(spark, sf_dir), "simple"), path, slots=32)
    return read_text_index(spark, path)


@query
def text_index_counts(spark, sf_dir):
    return _text_index(spark, sf_dir).counts.drop("slot")


@query
def text_index_topk(spark, sf_dir):
    """The 20 best chunks with both words of the pairs, through an index on disk."""
    asked = view(spark, sf_dir, "v_queries").select("query_id", F.col("pair").alias("question"))
    return text_topk(_text_index(spark, sf_dir), query_clauses(asked, "simple"))


@query
def text_index_topk_any(spark, sf_dir):
    """The 20 best chunks with any word of the whole benchmark texts, through an index on disk."""
    return text_topk(_text_index(spark, sf_dir), query_clauses(_questions(spark, sf_dir), "simple"))


@query
def text_negation_topk(spark, sf_dir):
    """The first 20 chunks without the second word of each pair."""
    word = F.get(F.split("pair", " "), F.lit(1))
    asked = view(spark, sf_dir, "v_queries").select("query_id", F.concat(F.lit("-"), word).alias("question"))
    chunks = _chunks(spark, sf_dir)
    return text_hits(build_postings(chunks, "simple"), query_clauses(asked, "simple"), chunks, 20, "simple")


# ---- vectors ----


@query
def cosine_distances(spark, sf_dir):
    """Distance of every vector to the mean of its label."""
    vectors = _vectors(spark, sf_dir)
    means = _centroids(vectors).select(F.col("query_id").alias("label"), F.col("embedding").alias("mean"))
    return vectors.join(means, "label").select(
        "id", F.round(cosine_distance(F.col("embedding"), F.col("mean")), 9).alias("dist"))


@query
def vector_topk_hits(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return vector_topk(vectors.drop("label"), _centroids(vectors))


def _all_as_questions(vectors):
    return vectors.select(F.col("id").cast("long").alias("query_id"), "embedding")


@query
def vector_topk_many(spark, sf_dir):
    """Every vector as a question, in blocks of 512: as many scans, and no vector moves."""
    vectors = _vectors(spark, sf_dir).drop("label")
    return vector_topk(vectors, _all_as_questions(vectors), block=512)


def _cells(spark, sf_dir):
    path = scratch_path(spark, "cells")
    write_cells(fit_cells(_vectors(spark, sf_dir).drop("label")), path)
    return read_cells(spark, path)


@query
def vector_topk_cells(spark, sf_dir):
    """Approximate search over trained cells on disk, 20 neighbours of the mean of each label."""
    return cell_topk(_cells(spark, sf_dir), _centroids(_vectors(spark, sf_dir)))


@query
def vector_cells_recall(spark, sf_dir):
    """Whether the approximate search finds 95 % of the 20 nearest neighbours of all vectors, taken as questions."""
    vectors = _vectors(spark, sf_dir).drop("label")
    asked = _all_as_questions(vectors)
    found = recall_of(cell_topk(_cells(spark, sf_dir), asked), vector_topk(vectors, asked))
    return found.agg(F.count(F.lit(1)).alias("questions"), F.sum("neighbours").alias("neighbours"),
                     (F.sum("found") >= 0.95 * F.sum("neighbours")).alias("reached"))


# ---- hybrid search ----


def _hybrid(spark, sf_dir, **kwargs):
    chunks = _embedded_chunks(spark, sf_dir)
    return hybrid_topk(chunks, build_postings(chunks, "simple"), _embedded_questions(spark, sf_dir),
                       config="simple", **kwargs)


@query
def rrf_fused(spark, sf_dir):
    chunks = _embedded_chunks(spark, sf_dir)
    asked = _embedded_questions(spark, sf_dir)
    by_vector = vector_topk(chunks.select(*CHUNK_KEYS, "embedding"), asked.drop("question"))
    return rrf_fuse(by_vector, fts_topk(fts_rank(_any_word_matches(spark, sf_dir))))


@query
def hybrid_topk_hits(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query
def hybrid_topk_overall(spark, sf_dir):
    return _hybrid(spark, sf_dir, across_all=True).drop("text")


@query
def hybrid_multi_namespace(spark, sf_dir):
    return _hybrid(spark, sf_dir, namespaces=["ns_en", "NS-fr"]).drop("text")


@query
def hybrid_docs_only(spark, sf_dir):
    return _hybrid(spark, sf_dir, kinds=["docs"]).drop("text")


@query
def hybrid_per_question_namespace(spark, sf_dir):
    """Every question to namespaces of its own: two of the four, by its number."""
    pairs = [["NS-en", "ns_fr"], ["ns_de", "ns_es"], ["ns_fr", "ns_de"]]
    own = F.get(F.array(*[F.array(*map(F.lit, pair)) for pair in pairs]), F.pmod("query_id", F.lit(3)).cast("int"))
    chunks = _embedded_chunks(spark, sf_dir)
    asked = _embedded_questions(spark, sf_dir).withColumn("namespaces", own)
    return hybrid_topk(chunks, build_postings(chunks, "simple"), asked, config="simple").drop("text")


@query
def hybrid_english(spark, sf_dir):
    chunks = _embedded_chunks(spark, sf_dir)
    return hybrid_topk(chunks, build_postings(chunks, "english"), _embedded_questions(spark, sf_dir)).drop("text")


@query
def context_strings(spark, sf_dir):
    return context_string(_hybrid(spark, sf_dir), _questions(spark, sf_dir))


@query
def prompt_messages(spark, sf_dir):
    """Each conversation: its last user turn is the question, the turns before it the history, and the chunks of the
    document of its number, if there is one, the context."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.max("turn").alias("last"), F.max_by("text", "turn").alias("question"))
    history = turns.withColumnRenamed("conv_id", "query_id").join(asked.select("query_id", "last"), "query_id").where(
        F.col("turn") < F.col("last")).select("query_id", "turn", "role", "text")
    docs = view(spark, sf_dir, "v_files").select("namespace", "file_path", F.col("doc_id").alias("query_id"))
    results = (
        _chunks(spark, sf_dir).join(docs, ["namespace", "file_path"])
        .withColumn("place", F.col("chunk_index") + 1).join(asked, "query_id", "left_semi")
    )
    return prompt_rows(context_string(results, asked), asked, history)


# ---- maintenance ----


def _updates(chunks):
    """New versions of the chunks after the first of each file, and one new chunk per file."""
    newer = chunks.where("chunk_index > 0").select(*ROW_COLUMNS).withColumn("text", F.concat(F.lit("old: "), "text"))
    added = chunks.where("chunk_index = 0").select(*ROW_COLUMNS).withColumn(
        "id", F.sha2(F.concat(F.lit("new:"), "id"), 256)).withColumn("package", F.lit("added"))
    return newer.unionByName(added)


@query
def upsert_chunks(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return upserts.upsert(chunks.select(*ROW_COLUMNS), _updates(chunks), ["id"])


@query
def delete_chunks(spark, sf_dir):
    deleted = _changes(spark, sf_dir).where("op = 'deleted'")
    return upserts.delete_paths(_chunks(spark, sf_dir), deleted)


@query
def ingest_chunks(spark, sf_dir):
    """The indexing pipeline with the ordinary chunk rules; embeddings as whole hundred-thousandths."""
    rows = ingest_rows(_files(spark, sf_dir), _manifests(spark, sf_dir), IndexOptions(dim=DIM))
    parts = F.transform("embedding", lambda x: F.round(x.cast("double") * 100000).cast("int").cast("string"))
    return rows.withColumn("embedding", F.array_join(parts, ","))


@query
def ingest_store(spark, sf_dir):
    """The same through a store: longer old texts first, then the real ones over them. Chunks that only the old texts had
    stay, as an ingest by upsert leaves them."""
    store = _old_store(spark, sf_dir, "store")
    ingest(spark, store, _files(spark, sf_dir), _manifests(spark, sf_dir), options=CHUNKED)
    return read_chunks(spark, store).select(*ROW_COLUMNS)


def _indexed_store(spark, sf_dir):
    """A store of all files with its indexes, and the whole benchmark texts as questions."""
    store = scratch_path(spark, "searched")
    ingest(spark, store, _files(spark, sf_dir), _manifests(spark, sf_dir), options=CHUNKED)
    write_indexes(spark, store)
    return store


@query
def hybrid_over_store(spark, sf_dir):
    """Hybrid search over what a store holds: its chunks, its postings."""
    return hybrid_store(spark, _indexed_store(spark, sf_dir), _embedded_questions(spark, sf_dir), config="simple").drop("text")


@query
def hybrid_over_indexes(spark, sf_dir):
    """The same through the store's indexes of postings and vectors, reading all cells that hold a neighbour in the sample:
    as long as that is all vectors, the exact result."""
    return hybrid_store(spark, _indexed_store(spark, sf_dir), _embedded_questions(spark, sf_dir), indexed=True, recall=1.0,
                        config="simple").drop("text")


@query
def store_postings(spark, sf_dir):
    """The postings of a store whose files were indexed twice: those of the present chunks, and of old ones beyond the last."""
    store = _old_store(spark, sf_dir, "postings")
    ingest(spark, store, _files(spark, sf_dir), _manifests(spark, sf_dir), options=CHUNKED)
    rows = read_postings(spark, store).select(*CHUNK_KEYS, "lexeme", "positions")
    return rows.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def _old_store(spark, sf_dir, name):
    """A store of every file with a mark, so that what a later run renews can be told; the old text is the file twice, so
    that files shrink."""
    store = scratch_path(spark, name)
    text = F.concat(F.lit("old: "), "text", F.lit("\n"), "text")
    ingest(spark, store, _files(spark, sf_dir).withColumn("text", text), options=CHUNKED)
    return store


@query
def reindex_store(spark, sf_dir):
    """Changed files shrink to their present chunks, deleted ones go, all others keep their old ones."""
    store = _old_store(spark, sf_dir, "reindex")
    reindex(spark, store, _files(spark, sf_dir), _latest_changes(spark, sf_dir), options=CHUNKED)
    return read_chunks(spark, store).select(*ROW_COLUMNS)


@query
def stream_reindexed(spark, sf_dir):
    """A reindex from a streamed feed of the changes."""
    store = _old_store(spark, sf_dir, "stream")
    feed_path = scratch_path(spark, "feed")
    feed = _feed(view(spark, sf_dir, "v_changes"))
    feed.write.parquet(feed_path)
    stream = spark.readStream.schema(feed.schema).parquet(feed_path)
    stream_reindex(stream, _files(spark, sf_dir), store, f"{store}/progress", options=CHUNKED).awaitTermination()
    return read_chunks(spark, store).select(*ROW_COLUMNS)


@query
def reindex_raw_namespace(spark, sf_dir):
    """The reindex with every namespace spelled as its owner would: the store's own spelling decides."""
    def raw(df):
        return df.withColumn("namespace", F.upper(F.replace("namespace", F.lit("_"), F.lit("-"))))

    store = _old_store(spark, sf_dir, "reindex-raw")
    reindex(spark, store, raw(_files(spark, sf_dir)), raw(_latest_changes(spark, sf_dir)), options=CHUNKED)
    return read_chunks(spark, store).select(*ROW_COLUMNS)


@query
def stream_late_events(spark, sf_dir):
    """The streamed feed out of order, in several batches: the last event of a path decides, not the last batch."""
    store = _old_store(spark, sf_dir, "late")
    feed_path = scratch_path(spark, "late-feed")
    feed = _feed(view(spark, sf_dir, "v_changes"))
    feed.repartition(3, F.xxhash64("event_id")).write.parquet(feed_path)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(feed_path)
    stream_reindex(stream, _files(spark, sf_dir), store, f"{store}/progress", options=CHUNKED).awaitTermination()
    return read_chunks(spark, store).select(*ROW_COLUMNS)


def _synced(spark, sf_dir):
    store = _old_store(spark, sf_dir, "sync")
    commit(spark, store, registry=view(spark, sf_dir, "v_registry"), config="simple")
    report = sync(spark, store, view(spark, sf_dir, "v_heads"), _diffs(spark, sf_dir),
                  _latest_changes(spark, sf_dir).select(*CHANGE_SCHEMA.names), _files(spark, sf_dir),
                  now=F.lit("2024-06-01 00:00:00").cast("timestamp"), options=CHUNKED)
    return store, report


@query
def sync_apply(spark, sf_dir):
    return read_chunks(spark, _synced(spark, sf_dir)[0]).select(*ROW_COLUMNS)


@query
def sync_report(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


@query
def sync_registry(spark, sf_dir):
    return read_registry(spark, _synced(spark, sf_dir)[0])


@query
def classify_diff(spark, sf_dir):
    return _changes(spark, sf_dir)


@query
def diff_too_large(spark, sf_dir):
    return ch.diff_too_large(ch.diff_summary(explode_compare(_comparisons(spark, sf_dir))), 20, 20)


@query
def sync_plan(spark, sf_dir):
    return ch.sync_plan(view(spark, sf_dir, "v_registry"), view(spark, sf_dir, "v_heads"), _diffs(spark, sf_dir))


def _registrations(spark, sf_dir):
    """Every source as a namespace of its own, and the languages again with new commits."""
    docs = table(spark, sf_dir, "documents")
    sources = docs.select(F.col("source").alias("name")).distinct()
    langs = docs.select(F.concat(F.lit("NS-"), "lang").alias("name")).distinct()
    return sources.unionByName(langs).select(
        F.col("name").alias("namespace"), F.concat(F.lit("https://example.org/new/"), "name").alias("repo_url"),
        F.when(F.startswith("name", F.lit("src1")), "").otherwise(F.md5("name")).alias("sha"))


@query
def register_namespace(spark, sf_dir):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return reg.register(view(spark, sf_dir, "v_registry"), _registrations(spark, sf_dir), now)


@query
def advance_sha(spark, sf_dir):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    heads = view(spark, sf_dir, "v_heads").where("namespace != 'ns_de'").unionByName(
        table(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), F.md5("source").alias("sha"))
        .distinct())
    return reg.advance_sha(view(spark, sf_dir, "v_registry"), heads, now)


@query
def registered_namespaces(spark, sf_dir):
    return reg.registered(view(spark, sf_dir, "v_registry"))


@query
def latest_changes(spark, sf_dir):
    return _latest_changes(spark, sf_dir)


# ---- browsing ----


@query
def list_namespaces(spark, sf_dir):
    return browse.list_namespaces(_chunks(spark, sf_dir))


@query
def get_file(spark, sf_dir):
    """Every file of the feed, those that are not indexed included."""
    asked = view(spark, sf_dir, "v_changes").select("namespace", "file_path")
    return browse.get_file(_chunks(spark, sf_dir), asked)


@query
def namespace_info(spark, sf_dir):
    return browse.namespace_info(_chunks(spark, sf_dir), view(spark, sf_dir, "v_registry"))


@query
def namespace_info_asked(spark, sf_dir):
    """Health rows for the sources, which no namespace is named after, and for the languages in another spelling."""
    documents = table(spark, sf_dir, "documents")
    asked = documents.select(F.col("source").alias("namespace")).unionByName(
        documents.select(F.concat(F.lit("NS-"), "lang").alias("namespace")))
    return browse.namespace_info(_chunks(spark, sf_dir), view(spark, sf_dir, "v_registry"), asked)


@query
def list_files(spark, sf_dir):
    return browse.list_files(_chunks(spark, sf_dir), "NS-en", "packages/src1")


@query
def repo_tree(spark, sf_dir):
    return browse.repo_tree(_chunks(spark, sf_dir), depth=3)


@query
def repo_tree_pages(spark, sf_dir):
    """The tree of all page addresses."""
    paths = _paths(spark, sf_dir).select(F.lit("pages").alias("namespace"), F.col("path").alias("file_path"))
    return browse.repo_tree(paths, depth=1)
