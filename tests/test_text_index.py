"""The text index against the search over all matches, what it reads and what it moves."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from repoindex.operators import fulltext, text_index as X
from repoindex.operators.fulltext import fts_match, fts_rank, fts_topk, query_clauses
from repoindex.operators.postings import build_postings
from repoindex.plans.search import text_hits

QUESTIONS = ["common rare", "common", "rare", "common or rare", '"common w1"', "w1 -common", "-common", "w2 or -w3",
             '"w1 w2" or rare', "absent", "absent or w4", "common absent", "-absent", "-common -w1", "",
             " or ".join(f"w{n}" for n in range(40)) + " or common or usual", "usual common w1", '-"common w1"']


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    rows = []
    for n in range(1500):
        words = rng.choices([f"w{i}" for i in range(60)], weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(1, 30))
        words += ["common"] * (rng.random() < 0.9) + ["usual"] * rng.randrange(3) + ["rare"] * (rng.random() < 0.02)
        rng.shuffle(words)
        rows.append(("n" if n % 3 else "m", "code" if n % 2 else "docs", f"{rng.getrandbits(64):016x}", " ".join(words)))
    return spark.createDataFrame(rows, "namespace string, kind string, id string, text string").repartition(6)


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("text") / "index")
    X.write_text_index(build_postings(chunks, "simple"), path, slots=16)
    return X.read_text_index(spark, path)


def clauses(spark, questions):
    return query_clauses(spark.createDataFrame(list(enumerate(questions)), "query_id long, question string"), "simple")


def listed(df):
    return sorted((r.query_id, r.namespace, r.kind, r.rn, r.id, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k, first_rows", [(20, X.FIRST_ROWS), (3, 10), (1, 1)])
def test_index_gives_what_all_matches_give(spark, chunks, index, monkeypatch, k, first_rows):
    monkeypatch.setattr(X, "FIRST_ROWS", first_rows)
    asked = clauses(spark, QUESTIONS)
    every = fts_topk(fts_rank(fts_match(build_postings(chunks, "simple"), asked, chunks.select("namespace", "kind", "id"))), k)
    assert listed(X.text_topk(index, asked, k, chunks, "simple")) == listed(every)
    assert listed(text_hits(build_postings(chunks, "simple"), asked, chunks, k, "simple")) == listed(every)


def test_matches_without_k_are_all(spark, chunks, index):
    asked = clauses(spark, [q for q in QUESTIONS if not q.startswith("-")])
    want = fts_rank(fts_match(build_postings(chunks, "simple"), asked)).collect()
    assert sorted(map(str, fts_rank(X.text_matches(index, asked)).collect())) == sorted(map(str, want))


def test_frequent_word_moves_no_more_rows_than_the_rarest(spark, index):
    asked = clauses(spark, ["common usual rare"])
    forms = X.query_forms(asked)
    seeds = X.rarest_words(forms, index.counts)
    assert [r.lexeme for r in seeds.collect()] == ["rare"]
    rows = X._touched(index.postings, asked.select("query_id", "lexeme"), seeds)
    sent = {r.lexeme: r["count"] for r in rows.groupBy("lexeme").count().collect()}
    assert sent["common"] <= sent["rare"] and sent["usual"] <= sent["rare"] < 60
    # The filter by the rare word's chunks comes before any exchange.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2


def test_frequent_words_of_alternatives_find_no_chunks(spark, index):
    asked = clauses(spark, [" or ".join(f"w{n}" for n in range(40)) + " or common or usual"])
    forms = X.query_forms(asked)
    finding = X.finding_words(index, forms, index.counts, None, 5)
    left = {r.lexeme for r in finding.where("namespace = 'n' AND kind = 'code'").collect()}
    assert "common" not in left and {f"w{n}" for n in range(30, 40)} <= left


def test_many_words_prune_folders(spark, index):
    words = [f"w{n}" for n in range(12)]
    rows = X.of_words(index.postings, words, index.slots)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "slot#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {r.slot for r in rows.select("slot").distinct().collect()}
    assert len(read) < 16 and rows.select("lexeme").distinct().count() == 12
    # Two hundred words read their own slots only, whatever their number.
    many = X.of_words(index.postings, [f"none{n}" for n in range(200)], 10_000)
    assert many.count() == 0


def test_negations_leave_k_rows_per_task(spark, chunks, monkeypatch):
    asked = clauses(spark, ["-common", "-w1 -w2", "w1"])
    rows = X.untouched_topk(chunks, asked, 4, "simple")
    tasks = chunks.rdd.getNumPartitions()
    assert rows.count() <= tasks * 2 * 4 * 4 and "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()
    whole = listed(fts_topk(rows, 4))
    monkeypatch.setattr(X, "QUESTIONS_PER_SCAN", 2)
    assert listed(fts_topk(X.untouched_topk(chunks, asked, 4, "simple"), 4)) == whole


def test_empty_index(spark, chunks, tmp_path):
    X.write_text_index(build_postings(chunks.limit(0), "simple"), str(tmp_path / "i"), 4)
    assert X.text_topk(X.read_text_index(spark, str(tmp_path / "i")), clauses(spark, ["a", "b c", "d or e"])).count() == 0
    assert X.text_topk(X.read_text_index(spark, str(tmp_path / "i")), clauses(spark, [])).count() == 0


def test_counts(chunks, index):
    want = build_postings(chunks, "simple").groupBy("namespace", "kind", "lexeme").agg(
        F.count("*").alias("chunks"), F.max(F.size("positions")).alias("most"))
    assert sorted(map(str, index.counts.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("at_a_time", [1, 1 << 18])
def test_postings_move_once_however_many_questions_ask(spark, chunks, monkeypatch, at_a_time):
    monkeypatch.setattr(fulltext, "ENTRIES_AT_A_TIME", at_a_time)
    asked, universe = clauses(spark, QUESTIONS * 2), chunks.select("namespace", "kind", "id")
    matches = fts_match(build_postings(chunks, "simple"), asked, universe)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" not in plan.split("Generate explode")[0].split("BroadcastExchange")[0]
    assert plan.count("hashpartitioning(namespace#") == 1
    got = sorted(map(str, fts_rank(matches).collect()))
    monkeypatch.setattr(fulltext, "few_lexemes", lambda clauses: None)
    assert got == sorted(map(str, fts_rank(fts_match(build_postings(chunks, "simple"), asked, universe)).collect()))


@pytest.mark.parametrize("k", [20, 2])
def test_seeds_of_very_many_chunks_move_postings_once(spark, chunks, index, monkeypatch, k):
    monkeypatch.setattr(X, "LOOKED_UP", 0)
    monkeypatch.setattr(X, "FIRST_ROWS", 10)
    monkeypatch.setattr(X, "_touched", None)
    asked = clauses(spark, QUESTIONS)
    every = fts_topk(fts_rank(fts_match(build_postings(chunks, "simple"), asked, chunks.select("namespace", "kind", "id"))), k)
    assert listed(X.text_topk(index, asked, k, chunks, "simple")) == listed(every)


def test_index_files_hold_ids_in_half_their_length(spark, chunks, tmp_path):
    """Ids are hashes: without an entropy coder every posting takes all 64 digits of its chunk's."""
    hashed = chunks.withColumn("id", F.sha2("id", 256))
    X.write_text_index(build_postings(hashed, "simple"), str(tmp_path / "i"), 4)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "i" / "lexemes").rglob("*.parquet")]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    ids = [g.column(c) for g in groups for c in range(g.num_columns) if g.column(c).path_in_schema == "id"]
    assert sum(c.total_compressed_size for c in ids) < 0.7 * sum(c.total_uncompressed_size for c in ids)


def test_postings_stay_where_they_are_made(spark, tmp_path, monkeypatch):
    """Writing an index moves no postings; a file holds each id once, and no more files of a slot than are allowed."""
    monkeypatch.setattr(X, "FILES_PER_SLOT", 2)
    chunks = spark.range(40_000).select(
        F.lit("n").alias("namespace"), F.lit("code").alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("id"),
        F.concat(F.lit("a b c "), F.col("id")).alias("text")).repartition(5)
    postings = build_postings(chunks, "simple")
    plan = X._by_slot(build_postings(chunks.coalesce(5), "simple"), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning" not in plan
    X.write_text_index(postings, str(tmp_path / "i"), 2)
    files = list((tmp_path / "i" / "lexemes").rglob("*.parquet"))
    assert len(files) == 4
    for file in files:
        words = pq.read_table(str(file), columns=["lexeme"], partitioning=None)["lexeme"].to_pylist()
        assert words == sorted(words)
        group = pq.ParquetFile(file).metadata.row_group(0)
        ids = next(group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == "id")
        assert "PLAIN" not in ids.encodings
    stored = X.read_text_index(spark, str(tmp_path / "i")).postings.select(*postings.columns)
    assert stored.exceptAll(postings).isEmpty() and stored.count() == 160_000
