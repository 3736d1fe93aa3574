import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoindex.functions import tokens
from repoindex.functions.embedding import embed
from repoindex.functions.stemmer import lexeme, stem
from repoindex.operators.fulltext import fts_match, fts_rank, fts_topk, query_clauses
from repoindex.operators.postings import build_postings, lexemes

CHUNKS = [
    ("n", "code", "a", "the cat sat on the mat with a foo-bar"),
    ("n", "code", "b", "a cat ran over running dogs cat"),
    ("n", "docs", "c", "nothing here"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "namespace string, kind string, id string, text string")


def found(spark, chunks, question, config="english"):
    asked = spark.createDataFrame([(1, question)], "query_id long, question string")
    rows = fts_match(build_postings(chunks, config), query_clauses(asked, config),
                     chunks.select("namespace", "kind", "id"))
    return {r.id: r["rank"] for r in fts_rank(rows).collect()}


@pytest.mark.parametrize("word, root", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("gaps", "gap"), ("gas", "gas"), ("kiwis", "kiwi"),
    ("hopping", "hop"), ("hoped", "hope"), ("luxuriated", "luxuri"), ("cry", "cri"), ("by", "by"), ("say", "say"),
    ("generously", "generous"), ("relational", "relat"), ("conditional", "condit"), ("happily", "happili"),
    ("consolingly", "consol"), ("knightly", "knight"), ("skies", "sky"), ("dying", "die"), ("succeed", "succeed"),
    ("national", "nation"), ("communication", "communic"), ("rate", "rate"), ("agreed", "agre"), ("doc2vec", "doc2vec"),
    ("controlling", "control"), ("electrical", "electr"), ("adjustable", "adjust"), ("adoption", "adopt"),
])
def test_stems(word, root):
    assert stem(word) == root


def test_stop_words_have_no_lexeme():
    assert lexeme("the") is None and lexeme("cats") == "cat"


def test_positions_count_stop_words(spark, chunks):
    rows = lexemes(chunks.where("id = 'a'").select("id", "text")).orderBy("pos").collect()
    assert [(r.lexeme, r.pos) for r in rows] == [("cat", 2), ("sat", 3), ("mat", 6), ("foo", 9), ("bar", 10)]


@pytest.mark.parametrize("config", ["simple", "english"])
def test_postings_are_grouped_lexemes(spark, chunks, config):
    grouped = lexemes(chunks, config).groupBy("namespace", "kind", "id", "lexeme").agg(
        F.array_sort(F.collect_list("pos")).alias("positions"))
    want = sorted(map(str, grouped.select("id", "lexeme", "positions").collect()))
    got = sorted(map(str, build_postings(chunks, config).select("id", "lexeme", "positions").collect()))
    assert got == want


def test_all_positions_are_kept(spark):
    long = spark.createDataFrame([("n", "docs", "x", "w " * 300 + "z " * 17000 + "end")],
                                 "namespace string, kind string, id string, text string")
    rows = {r.lexeme: r.positions for r in build_postings(long, "simple").collect()}
    assert rows == {"w": list(range(1, 301)), "z": list(range(301, 17301)), "end": [17301]}
    asked = spark.createDataFrame([(1, '"w z"'), (2, '"z end"')], "query_id long, question string")
    found = fts_match(build_postings(long, "simple"), query_clauses(asked, "simple"))
    assert {r.query_id for r in found.collect()} == {1, 2}


def test_words_far_apart_still_rank(spark):
    texts = [("a", "x " + "o " * 70 + "y"), ("b", "x " + "o " * 90 + "y"), ("c", "x " + "o " * 200 + "y")]
    chunks = spark.createDataFrame([("n", "docs", i, t) for i, t in texts],
                                   "namespace string, kind string, id string, text string")
    asked = spark.createDataFrame([(1, "x y")], "query_id long, question string")
    rows = fts_rank(fts_match(build_postings(chunks, "simple"), query_clauses(asked, "simple"))).collect()
    ranks = {r.id: r["rank"] for r in rows}
    assert ranks["a"] > ranks["b"] > ranks["c"] > 0


@pytest.mark.parametrize("question, ids", [
    ("cat sat", {"a"}), ('"cat sat"', {"a"}), ('"sat cat"', set()), ("cat -sat", {"b"}), ("-cat", {"c"}),
    ("mat or dogs", {"a", "b"}), ("foo-bar", {"a"}), ("the", set()), ("or cat or", {"a", "b"}), ('"cat the mat"', set()),
    ('"sat on the mat"', {"a"}), ("cat -running or nothing", {"a", "c"}), ('cat -"cat sat"', {"b"}), ("", set()),
    ("cat cat cat", {"a", "b"}), ('"cat', {"a", "b"}), ("CAT Running", {"b"}),
])
def test_question_grammar(spark, chunks, question, ids):
    assert set(found(spark, chunks, question)) == ids


def single(x):
    return float(np.float32(x))


def test_ranks(spark, chunks):
    one = 0.1 / 1.64493406685
    assert found(spark, chunks, "cat") == {"a": single(one), "b": single(one * 1.25)}
    near = 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))
    ranks = found(spark, chunks, "cat sat")
    assert ranks == {"a": single(near)} and round(ranks["a"], 6) == 0.099103
    assert found(spark, chunks, "mat or dogs") == {"a": single(one / 2), "b": single(one / 2)}
    assert found(spark, chunks, "-cat") == {"c": 0.0}


def test_topk_ties_by_id(spark):
    ranked = spark.createDataFrame([(1, "n", "code", i, 0.5) for i in "dcba"],
                                   "query_id long, namespace string, kind string, id string, rank double")
    rows = fts_topk(ranked, 2).orderBy("rn").collect()
    assert [(r.id, r.rn) for r in rows] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("config", ["simple", "english"])
def test_batches_are_worked_on_in_parts(spark, monkeypatch, config):
    """Parts of a batch, one with a row of more tokens than a part has and empty rows between, give what the whole gives."""
    rows = [("n", "docs", f"{n}", "" if n % 3 == 1 else f"the w{n % 4} cats w{n % 4} ran " * (n % 5 + 1)) for n in range(40)]
    long = spark.createDataFrame(rows, "namespace string, kind string, id string, text string").coalesce(1)
    whole = (sorted(map(str, build_postings(long, config).collect())), sorted(map(str, embed(long, "text", dim=8).collect())))
    monkeypatch.setattr(tokens, "TOKENS_AT_A_TIME", 7)
    parts = list(tokens.token_parts(np.array([0, 3, 0, 20, 2, 0])))
    assert parts == [(slice(0, 4), slice(0, 23)), (slice(4, 6), slice(23, 25))]
    assert whole == (sorted(map(str, build_postings(long, config).collect())),
                     sorted(map(str, embed(long, "text", dim=8).collect())))
