"""Registered queries of the subpackage on a small scale: contracts, SQL, and the pipeline against its operators."""

import hashlib
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in queries() if n.startswith("op") and n[2].isdigit())
COLUMNS = {
    "op1": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5": ["doc_id", "fingerprint", "component_id"], "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op9": ["doc_id", "held_out", "lang_pred", "score"],
    "op10": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op13": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def rows(spark):
    done = {}

    def run(prefix):
        name = next(n for n in NAMES if n.startswith(prefix + "_"))
        if name not in done:
            df = queries()[name](spark, SF)
            done[name] = df.columns, df.collect()
        return done[name]

    return run


def test_all_are_registered():
    assert [n.split("_")[0] for n in sorted(NAMES, key=lambda n: int(n.split("_")[0][2:]))] == [
        f"op{n}" for n in range(1, 14)]
    assert queries()["pipeline"] is corpus_pipeline.run and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_contract(rows, texts, prefix):
    columns, found = rows(prefix)
    assert columns[:len(COLUMNS[prefix])] == COLUMNS[prefix]
    assert sorted(r.doc_id for r in found) == sorted(texts)


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n in NAMES))
def test_sql(rows, con, name):
    columns, found = rows(name.split("_")[0])
    cursor = con.execute(oracle_sql()[name])
    assert rows_of(columns, found) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_held_out(rows, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    spoken, scored = rows("op9")[1], rows("op6")[1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in spoken)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    right = [r.lang_pred == lang[r.doc_id] for r in spoken if r.held_out]
    assert sum(right) / len(right) > 0.9
    right = [r.predicted == quality[r.doc_id] for r in scored if r.held_out and r.doc_id in quality]
    assert sum(right) / len(right) > 0.8


def test_digests(rows, texts):
    for r in rows("op8")[1]:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in rows("op7")[1]:
        base = [s for s in r.spans.split(",") if s]
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len(base)


def test_edited_texts(rows, texts):
    ordered = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in rows("op13")[1]}
    for doc_id, after in zip(ordered, [*ordered[1:], ordered[0]]):
        third = len(texts[doc_id]) // 3
        edited = texts[doc_id][:len(texts[doc_id]) - third] + texts[after][:third]
        assert found[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[doc_id].n_chars == len(texts[doc_id])
    near = [found[d].near_edited > found[d].near_next for d in ordered if len(texts[d]) > 300]
    assert sum(near) / len(near) > 0.95


def test_pipeline_stages(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, [set(texts)]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = os.fspath(tmp_path / str(number))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert number == 4 or docs.columns == columns
    assert left[1] == left[0] and left[4] == left[5] == left[3]
    groups = {r.doc_id: r.component_id for r in queries()["op5_simhash_vp_trees"](spark, SF).collect()}
    assert left[2] == {d for d, c in groups.items() if d == c}
    hit = {r.doc_id for r in queries()["op10_prefix_filter_decontamination"](spark, SF).collect() if r.contaminated}
    assert left[3] == left[2] - hit
    assert docs.where("NOT exact").count() == 0 and docs.where("text LIKE '%@mail%example.com%'").count() == 0
