import datetime

import pytest
from pyspark.sql import functions as F

from repoindex.operators import browse, changes, registry, upserts
from repoindex.operators.chunk_checks import check_chunks, violations, with_defaults
from repoindex.operators.chunking import ChunkRule, chunk_files
from repoindex.operators.fusion import EMPTY_HINT, best_fused, context_string, prompt_rows, rrf_fuse
from repoindex.operators.packages import nearest_package
from repoindex.schemas import REGISTRY_SCHEMA

PATHS = ["README.md", "src/a.py", "src/x/b.py", "src/x/y/c.py", "docs/d.md"]


def chunks_of(spark, rows):
    return spark.createDataFrame(
        rows, "namespace string, kind string, id string, file_path string, package string, chunk_index int, text string")


@pytest.fixture(scope="module")
def chunks(spark):
    return chunks_of(spark, [
        ("n", "docs" if p.endswith("md") else "code", f"{p}{i}", p, "", i, f"{p} {i}")
        for p in PATHS for i in (1, 0)] + [("m", "docs", "z", "srcX.md", "pkg", 0, "z")])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nearest_package(spark):
    files = spark.createDataFrame([("n", p) for p in ["a.py", "p/a.py", "p/q/r/b.py", "z/c.py"]] + [("m", "p/a.py")],
                                  "namespace string, file_path string")
    manifests = spark.createDataFrame([("n", "", "root"), ("n", "p", "outer"), ("n", "p/q", "inner"), ("n", "z", "")],
                                      "namespace string, dir string, name string")
    got = nearest_package(files, manifests).select("namespace", "file_path", "package")
    assert rows(got) == [("m", "p/a.py", ""), ("n", "a.py", ""), ("n", "p/a.py", "outer"), ("n", "p/q/r/b.py", "inner"),
                         ("n", "z/c.py", "")]


def test_chunk_files(spark):
    files = spark.createDataFrame(
        [("n", "a.py", "x = 1\n" * 10), ("n", "b.md", " \n"), ("n", "c.md", "hello"), ("n", "d.json", "{}")],
        "namespace string, file_path string, text string")
    got = chunk_files(files, {"code": ChunkRule(20, 0), "docs": ChunkRule(20, 0)}).orderBy("id").collect()
    assert {(r.file_path, r.chunk_index, r.kind) for r in got} == {
        *[("a.py", i, "code") for i in range(4)], ("c.md", 0, "docs")}
    assert len({r.id for r in got}) == 5


def test_defaults_and_violations(spark):
    df = spark.createDataFrame([("1", [1.0], "t", "p"), ("2", None, None, "p"), ("3", [1.0, 2.0], "t", "p")],
                               "id string, embedding array<float>, text string, file_path string")
    full = with_defaults(df)
    assert rows(violations(full, 1)) == [
        ("2", "embedding is null"), ("2", "text is null"), ("3", "embedding dimension")]
    assert check_chunks(full.where("id = '1'"), 1).count() == 1
    with pytest.raises(Exception, match="chunk constraint violated: 3"):
        check_chunks(full.where("id = '3'"), 1).collect()


@pytest.mark.parametrize("depth, want", [
    (0, ["README.md"]),
    (1, ["README.md", "docs/", "docs/d.md", "src/", "src/a.py"]),
    (2, ["README.md", "docs/", "docs/d.md", "src/", "src/a.py", "src/x/", "src/x/b.py"]),
    (9, ["README.md", "docs/", "docs/d.md", "src/", "src/a.py", "src/x/", "src/x/b.py", "src/x/y/", "src/x/y/c.py"]),
])
def test_repo_tree(chunks, depth, want):
    assert [r.entry for r in browse.repo_tree(chunks, "n", depth).collect()] == want


def test_listings(chunks):
    assert [r.file_path for r in browse.list_files(chunks, "N", "src/x").collect()] == ["src/x/b.py", "src/x/y/c.py"]
    assert browse.list_files(chunks, "m", "src_").count() == 0
    assert rows(browse.list_namespaces(chunks)) == [("n",)]


def test_get_file_in_chunk_order(spark, chunks):
    asked = spark.createDataFrame([("N", "src/a.py"), ("n", "gone.py")], "namespace string, file_path string")
    assert rows(browse.get_file(chunks, asked)) == [
        ("n", "gone.py", "(No content found for 'gone.py' in namespace 'n')"),
        ("n", "src/a.py", "# src/a.py\n\nsrc/a.py 0\n\n---\n\nsrc/a.py 1")]


def test_namespace_info(spark, chunks):
    known = spark.createDataFrame([("n", "u", None, datetime.datetime(2024, 1, 2, 3, 4, 5)), ("empty", "v", "s", None)],
                                  REGISTRY_SCHEMA)
    got = {r.namespace: r for r in browse.namespace_info(chunks, known).collect()}
    assert (got["n"].code_files, got["n"].code_chunks, got["n"].doc_files, got["n"].total_chunks) == (3, 6, 2, 10)
    assert got["n"].last_indexed_at == "2024-01-02T03:04:05+00:00" and got["n"].last_commit_sha is None
    assert got["m"].repo_url is None and got["m"].total_chunks == 1
    assert got["empty"].total_chunks == 0


def test_upsert_is_idempotent_and_refuses_duplicates(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, x int")
    once = upserts.upsert(base, new, ["id"])
    assert rows(once) == rows(upserts.upsert(once, new, ["id"])) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(Exception, match="duplicate key in batch: b"):
        upserts.upsert(base, new.union(new.where("id = 'b'")), ["id"]).collect()


def test_delete_and_counts(spark, chunks):
    gone = spark.createDataFrame([("n", "src/a.py"), ("n", "src/a.py"), ("n", "none"), ("m", "README.md")],
                                 "namespace string, file_path string")
    assert upserts.delete_paths(chunks, gone).count() == chunks.count() - 2
    got = {(r.namespace, r.file_path): r.deleted for r in upserts.deleted_counts(chunks, gone).collect()}
    assert got == {("n", "src/a.py"): 2, (None, None): 2}


def test_path_lists_split_on_any_space(spark):
    lists = spark.createDataFrame([("data-lake", "a.py  b c.py\n", None), ("x", "", " d ")],
                                  "namespace string, changed string, deleted string")
    assert rows(changes.changes_from_lists(lists)) == [
        ("data_lake", "a.py", "changed"), ("data_lake", "b", "changed"), ("data_lake", "c.py", "changed"),
        ("x", "d", "deleted")]


def test_diff_statuses_and_rename_swap(spark):
    files = spark.createDataFrame(
        [("n", "added", "1", None), ("n", "removed", "2", None), ("n", "copied", "3", None),
         ("n", "renamed", "b", "a"), ("n", "renamed", "a", "b"), ("n", "renamed", "new", "old")],
        "namespace string, status string, filename string, previous_filename string")
    got = changes.effective_changes(changes.classify_diff(files))
    assert {(r.file_path, r.op) for r in got.collect()} == {
        ("1", "changed"), ("2", "deleted"), ("3", "changed"), ("a", "changed"), ("b", "changed"), ("new", "changed"),
        ("old", "deleted")}


def test_too_large_limits(spark):
    diffs = spark.createDataFrame([("a", 250, 299), ("b", 251, 1), ("c", 1, 300), ("d", None, 0)],
                                  "namespace string, ahead_by int, files long")
    assert {r.namespace: r.too_large for r in changes.diff_too_large(diffs).collect()} == {
        "a": False, "b": True, "c": True, "d": False}


def test_sync_plan_order(spark):
    known = spark.createDataFrame(
        [(n, f"u/{n}", s, None) for n, s in [("same", "h"), ("base", None), ("big", "o"), ("none", "o"), ("some", "o"),
                                            ("headless", "o"), ("diffless", "o")]], REGISTRY_SCHEMA)
    heads = spark.createDataFrame([(n, "h") for n in ["same", "base", "big", "none", "some", "diffless"]],
                                  "namespace string, sha string")
    diffs = spark.createDataFrame([("same", 0, 0), ("base", 999, 999), ("big", 1, 300), ("none", 1, 0), ("some", 1, 2),
                                   ("headless", 1, 1)], "namespace string, ahead_by int, files long")
    got = {r.namespace: r.action for r in changes.sync_plan(known, heads, diffs).collect()}
    assert got == {"same": "up_to_date", "base": "full_baseline", "big": "full_too_large", "none": "noop_advance",
                   "some": "incremental", "headless": "failed", "diffless": "failed"}


def test_registry(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], REGISTRY_SCHEMA)
    new = spark.createDataFrame([("data-lake", "u", ""), ("b", "v", "s1")], "namespace string, repo_url string, sha string")
    first = registry.register(empty, new, now)
    assert rows(registry.registered(first)) == [("b", "v", "s1"), ("data_lake", "u", None)]
    moved = registry.advance_sha(first, spark.createDataFrame([("b", "s2"), ("zz", "s")], "namespace string, sha string"), now)
    assert rows(registry.registered(moved, "B")) == [("b", "v", "s2")] and moved.count() == 2


def hit_table(spark, pairs):
    return spark.createDataFrame([(1, "n", "code", i, r) for i, r in pairs],
                                 "query_id long, namespace string, kind string, id string, rn int")


def test_a_hit_in_both_lists_beats_any_in_one(spark):
    fused = rrf_fuse(hit_table(spark, [("first", 1), ("both", 20)]), hit_table(spark, [("both", 20), ("other", 1)]))
    got = best_fused(fused, 3).orderBy("place").collect()
    assert [r.id for r in got] == ["both", "first", "other"]
    assert got[0].score == 0.025 and got[1].score == round(1 / 61 + 1 / 160, 9)


def test_contexts_and_prompts(spark):
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, question string")
    results = spark.createDataFrame(
        [(1, "n", "docs", 1, "d.md", "", "D"), (1, "n", "code", 2, "b.py", "p", "B"), (1, "n", "code", 1, "a.py", "", "A")],
        "query_id long, namespace string, kind string, place int, file_path string, package string, text string")
    contexts = context_string(results, asked)
    assert {r.query_id: r.context for r in contexts.collect()} == {
        1: "# a.py\nA\n\n---\n\n# p/b.py\nB\n\n---\n\n# d.md\nD", 2: EMPTY_HINT}
    history = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")],
                                    "query_id long, turn int, role string, text string")
    got = prompt_rows(contexts, asked, history, "Be brief.").where("query_id = 1").orderBy("part", "turn").collect()
    assert [r.role for r in got] == ["system", "user", "assistant", "user"]
    assert got[0].content.startswith("Be brief.\n\n## Retrieved context\n\n# a.py") and got[-1].content == "why?"
