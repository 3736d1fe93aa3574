import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from repoindex.operators.chunking import ChunkRule
from repoindex.operators.postings import build_postings
from repoindex.plans.indexing import (
    IndexOptions, failed_namespaces, ingest, ingest_trees, reindex, reindex_trees, sync, tree_files,
)
from repoindex.plans.search import hybrid_store, hybrid_topk
from repoindex.functions import sizing
from repoindex.functions.embedding import embed
from repoindex.schemas import CHUNK_SCHEMA, COMPARE_SCHEMA
from repoindex.sources import store as S
from repoindex.sources.readers import decode_text, read_compare, read_manifests
from repoindex.sources.tree import list_repo, list_trees, read_contents, read_repo
from repoindex.streaming.feed import _last_events, newer_changes, stream_reindex

FILES = "namespace string, file_path string, text string"
OPTIONS = IndexOptions(rules={"code": ChunkRule(20, 0), "docs": ChunkRule(20, 0)}, dim=8, config="simple", buckets=4)


def files_of(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], FILES)


def state(spark, store):
    return sorted((r.namespace, r.file_path, r.chunk_index, r.text) for r in S.read_chunks(spark, store).collect())


def words(spark, store):
    return {(r.id, r.lexeme) for r in S.read_postings(spark, store).collect()}


def fresh_words(spark, store):
    from repoindex.operators.postings import build_postings
    return {(r.id, r.lexeme) for r in build_postings(S.read_chunks(spark, store), "simple").collect()}


def test_missing_store_reads_as_empty(spark, tmp_path):
    missing = S.read_chunks(spark, str(tmp_path / "none"), ["n"])
    assert missing.count() == 0 and missing.drop("bucket").schema.names == CHUNK_SCHEMA.names
    assert S.read_registry(spark, str(tmp_path / "none")).count() == 0


def test_ingest_modes(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, ("Data-Lake", "a.py", "one two three four five"), ("data-lake", "b.md", "x")),
           options=OPTIONS)
    assert [r[:3] for r in state(spark, store)] == [("data_lake", "a.py", 0), ("data_lake", "a.py", 1), ("data_lake", "b.md", 0)]
    again = files_of(spark, ("data-lake", "a.py", "short"))
    ingest(spark, store, again, options=OPTIONS)
    assert [r[1:] for r in state(spark, store)] == [("a.py", 0, "short"), ("a.py", 1, "five"), ("b.md", 0, "x")]
    ingest(spark, store, again, options=OPTIONS)
    assert len(state(spark, store)) == 3
    ingest(spark, store, again, mode="replace", options=OPTIONS)
    assert [r[1:] for r in state(spark, store)] == [("a.py", 0, "short")]
    assert words(spark, store) == fresh_words(spark, store)
    with pytest.raises(Exception, match="duplicate key in batch"):
        ingest(spark, store, again.union(again), options=OPTIONS)
    assert len(state(spark, store)) == 1


def test_reindex(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, *[("n", f"{c}.py", f"old {c}") for c in "abcde"], ("m", "a.py", "m")), options=OPTIONS)
    before = S.current_version(spark, store)
    now = files_of(spark, ("n", "a.py", "new a"), ("n", "f.py", "new f"), ("n", "c.py", "still"), ("n", "vendor/g.py", "g"))
    listed = spark.createDataFrame(
        [("n", "a.py", "changed"), ("n", "a.py", "changed"), ("n", "b.py", "deleted"), ("n", "d.py", "changed"),
         ("n", "f.py", "changed"), ("n", "vendor/g.py", "changed")], "namespace string, file_path string, op string")
    assert reindex(spark, store, now, listed, options=OPTIONS) == before + 1
    want = [("m", "a.py", 0, "m"), ("n", "a.py", 0, "new a"), ("n", "c.py", 0, "old c"), ("n", "e.py", 0, "old e"),
            ("n", "f.py", 0, "new f")]
    assert state(spark, store) == want
    assert words(spark, store) == fresh_words(spark, store)
    reindex(spark, store, now, listed, options=OPTIONS)
    assert state(spark, store) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, *[("n", f"{n}.py", f"t {n}") for n in range(40)], ("m", "a.md", "m")), options=OPTIONS)
    ingest(spark, store, files_of(spark, ("m", "a.md", "again")), options=OPTIONS)
    new = f"{store}/chunks/run={S._run_of(spark, store, 2)}"
    assert [d for d in os.listdir(new) if d.startswith("namespace")] == ["namespace=m"]
    assert len(state(spark, store)) == 41


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, ("n", "a.py", "a")), options=OPTIONS)
    rows = S.read_chunks(spark, store).withColumn("text", F.lit("half"))
    rows.write.partitionBy(*S.BUCKET_KEYS).parquet(f"{store}/chunks/run=lost")
    assert [r[3] for r in state(spark, store)] == ["a"]
    ingest(spark, store, files_of(spark, ("n", "a.py", "b")), options=OPTIONS)
    assert [r[3] for r in state(spark, store)] == ["b"]


def test_sync_isolates_failures(spark, tmp_path):
    def refusing(texts, mode):
        if any("refuse" in t for t in texts):
            raise RuntimeError("refused")
        return [[1.0] * 8 for _ in texts]

    store = str(tmp_path / "s")
    names = ["base", "inc", "bad", "same", "lost"]
    ingest(spark, store, files_of(spark, *[(n, f, "old") for n in names[1:] for f in ("a.py", "b.py")]), options=OPTIONS)
    known = spark.createDataFrame([(n, f"u/{n}", None if n == "base" else "s0", None) for n in names],
                                  "namespace string, repo_url string, last_commit_sha string, last_indexed_at timestamp")
    S.commit(spark, store, registry=known)
    heads = spark.createDataFrame([("base", "s1"), ("inc", "s1"), ("bad", "s1"), ("same", "s0")], "namespace string, sha string")
    diffs = spark.createDataFrame([("inc", 1, 2), ("bad", 1, 1)], "namespace string, ahead_by int, files long")
    listed = spark.createDataFrame([("inc", "a.py", "changed"), ("inc", "b.py", "deleted"), ("bad", "a.py", "changed")],
                                   "namespace string, file_path string, op string")
    trees = files_of(spark, *[(n, "a.py", "refuse" if n == "bad" else "new") for n in names])
    options = IndexOptions(rules=OPTIONS.rules, dim=8, fn=refusing, config="simple", buckets=4)
    report = sync(spark, store, heads, diffs, listed, trees, options=options)
    got = {r.namespace: (r.action, r.status, r.deleted, r.chunks) for r in report.collect()}
    assert got == {"base": ("full_baseline", "ok", 0, 1), "inc": ("incremental", "ok", 2, 1),
                   "bad": ("incremental", "failed", 0, 0), "same": ("up_to_date", "ok", 0, 0),
                   "lost": ("failed", "failed", 0, 0)}
    assert sorted(r.namespace for r in failed_namespaces(report).collect()) == ["bad", "lost"]
    assert [r for r in state(spark, store) if r[0] in ("base", "inc", "bad")] == [
        ("bad", "a.py", 0, "old"), ("bad", "b.py", 0, "old"), ("base", "a.py", 0, "new"), ("inc", "a.py", 0, "new")]
    shas = {r.namespace: r.last_commit_sha for r in S.read_registry(spark, store).collect()}
    assert shas == {"base": "s1", "inc": "s1", "bad": "s0", "same": "s0", "lost": "s0"}


def test_stream_equals_batch_and_replays(spark, tmp_path):
    old = files_of(spark, *[("n", f"{c}.py", f"old {c}") for c in "abc"])
    now = files_of(spark, ("n", "a.py", "new a"), ("n", "b.py", "new b"))
    feed = spark.createDataFrame(
        [("n", "a.py", "deleted", 1, 1), ("n", "a.py", "changed", 2, 2), ("n", "b.py", "changed", 1, 3),
         ("n", "b.py", "deleted", 1, 4)], "namespace string, file_path string, op string, ts int, event_id int")
    feed.coalesce(1).write.parquet(str(tmp_path / "feed"))
    for progress in ("p1", "p2"):
        store = str(tmp_path / "s")
        ingest(spark, store, old, options=OPTIONS) if progress == "p1" else None
        stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
        stream_reindex(stream, now, store, str(tmp_path / progress), options=OPTIONS).awaitTermination()
        assert state(spark, store) == [("n", "a.py", 0, "new a"), ("n", "c.py", 0, "old c")]


def test_tree_scan(spark, tmp_path):
    for path, body in {"__init__.py": b"", ".github/w/r.yml": b"on: push\r\n", "a b.py": b"x\xff", ".env": b"S=1",
                       "node_modules/x/a.js": b"1", "p/package.json": b'{"name": "pkg"}', "p/q/r.ts": b"y"}.items():
        target = tmp_path / "repo" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    root = str(tmp_path / "repo")
    os.symlink(root, f"{root}/loop")
    for per_task in (1, 2, 50):
        found = {r.file_path: r["size"] for r in list_repo(spark, root, "my-repo", per_task).collect()}
        assert set(found) == {"__init__.py", ".github/w/r.yml", "a b.py", ".env", "node_modules/x/a.js",
                              "p/package.json", "p/q/r.ts"} and found[".env"] == 3
    files = decode_text(read_repo(spark, root, "my-repo"))
    assert {r.file_path: r.text for r in files.collect()} == {
        "__init__.py": "", ".github/w/r.yml": "on: push\n", "a b.py": "x\ufffd", "p/package.json": '{"name": "pkg"}',
        "p/q/r.ts": "y"}
    assert [tuple(r) for r in read_manifests(files).collect()] == [("my_repo", "p", "pkg")]


def test_manifests(spark):
    texts = ['{"name": "ok"}', '{"name": ""}', '{"name": "cut"', '["name"]', '{"name": null}', '{"version": 1}',
             '{"name": false}', '{"name": "false"}', '{"name": 7}']
    files = files_of(spark, *[("n", f"d{i}/package.json", t) for i, t in enumerate(texts)], ("n", "d/other.json", texts[0]))
    assert {(r["dir"], r["name"]) for r in read_manifests(files).collect()} == {("d0", "ok"), ("d7", "false"), ("d8", "7")}


def test_comparisons(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"namespace": "n", "ahead_by": 2, "files": [{"status": "renamed", "filename": "b", "previous_filename": "a"},'
        ' {"status": "added", "filename": "c"}]}\n{"namespace": "m", "ahead_by": 0, "files": []}\n')
    got = {tuple(r) for r in read_compare(spark, str(tmp_path / "c.json")).collect()}
    assert got == {("n", 2, "renamed", "b", "a"), ("n", 2, "added", "c", None), ("m", 0, None, None, None)}
    assert COMPARE_SCHEMA.names == ["namespace", "ahead_by", "files"]


def test_search_over_a_store(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, ("n", "cat.py", "the cat sat"), ("n", "dog.py", "dogs run"), ("m", "cat.md", "a cat")),
           options=OPTIONS)
    asked = embed(spark.createDataFrame([(1, "cat")], "query_id long, question string"), "question", mode="query", dim=8)
    chunks, postings = S.read_chunks(spark, store), S.read_postings(spark, store)
    got = hybrid_topk(chunks, postings, asked, namespaces=["N"], config="simple").orderBy("place").collect()
    assert [r.file_path for r in got] == ["cat.py", "dog.py"]
    everything = hybrid_topk(chunks, postings, asked, 2, across_all=True, config="simple").collect()
    assert {r.file_path for r in everything} == {"cat.py", "cat.md"}


def test_duplicates_are_refused_everywhere(spark, tmp_path):
    store = str(tmp_path / "s")
    one = files_of(spark, ("n", "a.py", "a"))
    ingest(spark, store, one, options=OPTIONS, registration=spark.createDataFrame(
        [("N", "u", "s0")], "namespace string, repo_url string, sha string"))
    assert [(r.namespace, r.last_commit_sha) for r in S.read_registry(spark, store).collect()] == [("n", "s0")]
    twice = files_of(spark, ("n", "a.py", "b"), ("N", "a.py", "b"))
    listed = spark.createDataFrame([("N", "a.py", "changed")], "namespace string, file_path string, op string")
    heads = spark.createDataFrame([("N", "s1")], "namespace string, sha string")
    diffs = spark.createDataFrame([("N", 1, 1)], "namespace string, ahead_by int, files int")
    rows = S.read_chunks(spark, store)
    for write in (
        lambda: ingest(spark, store, twice, options=OPTIONS),
        lambda: reindex(spark, store, twice, listed, options=OPTIONS),
        lambda: sync(spark, store, heads, diffs, listed, twice, options=OPTIONS),
        lambda: S.write_chunks(rows.union(rows), store, "simple", 4),
    ):
        with pytest.raises(ValueError, match="duplicate key in batch: n:"):
            write()
    assert [r[3] for r in state(spark, store)] == ["a"]


def test_namespaces_in_any_spelling(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, ("data-lake", "a.py", "a"), ("data-lake", "b.py", "b")), options=OPTIONS,
           registration=spark.createDataFrame([("Data-Lake", "u", "s0"), ("other", "u", "s0")],
                                              "namespace string, repo_url string, sha string"))
    gone = spark.createDataFrame([("Data-Lake", "a.py", "deleted")], "namespace string, file_path string, op string")
    reindex(spark, store, files_of(spark, ("data-lake", "b.py", "b")), gone, options=OPTIONS)
    assert [r[1] for r in state(spark, store)] == ["b.py"]
    changed = spark.createDataFrame([("data-lake", "b.py", "changed")], "namespace string, file_path string, op string")
    report = sync(spark, store, spark.createDataFrame([("DATA-lake", "s1"), ("other", "s1")], "namespace string, sha string"),
                  spark.createDataFrame([("data.lake", 1, 1)], "namespace string, ahead_by int, files int"),
                  changed, files_of(spark, ("Data-Lake", "b.py", "new")), options=OPTIONS, names=["data-lake"])
    assert [(r.namespace, r.status, r.chunks) for r in report.collect()] == [("data_lake", "ok", 1)]
    assert {(r.namespace, r.last_commit_sha) for r in S.read_registry(spark, store).collect()} == {
        ("data_lake", "s1"), ("other", "s0")}
    assert [r[3] for r in state(spark, store)] == ["new"]


def test_a_taken_version_is_refused(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, ("n", "a.py", "a")), options=OPTIONS)
    write_buckets = S._write_buckets

    def slow(*args):
        monkeypatch.setattr(S, "_write_buckets", write_buckets)
        ingest(spark, store, files_of(spark, ("n", "a.py", "first")), options=OPTIONS)
        return write_buckets(*args)

    monkeypatch.setattr(S, "_write_buckets", slow)
    with pytest.raises(RuntimeError, match="another writer"):
        ingest(spark, store, files_of(spark, ("n", "a.py", "second")), options=OPTIONS)
    assert [r[3] for r in state(spark, store)] == ["first"]
    ingest(spark, store, files_of(spark, ("n", "a.py", "third")), options=OPTIONS)
    assert [r[3] for r in state(spark, store)] == ["third"]


def test_searches_by_the_indexes_of_a_store(spark, tmp_path):
    store = str(tmp_path / "s")
    files = files_of(spark, *[("n", f"{n}.py", f"cat number {n}" if n % 3 else f"dog {n}") for n in range(60)])
    ingest(spark, store, files, options=OPTIONS)
    S.write_indexes(spark, store)
    asked = embed(spark.createDataFrame([(1, "cat 7"), (2, "dog or 8"), (3, "-cat")], "query_id long, question string"),
                  "question", mode="query", dim=8)
    exact = hybrid_store(spark, store, asked, config="simple")
    indexed = hybrid_store(spark, store, asked, indexed=True, recall=1.0, config="simple", kinds=["code"])
    assert sorted(map(tuple, indexed.collect())) == sorted(map(tuple, exact.collect())) and exact.count() == 18
    ingest(spark, store, files_of(spark, ("n", "new.py", "new")), options=OPTIONS)
    with pytest.raises(Exception, match="lexemes/at=2"):
        hybrid_store(spark, store, asked, indexed=True)


def test_a_late_event_does_not_win(spark, tmp_path):
    store, feed_path = str(tmp_path / "s"), str(tmp_path / "feed")
    ingest(spark, store, files_of(spark, ("n", "a.py", "old"), ("n", "b.py", "old")), options=OPTIONS)
    schema = "namespace string, file_path string, op string, ts timestamp, event_id long"
    batches = [[("N", "a.py", "changed", 5, 1)], [("n", "a.py", "deleted", 1, 2), ("n", "b.py", "deleted", 2, 3)]]
    now = files_of(spark, ("n", "a.py", "new"))
    for batch in batches:
        rows = spark.createDataFrame(batch, schema.replace("timestamp", "int")).withColumn(
            "ts", F.timestamp_seconds("ts"))
        rows.coalesce(1).write.mode("append").parquet(feed_path)
        stream = spark.readStream.schema(schema).parquet(feed_path)
        stream_reindex(stream, now, store, f"{store}/progress", options=OPTIONS).awaitTermination()
    assert [r[1::2] for r in state(spark, store)] == [("a.py", "new")]


ROOTS = "namespace string, root string"
CHANGES = "namespace string, file_path string, op string"


def lay_out(root, files):
    for path, body in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)


@pytest.fixture
def trees(spark, tmp_path):
    """Two trees, roots in a table with a repeated row, a row without a root, and an empty tree."""
    lay_out(tmp_path / "one", {"p/package.json": '{"name": "outer"}', "p/q/package.json": '{"name": "inner"}',
                               "p/a.py": "a", "p/q/b.py": "b", "p/q/r/c.md": "c", "d.py": "d", "p/blank.py": "  ",
                               "node_modules/x/package.json": '{"name": "x"}', "node_modules/x/e.py": "e", "p/f.bin": "f"})
    lay_out(tmp_path / "two", {"p/a.py": "two", "package.json": '{"name": "top"}'})
    (tmp_path / "empty").mkdir()
    rows = [("Repo-1", "one"), ("repo_1", "one"), ("repo-2", "two"), ("repo-3", "empty")]
    return spark.createDataFrame([(n, str(tmp_path / d)) for n, d in rows] + [("none", None)], ROOTS)


def test_many_trees_in_one_listing(spark, tmp_path, trees):
    want = {("repo_1", "p/a.py", 1), ("repo_1", "d.py", 1), ("repo_2", "p/a.py", 3), ("repo_1", "node_modules/x/e.py", 1)}
    for per_task in (1, 256):
        listing = list_trees(trees, per_task)
        found = [(r.namespace, r.file_path, r["size"]) for r in listing.collect()]
        assert len(found) == len(set(found)) == 12 and want <= set(found)
    assert list_trees(trees.where("false")).count() == 0
    # Further columns are carried, a file that is gone is NULL.
    os.remove(tmp_path / "one" / "d.py")
    read = {(r.namespace, r.file_path): r for r in read_contents(listing.withColumn("mark", F.lit(7))).collect()}
    assert read["repo_2", "p/a.py"].content == b"two" and read["repo_1", "d.py"].content is None
    assert {r.mark for r in read.values()} == {7} and len(read) == 12
    with pytest.raises(Exception, match="FileNotFoundError|No such file"):
        list_trees(spark.createDataFrame([("n", str(tmp_path / "no"))], ROOTS)).count()


def test_a_thousand_roots(spark, tmp_path):
    for n in range(1000):
        lay_out(tmp_path / f"r{n}", {"a.py": str(n)})
    roots = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("namespace"),
                                     F.concat(F.lit(f"{tmp_path}/r"), "id").alias("root"))
    assert {(r.namespace, r.file_path) for r in list_trees(roots).collect()} == {(f"n{n}", "a.py") for n in range(1000)}
    assert {r.text for r in tree_files(roots).collect()} == {str(n) for n in range(1000)}


def test_contents_are_read_once(spark, trees):
    files = tree_files(trees)
    want = {("repo_1", "p/a.py", "outer", "a"), ("repo_1", "p/q/b.py", "inner", "b"), ("repo_1", "p/q/r/c.md", "inner", "c"),
            ("repo_1", "d.py", "", "d"), ("repo_1", "p/blank.py", "outer", "  "), ("repo_2", "p/a.py", "", "two")}
    assert {(r.namespace, r.file_path, r.package, r.text) for r in files.collect()} == want
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_listed_files_are_opened_without_a_walk(spark, tmp_path, trees, monkeypatch):
    from repoindex.plans import indexing
    monkeypatch.setattr(indexing, "list_trees", None)
    (tmp_path / "secret.py").write_text("out")
    listed = spark.createDataFrame(
        [("REPO-1", "p/q/b.py"), ("repo-1", "p/q/b.py"), ("repo-1", "p/gone.py"), ("repo-1", "../secret.py"),
         ("repo-1", str(tmp_path / "secret.py")), ("repo-1", "p/q"), ("repo-2", "p/a.py"), ("lost", "p/a.py"),
         ("repo-1", None)], "namespace string, file_path string")
    got = {(r.namespace, r.file_path, r.package, r.text) for r in tree_files(trees, listed).collect()}
    assert got == {("repo_1", "p/q/b.py", "inner", "b"), ("repo_2", "p/a.py", "", "two")}


def test_trees_into_a_store(spark, tmp_path, trees):
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, ("repo_3", "old.py", "old"), ("repo_1", "gone.py", "gone")), options=OPTIONS)
    ingest_trees(spark, store, trees, "replace", OPTIONS)
    want = [("repo_1", "d.py", 0, "d"), ("repo_1", "p/a.py", 0, "a"), ("repo_1", "p/q/b.py", 0, "b"),
            ("repo_1", "p/q/r/c.md", 0, "c"), ("repo_2", "p/a.py", 0, "two")]
    assert state(spark, store) == want
    lay_out(tmp_path / "one", {"p/a.py": "new", "p/q/b.py": "unlisted"})
    os.remove(tmp_path / "one" / "d.py")
    listed = spark.createDataFrame([("Repo-1", "p/a.py", "changed"), ("Repo-1", "d.py", "changed"),
                                    ("repo-2", "p/a.py", "deleted")], CHANGES)
    reindex_trees(spark, store, trees, listed, OPTIONS)
    assert state(spark, store) == [("repo_1", "p/a.py", 0, "new"), *want[2:4]]
    packages = {r.file_path: r.package for r in S.read_chunks(spark, store).collect()}
    assert packages == {"p/a.py": "outer", "p/q/b.py": "inner", "p/q/r/c.md": "inner"}


def test_state_of_a_feed(spark, tmp_path):
    """Batches of events in any order against the last event by brute force, nulls, ties and a hot path among them."""
    import random
    rng = random.Random(5)
    schema = "namespace string, file_path string, op string, ts long, event_id long"
    events = [("n", "hot.py" if rng.random() < 0.4 else f"{rng.randrange(12)}.py", rng.choice(["changed", "deleted"]),
               rng.choice([None, *range(6)]), n) for n in range(300)]
    events += [("N", "hot.py", "deleted", 5, 299), (None, "x.py", "changed", 1, 1), ("n", None, "changed", 1, 1),
               ("n", "no.py", "changed", None, None)]
    rng.shuffle(events)
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for start in range(0, len(events), 102):
        spark.createDataFrame(events[start:start + 102], schema).coalesce(2).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    newer_changes(stream).writeStream.foreachBatch(keep).outputMode("update").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for row in sorted(spark.read.parquet(out).collect(), key=lambda r: r.batch):
        got[row.file_path] = row.op
    want, least = {}, -(1 << 63)
    for space, name, op, ts, event in events:
        if space and name:
            key = (least if ts is None else ts, least if event is None else event)
            if name not in want or key > want[name][0]:
                want[name] = key, op
    tied = {name for name, (key, _) in want.items()
            if len({e[2] for e in events if e[1] == name and (e[3], e[4]) == key}) > 1}
    assert got.keys() == want.keys() and all(got[n] == want[n][1] for n in want if n not in tied)


def test_few_rows_of_a_hot_path_are_shuffled():
    import pandas as pd
    rows = pd.DataFrame({"namespace": "n", "file_path": ["a", "b"] * 500, "op": "changed", "at": range(1000), "event_id": 1})
    assert [len(part) for part in _last_events(iter([rows, rows]))] == [2, 2]
    assert sorted(next(_last_events(iter([rows])))["at"]) == [998, 999]


def test_asked_health_rows(spark):
    from repoindex.operators.browse import namespace_info
    chunks = spark.createDataFrame([("n", "code", "a.py"), ("n", "docs", "b.md"), ("m", "code", "c.py")],
                                   "namespace string, kind string, file_path string")
    known = spark.createDataFrame([("r", "u", "s", None)], "namespace string, repo_url string, last_commit_sha string, "
                                                           "last_indexed_at timestamp")
    asked = spark.createDataFrame([("N",), ("n",), ("r",), ("Who-Knows",), (None,)], "namespace string")
    got = {r.namespace: (r.repo_url, r.total_chunks) for r in namespace_info(chunks, known, asked).collect()}
    assert got == {"n": (None, 2), "r": ("u", 0), "who_knows": (None, 0)}


def test_postings_are_made_where_texts_have_moved(spark, tmp_path, monkeypatch):
    """Texts are shuffled, not their postings; a large bucket is cut into parts; files lie by lexeme."""
    monkeypatch.setattr(S, "TEXT_PER_TASK", 4000)
    rows = [(f"{n:064x}", [0.0] * 8, f"w{n % 5} x{n % 7} y " * 60, f"f{n % 9}.py", "", n, "n", "code" if n % 2 else "docs")
            for n in range(90)]
    S.write_chunks(spark.createDataFrame(rows, CHUNK_SCHEMA), str(tmp_path), "simple", buckets=2)
    stored = S.read_chunks(spark, str(tmp_path))
    texts = S._spread_by_text(stored)
    assert texts.rdd.getNumPartitions() >= 8 and texts.count() == 90
    columns = ["namespace", "kind", "id", "lexeme", "positions"]
    want = sorted(map(str, build_postings(stored.drop("bucket"), "simple").select(columns).collect()))
    assert sorted(map(str, S.read_postings(spark, str(tmp_path)).select(columns).collect())) == want
    for file in (tmp_path / "postings").rglob("*.parquet"):
        words = pq.read_table(str(file), columns=["lexeme"], partitioning=None)["lexeme"].to_pylist()
        assert words == sorted(words)
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


def test_texts_move_once(spark, tmp_path):
    """Chunk rows are written where they stay and nowhere else; files are cut so that postings are made as they are read."""
    store = str(tmp_path / "s")
    ingest(spark, store, files_of(spark, *[("n", f"{n}.py", f"t {n}") for n in range(20)]), options=OPTIONS)
    reindex(spark, store, files_of(spark, ("n", "3.py", "new")),
            spark.createDataFrame([("n", "3.py", "changed")], "namespace string, file_path string, op string"), options=OPTIONS)
    staged = [pq.ParquetFile(f).schema_arrow.names for f in (tmp_path / "s" / "staging").rglob("*.parquet")]
    assert staged and not any("text" in names for names in staged)
    assert len(state(spark, store)) == 20 and words(spark, store) == fresh_words(spark, store)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_keys_leave_rows_in_place(spark, monkeypatch):
    """More keys than are broadcast go as hashes; where a hash is not enough the keys themselves decide."""
    monkeypatch.setattr(sizing, "is_small", lambda *a, **b: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.createDataFrame([("n", f"{i}", "text") for i in range(20)] + [(None, "1", "text")],
                                     "namespace string, id string, text string")
        keys = rows.where("id < 5").select("namespace", "id").unionByName(
            spark.createDataFrame([("n", None), ("n", "x")], "namespace string, id string"))
        on = ["namespace", "id"]
        without = sorted(map(str, rows.join(keys, on, "left_anti").collect()))
        having = sorted(map(str, rows.join(keys, on, "left_semi").collect()))
        side = sizing.keys_apart(rows, keys, on)
        assert side.hashed and "Exchange hashpartitioning(namespace" not in _plan(side.without(rows))
        assert sorted(map(str, side.without(rows).select(*rows.columns).collect())) == without
        assert sorted(map(str, sizing.having(rows, keys, on).select(*rows.columns).collect())) == having
        monkeypatch.setattr(sizing.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
        side = sizing.keys_apart(rows, keys, on)
        assert not side.hashed and not side.small
        assert sorted(map(str, side.without(rows).select(*rows.columns).collect())) == without
        assert sorted(map(str, sizing.having(rows, keys, on).select(*rows.columns).collect())) == having
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reindex_of_many_paths(spark, tmp_path, monkeypatch):
    """Lists too long to broadcast, as such or as hashes, give the same state."""
    listed = spark.createDataFrame([("n", f"{n}.py", "deleted" if n % 2 else "changed") for n in range(10)],
                                   "namespace string, file_path string, op string")
    states = []
    for n, most in enumerate((None, 1000, 3)):
        if most is not None:
            monkeypatch.setattr(sizing, "is_small", lambda *a, **b: False)
            monkeypatch.setattr(sizing, "MAX_BROADCAST_HASHES", most)
        store = str(tmp_path / f"s{n}")
        ingest(spark, store, files_of(spark, *[("n", f"{n}.py", "an old and long text " * 3) for n in range(15)]), options=OPTIONS)
        ingest(spark, store, files_of(spark, *[("n", f"{n}.py", "mid text") for n in range(12)]), options=OPTIONS)
        reindex(spark, store, files_of(spark, *[("n", f"{n}.py", "new") for n in range(15)]), listed, options=OPTIONS)
        states.append(state(spark, store))
        assert words(spark, store) == fresh_words(spark, store)
    assert states[0] == states[1] == states[2] and len({r[1] for r in states[0]}) == 10


def test_short_files_are_merged(spark, tmp_path, monkeypatch):
    """Kept rows are copied as they lie until a bucket has too many files."""
    monkeypatch.setattr(S, "FILES_PER_BUCKET", 3)
    most = 0
    for n in range(7):
        S.write_chunks(spark.createDataFrame(
            [(f"{n:064x}", [0.0] * 8, f"word{n}", f"f{n}.py", "", 0, "n", "code")], CHUNK_SCHEMA), str(tmp_path), "simple", buckets=1)
        run = S._run_of(spark, str(tmp_path), S.current_version(spark, str(tmp_path)))
        most = max(most, S._space(spark, [f"{tmp_path}/chunks/run={run}"])[0])
    assert most <= 6 and len(state(spark, str(tmp_path))) == 7


def test_kept_rows_stay_where_they_are(spark, tmp_path):
    """A commit writes new rows and the keys of those that go; a bucket most of whose rows are gone is written anew."""
    store, texts = str(tmp_path), {f"{n}.py": f"old {n}" for n in range(6)}
    options = IndexOptions(rules=OPTIONS.rules, dim=8, config="simple", buckets=1)
    ingest(spark, store, files_of(spark, *[("n", p, t) for p, t in texts.items()], ("m", "a.py", "m")), options=options)
    written, holders = [], []
    for n in range(2):
        changed, deleted = f"{2 * n}.py", f"{2 * n + 1}.py"
        texts[changed] = f"new {n}"
        del texts[deleted]
        listed = spark.createDataFrame([("n", changed, "changed"), ("n", deleted, "deleted")], CHANGES)
        version = reindex(spark, store, files_of(spark, ("n", changed, texts[changed])), listed, options=options)
        run = S._run_of(spark, store, version)
        written.append(spark.read.schema(CHUNK_SCHEMA).parquet(f"{store}/chunks/run={run}").count())
        holders.append(S._live(spark, store, run).where("namespace = 'n' AND NOT gone").count())
        assert state(spark, store) == [("m", "a.py", 0, "m"), *sorted(("n", p, 0, t) for p, t in texts.items())]
        assert words(spark, store) == fresh_words(spark, store)
    assert (written, holders) == ([1, 4], [2, 1])


def test_rows_without_an_id_go_by_path(spark, tmp_path):
    schema = "id string, embedding array<float>, text string, file_path string, package string, chunk_index int, namespace string, kind string"
    for n in range(4):
        rows = [(None if n < 2 else f"{n:064x}", [0.0] * 8, f"word{n}", f"f{n}.py", "", 0, "n", "code")]
        S.write_chunks(spark.createDataFrame(rows, schema), str(tmp_path), "simple", buckets=1)
    S.commit(spark, str(tmp_path), deletes=spark.createDataFrame([("N", "f0.py"), ("n", "f3.py")], "namespace string, file_path string"))
    assert [r[1] for r in state(spark, str(tmp_path))] == ["f1.py", "f2.py"]
    assert {r.lexeme for r in S.read_postings(spark, str(tmp_path)).collect()} == {"word1", "word2"}


@pytest.mark.parametrize("per_byte", [0, 1000])
def test_postings_of_cut_files(spark, tmp_path, monkeypatch, per_byte):
    """Postings are made from small splits of the chunk files, or after a shuffle where texts are very alike."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(S, "TEXT_PER_TASK", 100)
    monkeypatch.setattr(S, "ROW_GROUP", 2000)
    monkeypatch.setattr(S, "TEXT_PER_BYTE", per_byte)
    rows = [(f"{n:064x}", [float(n)] * 8, f"w{n} x{n % 7} y " * 9, f"f{n}.py", "", 0, "n", "code") for n in range(900)]
    S.write_chunks(spark.createDataFrame(rows, CHUNK_SCHEMA), str(tmp_path), "simple", buckets=1)
    assert words(spark, str(tmp_path)) == fresh_words(spark, str(tmp_path)) and len(words(spark, str(tmp_path))) == 2700
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    files = list((tmp_path / "chunks").rglob("*.parquet"))
    assert max(pq.ParquetFile(f).num_row_groups for f in files) > 1


@pytest.mark.parametrize("config", ["simple", "english"])
def test_postings_come_sorted(spark, monkeypatch, config):
    """The rows of build_postings, by keys and lexeme as they are made, without a sort of the rows or by folder."""
    from repoindex.functions import tokens as tokens_module
    from repoindex.operators.postings import sorted_postings

    texts = ["The b É b a1", "", None, "  ", "and the", "zeta Alpha zeta b", "ΑΣ b İx"]
    rows = [(f"{n:064x}" if n else None, text, "n" if n % 2 else None, ("code", "docs", None)[n % 3], n % 4)
            for n, text in enumerate(texts * 3)]
    chunks = spark.createDataFrame(rows, "id string, text string, namespace string, kind string, bucket int").coalesce(1)
    keys = ["namespace", "kind", "bucket"]
    want = sorted(map(str, build_postings(chunks, config).select(*keys, "id", "lexeme", "positions").collect()))
    made = sorted_postings(chunks, config, keys)
    assert "Sort" not in _plan(made)
    found = made.collect()
    assert sorted(map(str, found)) == want
    groups = [tuple(r[c] for c in keys) for r in found]
    assert len(set(groups)) == sum(a != b for a, b in zip([None, *groups], groups))
    for group in set(groups):
        words = [r.lexeme for r, g in zip(found, groups) if g == group]
        assert words == sorted(words)
    monkeypatch.setattr("repoindex.operators.postings.SORTED_TOKENS", 3)
    monkeypatch.setattr(tokens_module, "POSTINGS_AT_A_TIME", 2)
    assert sorted(map(str, sorted_postings(chunks, config, keys).collect())) == want
    assert sorted_postings(chunks.limit(0), config, keys).count() == 0
