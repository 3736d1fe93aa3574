from pyspark.sql import functions as F

from repoindex.functions import columns as C


def values(spark, items, column):
    rows = [(n, item) for n, item in enumerate(items)]
    df = spark.createDataFrame(rows, "n int, x string").select("n", column(F.col("x")).alias("y"))
    return [row.y for row in df.orderBy("n").collect()]


def test_sanitise(spark):
    assert values(spark, ["data-lake", "A.b c", "ok_1"], C.sanitise) == ["data_lake", "a_b_c", "ok_1"]


def test_keep_path(spark):
    paths = ["src/a.py", "node_modules/x/a.js", "Build/a.py", "a/x.MIN.JS", "a/vendor", "pnpm-lock.yaml", ".env",
             ".github/w/r.yml", "x/.git/config", "a/poetry.lock", "vendors/a.py"]
    assert values(spark, paths, C.keep_path) == [
        True, False, True, False, False, False, True, True, False, False, True]


def test_route_kind(spark):
    paths = ["a/b.d.ts", "__init__.py", "README.MD", "x.json", ".py", "dir.py/x", "a.", "b.tar.yml", "a b.py", "..py"]
    assert values(spark, paths, C.route_kind) == [
        "code", "code", "docs", None, None, None, None, "docs", "code", "code"]


def test_parse_repo_url(spark):
    urls = ["https://h.org/owner/repo", "https://h.org/owner/repo.git//", "repo", "git/x.git.git"]
    got = values(spark, urls, C.parse_repo_url)
    assert [(r.owner, r.repo) for r in got] == [("owner", "repo"), ("owner", "repo"), (None, None), ("git", "x.git")]


def test_has_text_agrees_with_strip(spark):
    texts = ["", " \t\n", "\x1c\x1f\x85\u00a0\u2003\u3000", "a", "\u200b", " . "]
    assert values(spark, texts, C.has_text) == [bool(t.strip()) for t in texts]


def test_decode_utf8_agrees_with_replacement(spark):
    raw = [b"a\r\nb\rc\n", b"\xff\xfeab", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xc3\x28"]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in enumerate(raw)], "n int, b binary")
    got = [r.t for r in df.select("n", C.decode_utf8(F.col("b")).alias("t")).orderBy("n").collect()]
    assert got == [b.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n") for b in raw]


def test_label_and_dirs(spark):
    df = spark.createDataFrame([("p", "a/b.py"), ("", "a/b.py"), (None, "b.py")], "p string, f string")
    got = df.select(C.chunk_label(F.col("p"), F.col("f")), C.parent_dir(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("p/a/b.py", "a"), ("a/b.py", "a"), ("b.py", "")]


def test_iso_time_keeps_fraction_and_offset(spark):
    rows = spark.sql("SELECT timestamp '2024-05-01 10:20:30.123456' AS a, timestamp '2024-05-01 10:20:30' AS b").select(
        C.iso_timestamp(F.col("a")), C.iso_timestamp(F.col("b"))).first()
    assert list(rows) == ["2024-05-01T10:20:30.123456+00:00", "2024-05-01T10:20:30+00:00"]
