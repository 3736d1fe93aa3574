import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from repoindex.functions.embedding import embed
from repoindex.functions.vectors import cosine_distance
from repoindex.operators import vector_cells as A, vector_search as V

SCHEMA = "namespace string, kind string, id string, embedding array<double>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((400, 16))
    vectors[7] = vectors[3]
    vectors[9] = 0
    rows = [("n", "code" if n % 3 else "docs", f"{n:04}", [float(x) for x in v]) for n, v in enumerate(vectors)]
    queries = [(q, [float(x) for x in v]) for q, v in enumerate(rng.standard_normal((9, 16)))]
    queries.append((9, rows[3][3]))
    return (spark.createDataFrame(rows, SCHEMA).repartition(5),
            spark.createDataFrame(queries, "query_id long, embedding array<double>"), rows, queries)


def brute_force(rows, queries, k):
    out = set()
    for q, asked in queries:
        for kind in ("code", "docs"):
            ranked = []
            for _, there, name, v in rows:
                if there == kind:
                    length = np.linalg.norm(v) * np.linalg.norm(asked)
                    ranked.append((round(1 - np.dot(v, asked) / length, 9) if length else np.inf, name))
            out |= {(q, kind, name, n + 1) for n, (_, name) in enumerate(sorted(ranked)[:k])}
    return out


def hits(df):
    return {(r.query_id, r.kind, r.id, r.rn) for r in df.collect()}


def test_exact_search(data):
    vectors, queries, rows, asked = data
    assert hits(V.vector_topk(vectors, queries, 5)) == brute_force(rows, asked, 5)


def test_blocks_of_questions_give_the_same(data, monkeypatch):
    vectors, queries, rows, asked = data
    assert hits(V.vector_topk(vectors, queries, 5, block=3)) == brute_force(rows, asked, 5)
    monkeypatch.setattr(V, "BOUND_ROWS", 60)
    assert hits(V.vector_topk(vectors, queries, 5, block=3)) == brute_force(rows, asked, 5)


def test_blocks_of_questions_share_one_sort(data):
    vectors, queries, *_ = data
    index = A.fit_cells(vectors, cells=5)
    for found in (V.vector_topk(vectors, queries, 5, block=2), A.cell_topk(index, queries, 5, probes=5, block=2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") > 3 and plan.count("RunningWindowFunction") + plan.count("Window [") <= 2


def test_many_blocks_of_questions_are_dealt_out(spark, data, monkeypatch):
    vectors, queries, rows, asked = data
    many = asked + [(100 + n, row[3]) for n, row in enumerate(rows[:60])] + [(500, [0.0] * 16)]
    table = spark.createDataFrame(many, queries.schema)
    few = V.vector_topk(vectors, table, 5, block=len(many))
    plan = (found := V.vector_topk(vectors, table, 5, block=2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in few.collect()}
    assert {h for h in hits(found) if h[0] != 500} == brute_force(rows, many[:-1], 5)
    # Vectors in several parts, few cells and exact rows at a time, and more hits than vectors of a kind.
    for name, value in (("MAX_BROADCAST_BYTES", 1 << 14), ("BLOCK_CELLS", 1), ("EXACT_ROWS", 7)):
        monkeypatch.setattr(V, name, value)
    parted = V.vector_topk(vectors, table, 5, block=2)
    assert parted._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 5
    assert {tuple(r) for r in parted.collect()} == {tuple(r) for r in few.collect()}
    monkeypatch.setattr(V, "MAX_BROADCAST_BYTES", 64 << 20)
    assert hits(V.vector_topk(vectors.where("id < '0012'"), table.where("query_id < 150"), 8, block=1)) == brute_force(
        rows[:12], [q for q in many if q[0] < 150], 8)
    twin = vectors.unionByName(vectors)
    assert {tuple(r) for r in V.vector_topk(twin, table, 5, block=2).collect()} == {tuple(r) for r in few.collect()}
    with pytest.raises(ValueError, match="dimension"):
        V.vector_topk(vectors.withColumn("embedding", F.expr("slice(embedding, 1, 3 + int(id) % 2)")), table, block=2)


def test_bound_keeps_tasks_from_sending_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("n", "code", f"{n:05d}", [float(x) for x in rng.standard_normal(8)]) for n in range(4000)]
    vectors = spark.createDataFrame(rows, "namespace string, kind string, id string, embedding array<float>").repartition(40)
    asked = vectors.limit(3).select(F.col("id").cast("long").alias("query_id"), "embedding").toArrow()
    sent = {bounded: V.nearest_rows(vectors, asked, 20, bounded=bounded).count() for bounded in (False, True)}
    assert sent[False] == 3 * 20 * 40 and 60 <= sent[True] < sent[False] / 2


def test_fewer_rows_than_k_and_zero_vectors_last(spark, data):
    vectors, queries, *_ = data
    few = vectors.where("id IN ('0009', '0001')")
    rows = V.vector_topk(few.withColumn("kind", F.lit("code")), queries.where("query_id = 0")).orderBy("rn").collect()
    assert [(r.id, r.dist is None) for r in rows] == [("0001", False), ("0009", True)]


def test_dimension_mismatch_fails(spark, data):
    vectors, queries, *_ = data
    with pytest.raises(PythonException, match="dimension"):
        V.vector_topk(vectors.withColumn("embedding", F.slice("embedding", 1, 4)), queries).collect()


def clustered(spark, size=3000, groups=30, dim=16):
    """Vectors around some directions, of two kinds."""
    rng = np.random.default_rng(11)
    means = rng.standard_normal((groups, dim)) * 3
    rows = []
    for n in range(size):
        vector = means[n % groups] + rng.standard_normal(dim)
        rows.append(("n", "docs" if n % 7 == 0 else "code", f"{n:05d}", [float(x) for x in vector]))
    return spark.createDataFrame(rows, "namespace string, kind string, id string, embedding array<float>")


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "index")
    vectors = clustered(spark)
    zero = vectors.limit(1).withColumns({"id": F.lit("zero"), "embedding": F.transform("embedding", lambda x: x * 0)})
    A.write_cells(A.fit_cells(vectors.union(zero), cells=40), path)
    return vectors.union(zero), A.read_cells(spark, path)


def test_approximate_recall_and_rows_read(spark, cells):
    vectors, index = cells
    asked = vectors.where("id LIKE '%7'").limit(50).select(F.col("id").cast("long").alias("query_id"), "embedding")
    asked = spark.createDataFrame(asked.where("query_id < 600").toArrow())
    found = A.recall_of(A.cell_topk(index, asked), V.vector_topk(vectors, asked)).agg(
        F.sum("found"), F.sum("neighbours")).first()
    assert found[0] >= 0.95 * found[1]
    # Fewer rows than an exact search of fifty questions reads, from pruned folders.
    units = V._unit(V._matrix(asked.toArrow()["embedding"]))
    probes = A.cells_to_read(index, units)
    read = index.rows.where(F.col("cell").isin(list(A.probed_cells(index, units, probes))))
    assert probes < 10 and read.count() < vectors.count()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_reading_all_cells_is_exact(data):
    vectors, queries, rows, asked = data
    index = A.fit_cells(vectors, cells=5)
    assert hits(A.cell_topk(index, queries, 5, probes=5)) == brute_force(rows, asked, 5)
    assert hits(A.cell_topk(index, queries, 5, probes=5, block=4)) == brute_force(rows, asked, 5)
    assert index.rows.where("cell = -1").select("id").collect() == index.rows.where(
        F.forall("embedding", lambda x: x == 0)).select("id").collect()


def test_approximate_search_of_little(spark, data):
    vectors, queries, *_ = data
    nothing = A.fit_cells(vectors.limit(0))
    assert A.cell_topk(nothing, queries, 5).count() == 0
    assert A.cell_topk(A.fit_cells(vectors), queries.limit(0), 5).count() == 0
    one = A.fit_cells(vectors.where("id = '0001'"))
    assert {r.id for r in A.cell_topk(one, queries, 5).collect()} == {"0001"}


def test_sample_is_bounded_and_the_same_in_any_layout(spark):
    vectors = clustered(spark)
    first = A.sample_vectors(vectors, 200).collect()
    assert len(first) == 200 and sorted(map(tuple, first)) == sorted(
        map(tuple, A.sample_vectors(vectors.repartition(9, "id"), 200).collect()))


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]),
                                ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(F.round(cosine_distance(F.col("a"), F.col("b")), 9)).collect()]
    assert got == [1.0, 0.0, None, None]


def test_hash_embedding_is_unit_or_zero(spark):
    df = spark.createDataFrame([("a b a",), ("...",)], "t string")
    rows = embed(df, "t", dim=8).collect()
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-6
    assert rows[1].embedding == [0.0] * 8


def test_backend_batches_and_modes(spark):
    def backend(texts, mode):
        assert len(texts) <= 3
        return [[float(len(texts)), 1.0 if mode == "query" else 0.0] for _ in texts]

    df = spark.createDataFrame([(str(n),) for n in range(10)], "t string").coalesce(1)
    rows = embed(df, "t", backend, mode="query", batch=3, dim=2).collect()
    assert sorted(r.embedding[0] for r in rows) == [1.0] + [3.0] * 9
    assert {r.embedding[1] for r in rows} == {1.0}


def test_backend_errors(spark):
    def backend(texts, mode):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "t string").coalesce(1)
    rows = embed(df, "t", backend, dim=1, null_on_error=True).collect()
    assert {r.t: r.embedding for r in rows} == {"a": [1.0], "bad": None, "b": [1.0]}
    with pytest.raises(PythonException, match="refused"):
        embed(df, "t", backend, dim=1).collect()
    with pytest.raises(PythonException, match="2 numbers"):
        embed(df.where("t = 'a'"), "t", backend, dim=2).collect()
