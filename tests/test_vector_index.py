import numpy as np
import pytest

from tamiz.operators import nearest, retrieve, vector_index as vi

SCHEMA = "doc_name string, chunk_id int, embedding array<float>"


def corpus_rows(n=3000, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(40, dim))
    x = middle[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dim))
    x[rng.permutation(n)[: n // 3]] = x[0]
    rows = [(f"d{i % 9}", i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [("nulo", n, None), ("cero", n + 1, [0.0] * dim), ("vacio", n + 2, [])]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(corpus_rows(), SCHEMA).repartition(6).cache()


@pytest.fixture(scope="module")
def index(spark, corpus):
    from tamiz.session import new_folder

    made = vi.VectorIndex(spark, new_folder(spark, "index-test"))
    made.build(corpus, recall=0.95)
    return made


def queries_of(corpus):
    return corpus.where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "embedding")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_rows_are_stored_once(corpus, index):
    stored = index.rows()
    assert rows_of(stored.select("doc_name", "chunk_id")) == [r[:2] for r in sorted(corpus_rows()[:-3], key=lambda r: (r[0], r[1]))]
    areas = {r["cell"]: r["area"] for r in stored.select("cell", "area").distinct().collect()}
    assert len(areas) == stored.select("cell").distinct().count()


@pytest.mark.parametrize("tiles", [False, True])
def test_over_all_cells_it_is_exact(monkeypatch, corpus, index, tiles):
    if tiles:
        monkeypatch.setattr(nearest, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 12 * 7)
        monkeypatch.setattr(nearest, "TILE_ROWS", 200)
    queries = queries_of(corpus).limit(40)
    exact = rows_of(retrieve.top_k(corpus, queries, k=7, min_score=0.2))
    assert rows_of(index.search(queries, k=7, min_score=0.2, nprobe=10**6)) == exact


def test_recall_is_reached_with_few_cells(corpus, index):
    queries = queries_of(corpus)
    exact = retrieve.top_k(corpus, queries, k=10, min_score=0.0)
    found = index.search(queries, k=10, min_score=0.0)
    total = vi.recall(found, exact).groupBy().sum("found", "hits").first()
    assert total["sum(found)"] >= 0.9 * total["sum(hits)"]
    centroids, _, nprobe = index.cells()
    assert nprobe < 0.2 * len(centroids)
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in exact.collect()}
    assert all(scores.get((r["query_id"], r["chunk_id"]), r["score"]) == r["score"] for r in found.collect())


def test_only_partitions_of_the_probed_cells_are_read(corpus, index):
    query = queries_of(corpus).limit(1)
    found = index.search(query, k=3, nprobe=1)
    files = set(found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0].split(","))
    assert any("area" in f for f in files) and found.count() <= 3


def test_rows_are_added(spark, folder):
    rows = corpus_rows(400, 6, 3)
    made = vi.VectorIndex(spark, f"{folder}/index")
    made.build(spark.createDataFrame(rows[:300], SCHEMA), n_cells=10)
    made.add(spark.createDataFrame(rows[300:], SCHEMA))
    queries = spark.createDataFrame([(1, rows[7][2]), (2, rows[350][2]), (3, [0.0] * 6)], "query_id long, embedding array<double>")
    exact = retrieve.top_k(spark.createDataFrame(rows, SCHEMA), queries, k=9, min_score=0.1)
    assert rows_of(made.search(queries, k=9, min_score=0.1, nprobe=10)) == rows_of(exact)


def test_small_and_empty(spark, folder):
    one = vi.VectorIndex(spark, f"{folder}/one")
    assert one.build(spark.createDataFrame([("a", 1, [1.0, 0.0])], SCHEMA)) == 1
    query = spark.createDataFrame([(5, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert rows_of(one.search(query)) == [(5, 1, "a", 1, 1.0)]
    assert rows_of(one.search(query.limit(0))) == []
    with pytest.raises(ValueError):
        vi.VectorIndex(spark, f"{folder}/none").build(spark.createDataFrame([("a", 1, None)], SCHEMA))


def test_memory_of_the_nearest_cells_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(3)
    units, centroids = rng.normal(size=(3000, 8)), rng.normal(size=(2000, 8))
    tracemalloc.start()
    found = vi.nearest_centroids(units, centroids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = ((units[:50, None] - centroids[None]) ** 2).sum(2)
    assert (found[:50] == np.argsort(far, axis=1)[:, :5]).all()
    assert peak < 50 << 20
