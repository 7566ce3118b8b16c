import numpy as np
import pytest

from tamiz.operators import nearest, retrieve as rt

SCHEMA = "doc_name string, chunk_id int, text string, embedding array<float>"


def brute(corpus, queries, k, min_score):
    out = set()
    for qid, q in queries:
        q = np.array(q, float)
        scored = []
        for doc, cid, _, v in corpus:
            v = np.array(v, np.float32).astype(float) if v else None
            if v is None or not v.any() or not q.any():
                continue
            scored.append((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 12), doc, cid))
        for rank, (s, doc, cid) in enumerate(sorted(scored)[:k], 1):
            if -s >= min_score:
                out.add((qid, rank, doc, cid, round(-s, 4)))
    return out


def frames(spark, corpus, queries):
    return (
        spark.createDataFrame(corpus, SCHEMA).repartition(6),
        spark.createDataFrame(queries, "query_id string, embedding array<double>"),
    )


def random_case(seed=0, copies=200):
    rnd = np.random.default_rng(seed)
    corpus = [(f"d{i % 7}", i, f"texto {i}", rnd.normal(size=8).tolist()) for i in range(300)]
    same = rnd.normal(size=8).tolist()
    corpus += [("copia", 1000 + i, "igual", same) for i in range(copies)]
    corpus += [("cero", 5000, "nada", [0.0] * 8), ("nulo", 5001, "nada", None)]
    queries = [(f"q{i}", rnd.normal(size=8).tolist()) for i in range(11)] + [("igual", same), ("cero", [0.0] * 8)]
    return corpus, queries


@pytest.mark.parametrize("k", [1, 5, 50])
def test_against_brute_force_with_ties(spark, k):
    corpus, queries = random_case()
    got = rt.top_k(*frames(spark, corpus, queries), k=k, min_score=0.3).collect()
    assert {tuple(r) for r in got} == brute(corpus, queries, k, 0.3)


def test_many_queries_meet_the_corpus_in_tiles(spark, monkeypatch):
    corpus, queries = random_case(3)
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", 300)
    monkeypatch.setattr(nearest, "MAX_CELLS", 100)
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 8 * 3)
    monkeypatch.setattr(nearest, "TILE_ROWS", 100)
    got = rt.top_k(*frames(spark, corpus, queries), k=4, min_score=0.0).collect()
    assert {tuple(r) for r in got} == brute(corpus, queries, 4, 0.0)


def test_threshold_before_or_after_rounding(spark):
    corpus = [("a", 0, "t", [0.29996, float(np.sqrt(1 - 0.29996**2))])]
    c, q = frames(spark, corpus, [("q", [1.0, 0.0])])
    assert rt.top_k(c, q, min_score=0.3).count() == 0
    hit = rt.top_k(c, q, min_score=0.3, threshold="rounded").first()
    assert hit["score"] == 0.3


def test_wrong_dimension_is_an_error(spark):
    c, q = frames(spark, [("a", 0, "t", [1.0, 2.0, 3.0])], [("q", [1.0, 0.0])])
    with pytest.raises(Exception, match="vectors of 2 values expected"):
        rt.top_k(c, q).collect()


def test_no_queries(spark):
    c, q = frames(spark, [("a", 0, "t", [1.0])], [("q", [1.0])])
    assert rt.top_k(c, q.limit(0)).count() == 0


def test_context_results_and_check(spark):
    corpus = [("uno", 0, "A", [1.0, 0.0]), ("dos", 3, "B", [0.6, 0.8])]
    c, q = frames(spark, corpus, [("q1", [1.0, 0.0]), ("q2", [-1.0, 0.0])])
    hits = rt.retrieve(c, q, k=5, min_score=0.3)
    context = {r["query_id"]: r["context"] for r in rt.context_blocks(hits, q).collect()}
    assert context["q1"] == (
        "[FUENTE 1] Documento: uno | Fragmento #0 | Relevancia: 1.00\nA\n\n---\n\n"
        "[FUENTE 2] Documento: dos | Fragmento #3 | Relevancia: 0.60\nB"
    )
    assert context["q2"] == "No se encontraron fragmentos relevantes en el corpus de gobernanza."
    results = {r["query_id"]: r for r in rt.search_results(hits, q).collect()}
    assert results["q1"]["n_resultados"] == 2 and results["q1"]["fragmentos"][1]["documento"] == "dos"
    assert results["q2"]["n_resultados"] == 0 and results["q2"]["fragmentos"] == []
    expected = spark.createDataFrame([("q1", "dos"), ("q2", "uno")], "query_id string, expected_doc string")
    check = {r["query_id"]: (r["position"], r["passed"]) for r in rt.retrieval_check(hits, expected).collect()}
    assert check == {"q1": (2, True), "q2": (None, False)}


def test_memory_of_the_first_rows_is_bounded(monkeypatch):
    """No row is below the floor yet: all of them are candidates of each query."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_000, 8))
    x[7] = np.nan
    units, _ = nearest.unit_rows(x[:8])
    units = np.concatenate([units, np.full((1, 8), np.nan), nearest.unit_rows(x[8:])[0]])
    sizes, sort = [], nearest.first_per_query
    monkeypatch.setattr(nearest, "first_per_query", lambda t, k, keys: sizes.append(len(t)) or sort(t, k, keys))
    unit = nearest.unit_rows(rng.normal(size=(300, 8)))[0]
    best = nearest.Best(unit, 4, -1.0, ["id"])
    rows = pa.table({"id": list(range(len(units)))})
    tracemalloc.start()
    best.add(rows, units, np.arange(len(units)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = best.result()
    assert max(sizes) <= 10_000 and peak < 20 << 20
    sims = np.round(unit @ np.nan_to_num(units).T, nearest.TIE_DECIMALS)
    sims[:, np.isnan(units[:, 0])] = -2
    assert found.column("id").to_numpy().reshape(300, 4).tolist() == np.argsort(-sims, axis=1, kind="stable")[:, :4].tolist()
