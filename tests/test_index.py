import pytest
from pyspark.sql import functions as F

from tamiz.operators import embed, index

COLUMNS = "doc_name string, chunk_id int, text string, char_start int, char_end int, embedding array<float>, n int"


def rows(spark, *keys):
    return spark.createDataFrame([(d, c, f"{d}{c}-{n}", 0, 1, [float(n)], n) for d, c, n in keys], COLUMNS)


@pytest.mark.parametrize("store", ["path", "table"])
def test_insert_once_and_replace(spark, folder, store):
    name = f"{folder}/index" if store == "path" else "chunks_for_test"
    table = index.ChunkIndex(spark, name, store)
    table.create()
    table.create()
    assert table.count() == 0
    given = rows(spark, ("a", 0, 2), ("a", 0, 1), ("b", 0, 3)).repartition(4)
    assert table.insert(given, order="n") == 2
    assert table.insert(rows(spark, ("a", 0, 9), ("c", 1, 4)), order="n") == 1
    found = {(r["doc_name"], r["chunk_id"]): r["embedding"] for r in table.read().collect()}
    assert found == {("a", 0): [1.0], ("b", 0): [3.0], ("c", 1): [4.0]}
    assert [r[0] for r in table.documents().collect()] == ["a", "b", "c"]
    assert table.replace(rows(spark, ("z", 0, 1))) == 1 and table.count() == 1
    table.create(drop_first=True)
    assert table.count() == 0


def test_pairing(spark):
    left, right = rows(spark, ("a", 0, 1), ("a", 1, 1)), rows(spark, ("a", 0, 7), ("b", 0, 7))
    assert index.pairing(left, right).first() == (1, 1, 1)
    with pytest.raises(ValueError, match="1 chunks without a vector"):
        index.pair(left.drop("embedding"), right)
    assert index.pair(left.drop("embedding"), right.where("doc_name = 'a'").unionByName(rows(spark, ("a", 1, 8)))).count() == 2


def test_embedding_keeps_rows_and_order(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "i int, text string")

    def model(texts, task_type):
        assert len(texts) <= 7
        return [[len(t), 1.0 if task_type == embed.QUERY else 0.0] for t in texts]

    got = embed.embed_column(df, model, batch_size=7, task_type=embed.QUERY, max_parallel=3).collect()
    assert all(r["embedding"] == [float(r["i"]), 1.0] for r in got) and len(got) == 50
    with pytest.raises(Exception, match="vectors"):
        embed.embed_column(df, lambda t, _: []).collect()


def test_hashed_embedding_has_unit_length(spark):
    df = spark.createDataFrame([("uno dos dos",), ("tres",)], "text string")
    got = embed.hashed_embedding(df, dim=64).select(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n")
    )
    assert all(abs(r["n"] - 1) < 1e-6 for r in got.collect())
