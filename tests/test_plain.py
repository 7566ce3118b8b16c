"""Answers off the usual path: large numbers, first rows, changed queries, empty vectors."""

from pyspark.sql import functions as F

from tamiz.operators import chunk, index, retrieve
from tamiz.operators.cells import plain_number
from tamiz.plans.catalog import Catalog
from tamiz.sources.facts import facts_of
from tamiz.sources.table import SourceTable


def test_text_of_doubles(spark):
    values = [0.0, 1.5, 12345678.0, -12345678.25, 1e7, 9999999999999998.0, 1e16, -2.5e20, 1e-3, 0.00012345, -1e-4, 1e-5, 1.5e-7, 1e100]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(plain_number(F.col("v").cast("string")).alias("t"))
    assert [r["t"] for r in rows.collect()] == [repr(v) for v in values]


def test_the_first_row_of_a_key_is_inserted(spark):
    schema = "doc_name string, chunk_id int, text string"
    rows = spark.createDataFrame([("d", 0, "zeta"), ("d", 0, "alfa"), ("e", 0, "b")], schema).coalesce(1)
    known = spark.createDataFrame([("e", 0, "old")], schema)
    assert [tuple(r) for r in index.new_rows(rows, known).collect()] == [("d", 0, "zeta")]


def test_a_changed_query_has_another_fingerprint(spark, folder):
    spark.range(100).write.parquet(f"{folder}/t")
    catalog = Catalog(spark, store=f"{folder}/store")
    mark = lambda df: catalog.fingerprint(SourceTable(df, "parquet", "t"))
    read = lambda: spark.read.parquet(f"{folder}/t")
    assert mark(read().where("id < 50")) == mark(read().where("id < 50")) != mark(read().where("id >= 10"))
    assert mark(spark.range(5).toDF("id")) != mark(spark.range(5).toDF("id"))


def test_empty_vectors_are_passed_over(spark):
    schema = "doc_name string, chunk_id int, embedding array<float>"
    corpus = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, []), ("c", 1, None)], schema)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r["doc_name"] for r in retrieve.top_k(corpus, queries).collect()] == ["a"]


def test_offsets_of_many_chunks(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", ""), ("g", "one")], "doc_name string, text string")
    got = chunk.chunk_text(docs, chunk_size=2, overlap=1).collect()
    assert sum(r["doc_name"] == "d" for r in got) >= 2999
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in got if r["doc_name"] == "d")
    assert [r["text"] for r in got if r["doc_name"] != "d"] == ["one"]


def test_warnings_of_a_load():
    assert facts_of(10, {"a": 10, "b": 0})["warnings"] == ["null_cells=50.0%", "empty_columns=b"]
    assert facts_of(10, {"a": 10, "b": 4})["warnings"] == []
    assert facts_of(0, {"a": 0}, empty_warning=True)["warnings"] == ["no_rows"]
