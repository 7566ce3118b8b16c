import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from checks.compare import connect, difference
from tamiz.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [k for k in range(1, 11) if any(q.startswith(f"op{k}_") for q in QUERIES)] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_next_to_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], ORACLE[name], SF_DIR) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = docs.where("lang = 'en'").orderBy("doc_id").first()["text"]
    passage = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    extra = [(None, text + " more", "en", "s", 1), (90001, None, "en", "s", 0), (90002, "", None, None, None), (90003, "... 12", "en", "s", 6),
             (90004, text, "en", "s", 1), (90004, text, "en", "s", 1), (90005, text + "\n" + passage, "en", "s", 1)]
    now = docs.unionByName(spark.createDataFrame(extra, DOCUMENTS))
    seen = [now]
    for name, stage in P.STAGES:
        now = P.materialize(stage(spark, now, SF_DIR), name)
        if name != "packing":
            assert now.columns == docs.columns
            assert now.exceptAll(seen[-1]).count() == 0
        seen.append(now)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert not {90001, 90002, 90003} & ids[2]
    assert 90004 not in ids[3] or seen[3].where("doc_id = 90004").count() == 1
    assert 90005 not in ids[4]
    assert ids[5] == ids[4]


def test_no_documents(spark):
    now = spark.createDataFrame([], DOCUMENTS)
    for _, stage in P.STAGES:
        now = stage(spark, now, SF_DIR)
    assert now.collect() == []


def test_columns_of_clashing_names_keep_their_values(spark):
    own = ["score", "predicted", "lang_pred", "rejected", "row_key", "row", "rows", "d", "t", "text_hash"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in own], "map('k', doc_id) AS extra")
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns
        rows = kept.selectExpr("doc_id", "extra['k'] AS k", *own).collect()
        assert rows, name
        assert all(r["k"] == r["doc_id"] and all(r[c] == f"{c}{r['doc_id']}" for c in own) for r in rows), name


def test_texts_go_to_a_worker_once(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    sent, given = DataFrame.mapInArrow, []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *rest: given.append(self.schema.simpleString()) or sent(self, f, *rest))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("text", "Text")
    for stage in (P.keep_quality, P.keep_languages):
        kept = stage(spark, docs, SF_DIR)
        assert kept.schema == docs.schema
        assert given[-1].count("string") == docs.schema.simpleString().count("string")


def test_one_row_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "b b b", "x", "s", 2), (1, "a a a", "y", "s", 1), (1, "a a a", "x", "s", 1)], DOCUMENTS)
    assert [tuple(r) for r in P.keep_one_of_copies(spark, docs, SF_DIR).collect()] == [(1, "a a a", "x", "s", 1)]
