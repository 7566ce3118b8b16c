"""Documents on their way to training sequences: quality, language,
near-duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns
the columns of documents; the last one returns packed pieces. Rows with null
ids or texts, repeated rows and empty tables pass through every stage: a null
or empty text has no letter and goes with the language stage at the latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.llm import decontaminate, langid, neardup, packing, quality
from tamiz.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with columns ``c0``, ``c1`` and so on, and that of the text:
    what a stage adds can clash with none, and each text goes to a worker once."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    called = "text" if "text" in docs.columns else next(c for c in docs.columns if c.lower() == "text")
    return docs.toDF(*names), names[docs.columns.index(called)]


def _named(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``_numbered`` documents with their own columns and names again."""
    return found.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, accepts.
    Columns of any name keep their values."""
    machine = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    rows, text = _numbered(docs)
    return _named(quality.score_quality(rows, machine, text=text).where("predicted = 1"), docs)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language of the corpus. Columns of any name
    keep their values."""
    languages = langid.fit_languages(docs.select("doc_id", "text", "lang"))
    rows, text = _numbered(docs)
    return _named(langid.identify(rows, languages, text=text).where("NOT rejected"), docs)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 0.8 or more of their five-word shingles
    in common, the one with the smallest id; of rows that repeat an id, the one
    with the smallest text (nulls first), then the smallest row as JSON. Rows
    without id are in no group and stay."""
    linked = neardup.link_documents(docs.select("doc_id", "text"), percent=80)
    kept = linked.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = materialize(kept, "kept-documents")
    once = docs.join(kept.where("rows = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    repeated = docs.join(kept.where("rows > 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    order = F.struct("text", F.to_json(F.struct("*")))
    first = repeated.groupBy("doc_id").agg(F.min_by(F.struct("*"), order).alias("row")).select("row.*")
    return once.unionByName(first).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark. Rows are told apart by
    their id and, if they share it, by a hash of the text. Columns of any name
    keep their values."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("row_key")
    found = decontaminate.decontaminate(
        docs.select(key, "text"), _table(spark, sf_dir, "benchmark"), document="row_key"
    )
    keyed = docs.select(F.struct("*").alias("row"), key)
    return keyed.join(found.where("contaminated").select("row_key"), "row_key", "left_anti").select("row.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids."""
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Fitted models and token ids are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
