"""Text corpora and golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_corpus(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``(doc_name, text)``: one row per file, named by its stem."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"(?<=.)\.[^.]*$", "")
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(stem.alias("doc_name"), F.col("value").alias("text"))
    )


def read_golden_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Cases of a golden set with their position ``pos``, from 0."""
    fields = "id categoria pregunta respuesta_esperada fuente_esperada tool_esperada".split()
    cases = spark.read.schema(
        "casos array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    ).json(path, multiLine=True)
    rows = cases.select(F.posexplode("casos").alias("pos", "caso")).select("pos", "caso.*")
    return rows if limit is None else rows.where(F.col("pos") < limit)
