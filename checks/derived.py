"""Tables derived from the given ones, as DataFrames. ``checks.sql`` has the
same derivations as SQL. Every derived table keeps all rows of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.operators.throttle import as_events
from tamiz.session import materialize, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls, texts that mean null, and values stored as text."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'No Aplica' WHEN 2 THEN ' n/a ' "
        "WHEN 3 THEN 'Desconocido' WHEN 4 THEN '' ELSE event_type END AS estado",
        "CASE WHEN event_id % 10 <> 9 THEN date_format(ts, 'yyyy-MM-dd') END AS fecha_evento",
        "CASE WHEN event_id % 2 = 0 THEN replace(CAST(value AS STRING), '.', ',') "
        "ELSE CAST(value AS STRING) END AS monto",
        "CAST(user_id AS STRING) AS usuario",
        "CASE event_id % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'no' ELSE 'verdadero ' END AS activo",
        "CAST(NULL AS STRING) AS vacia",
        "CASE WHEN event_id % 10 = 0 THEN value END AS casi_vacia",
        "CASE WHEN event_id % 5 < 2 THEN user_id END AS mitad",
        "'fijo' AS constante",
        "concat('+569 ', lpad(CAST(user_id AS STRING), 8, '0')) AS contacto",
        "concat('AB-', lpad(CAST(event_id AS STRING), 9, '0')) AS clave",
        "concat('12.', lpad(CAST(user_id % 1000 AS STRING), 3, '0'), '.678-K') AS documento",
        "concat('u', CAST(user_id AS STRING), '@example.com') AS medio",
        "props AS codigo_servicio",
        "ts AS fecha_hora",
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


def parts_by_time(events: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``, from 0: equal stretches of the time the log spans."""
    t0, t1 = events.agg(F.min("t"), F.max("t")).first()
    return events.withColumn("part", F.expr(f"CAST((t - {t0 or 0}) * {parts} DIV ({t1 or 0} - {t0 or 0} + 1) AS INT)"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("doc_name"), "text"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of the retrieval queries: label and id name a vector."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('label_', label) AS doc_name", "CAST(vec_id AS INT) AS chunk_id", "embedding", "label"
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector as a query."""
    return vectors(spark, sf_dir).where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "embedding")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a vector: the document of the same number, if any."""
    return table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS INT) AS chunk_id", "text")


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean vector of all its rows."""
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    # As many values per label as a vector has. Written once: searching and
    # what is made of the hits both read the queries.
    queries = means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("embedding")
    ).select(F.col("label").alias("query_id"), "embedding")
    return materialize(queries, "label-queries")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS id",
        "lang AS categoria",
        "concat('pregunta ', doc_id) AS pregunta",
        "concat('respuesta de ', source) AS respuesta_esperada",
        "source AS fuente_esperada",
        "CASE WHEN doc_id % 2 = 0 THEN 'search_governance' ELSE 'profile_table' END AS tool_esperada",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judged answers: some verdicts are broken, some runs failed."""
    return table(spark, sf_dir, "labels").selectExpr(
        "CAST(doc_id AS STRING) AS id",
        "concat(' respuesta ', doc_id, '\\n') AS answer",
        "CASE doc_id % 3 WHEN 0 THEN array() WHEN 1 THEN array(named_struct('name', 'search_governance', "
        "'args', '{}', 'ok', true)) ELSE array(named_struct('name', 'profile_table', 'args', '{}', 'ok', true), "
        "named_struct('name', 'list_catalog', 'args', '{}', 'ok', false)) END AS trace",
        "CASE WHEN doc_id % 7 = 0 THEN '{\"correcta\": tru' "
        "WHEN doc_id % 7 = 1 THEN '{\"correcta\": true, \"score\": 3}' "
        "ELSE concat('{\"correcta\": ', IF(quality = 1, 'true', 'false'), ', \"cita_correcta\": ', "
        "IF(toxic = 0, 'true', 'false'), ', \"score\": ', CAST(quality * 9 - 2 + doc_id % 4 AS STRING), "
        "', \"justificacion\": \"caso ', doc_id, '\"}') END AS verdict",
        "CASE WHEN doc_id % 11 = 0 THEN 'cuota agotada' END AS error",
    )
