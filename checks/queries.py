"""One query per operator, over whole tables."""

from __future__ import annotations

import time
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.functions import predicates as P
from tamiz.operators import chunk, evaluate, explore, index, profile, retrieve, throttle, vector_index
from tamiz.operators.cells import cells_of, long_form
from tamiz.operators.profile_store import ProfileStore
from tamiz.session import materialize, new_folder, spread
from tamiz.sources import csv as csv_source, facts
from tamiz.sources.table import SourceTable
from tamiz.streaming.throttle import admitted_stream, capped_stream, clients_in_state, daily_cap_stream, timer_state

from . import derived as D

HOUR = 3600 * throttle.SECOND

# Columns that order the rows of a table, for "the first values".
ORDER = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
    "dirty_events": ["event_id"],
}


def source(spark: SparkSession, sf_dir: str, name: str) -> SourceTable:
    df = D.dirty_events(spark, sf_dir) if name == "dirty_events" else D.table(spark, sf_dir, name)
    return SourceTable(df, "parquet", name, order_by=ORDER[name])


def flat_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "sample_values": F.array_join("sample_values", "|"),
            "quality_flags": F.array_join("quality_flags", ";"),
        }
    )


def profile_of(name: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    t = source(spark, sf_dir, name)
    return flat_columns(profile.profile_columns(t.df, name, order_by=t.order_by, **options))


def profile_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files come in three steps; each is read in its own step alone. The
    profile of all must be that of one pass, distinct values within 5 %."""
    df = materialize(D.dirty_events(spark, sf_dir), "profiled")
    folder, kept = new_folder(spark, "growing"), new_folder(spark, "profile-facts")
    store, parts = ProfileStore(spark, kept, folder), []
    for step in range(3):
        df.where(F.pmod("event_id", F.lit(3)) == step).write.mode("append").parquet(folder)
        before = store.facts()
        known = before.select("file").distinct().count() if before is not None else 0
        parts.append((known, store.update(), store.update()))
    exact = profile.column_counts(df, cells_of(df)).select(F.col("pos").alias("col_pos"), F.col("unique_count").alias("exact"))
    found = store.profile("dirty_events").join(F.broadcast(exact), "col_pos", "left")
    # Files known before a step are not read in it, and nothing is read twice.
    once = all(k == sum(p[1] for p in parts[:i]) and n > 0 and again == 0 for i, (k, n, again) in enumerate(parts))
    return found.select(
        "name", "n_rows", "null_count", "null_pct", "semantic_null_count", "semantic_null_pct",
        "effective_null_pct", "dtype_inferred", "pii_flag", "pii_type",
        (F.abs(F.col("unique_count") - F.coalesce("exact", F.lit(0))) <= 0.05 * F.coalesce("exact", F.lit(0))).alias("unique_near"),
        F.lit(once).alias("read_once"),
    )


CATALOG = ["region", "nation", "customer", "supplier", "part", "orders", "dirty_events"]


def _catalog(spark: SparkSession, sf_dir: str) -> profile.Profile:
    return profile.profile_catalog({n: source(spark, sf_dir, n) for n in CATALOG})


def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).table.select(
        "table_name", "source", "path_or_table", "n_rows", "n_cols", "row_duplicate_count",
        "row_duplicate_pct", F.array_join("pii_columns", ";").alias("pii_columns"),
        F.array_join("quality_flags", ";").alias("quality_flags"), "summary.*",
    )


def profile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profile.profile_table(source(spark, sf_dir, "dirty_events"))
    return profile.digest(made.columns, made.table)


def duplicate_rows_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(D.table(spark, sf_dir, "documents").select("text", "lang"))


def duplicate_rows_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.table(spark, sf_dir, "lineitem")
    return profile.duplicate_rows(t.select("l_partkey", "l_quantity", "l_discount", "l_returnflag"))


def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(D.dirty_events(spark, sf_dir))
    text = [c for c, t in df.dtypes if t == "string"]
    v = F.col("value")
    tests = {
        "semantic_nulls": P.is_semantic_null, "numeric": P.is_numeric_text, "decimal_mark": P.has_decimal_mark,
        "dates": P.is_date_text, "booleans": P.is_boolean_text, "ruts": P.is_rut, "emails": P.is_email,
        "phones": P.is_phone, "date_like": P.is_date_like, "not_digits": P.is_not_digits,
    }
    return long_form(df, "name", {c: F.col(c) for c in text}).groupBy("name").agg(
        F.count(v).alias("present"), *[F.count_if(t(v)).alias(n) for n, t in tests.items()]
    )


def client_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = D.table(spark, sf_dir, "events").selectExpr(
        "CASE event_id % 4 WHEN 0 THEN concat(' 10.0.0.', user_id % 250, ' , 172.16.0.1') WHEN 1 THEN '' END AS xff",
        "CASE WHEN event_id % 8 <> 3 THEN concat('192.168.0.', user_id % 250) END AS host",
    )
    return requests.groupBy(P.client_ip(F.col("xff"), F.col("host")).alias("ip")).agg(
        F.count(F.lit(1)).alias("n")
    )


def csv_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(D.dirty_events(spark, sf_dir))
    return csv_source.column_kinds(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    D.table(spark, sf_dir, "customer").write.option("header", True).option("sep", "|").csv(folder)
    return csv_source.load_csv(spark, folder, glob="*.csv").df


def csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose columns are in another order, one of them with one less."""
    folder, customer = new_folder(spark, "csv"), D.table(spark, sf_dir, "customer")
    orders = [customer.columns, customer.columns[::-1], [c for c in customer.columns if c != "c_acctbal"]]
    for i, columns in enumerate(orders):
        part = customer.where(F.col("c_custkey") % 3 == i).select(columns)
        part.write.mode("append").option("header", True).option("sep", ";|,"[i]).csv(folder)
    return csv_source.load_csv(spark, folder, glob="*.csv").df


def csv_skiprows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that begin with three lines of something else, one of them blank."""
    folder, orders = new_folder(spark, "csv"), D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    above = spark.createDataFrame([(-4, "informe, semanal"), (-3, ""), (-2, "total"), (-1, ",".join(orders.columns))], "o long, value string")
    for i in range(3):
        rows = orders.where(F.col("o_orderkey") % 3 == i).select(F.col("o_orderkey").alias("o"), F.to_csv(F.struct("*")).alias("value"))
        above.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.mode("append").text(folder)
    return csv_source.load_csv(spark, folder, glob="*.txt", skiprows=3).df


def csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over many lines, in quotes."""
    folder, documents = new_folder(spark, "csv"), D.table(spark, sf_dir, "documents").select("doc_id", "text")
    documents.write.options(header=True, quote="'", escape="'").csv(folder)
    return csv_source.load_csv(spark, folder, glob="*.csv", sep=",", options={"quote": "'", "escape": "'"}).df


def load_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = facts.load_metadata(D.dirty_events(spark, sf_dir))
    return made.withColumn("columns_all_null", F.array_join("columns_all_null", ";"))


def separator_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 lines are what separator detection looks at."""
    lines = D.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.slice(F.split("text", "\n"), 1, 20)).alias("line")
    )
    return csv_source.separator_votes(lines, "doc_id")


def null_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.null_table(D.dirty_events(spark, sf_dir))


def date_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.date_columns(D.dirty_events(spark, sf_dir), ORDER["dirty_events"])


def no_aplica_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.no_aplica_counts(D.dirty_events(spark, sf_dir))


def mixed_column_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the columns whose names suggest mixed fields."""
    df = D.dirty_events(spark, sf_dir)
    return explore.first_rows(df, ["event_id", "falta", *explore.mixed_columns(df)], 5, ["event_id"])


def non_numeric_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.non_numeric(D.dirty_events(spark, sf_dir), "monto")


def missing_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.missing(D.dirty_events(spark, sf_dir), "mitad")


def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.executive_summary(D.dirty_events(spark, sf_dir))


# --- chunks and their table ---------------------------------------------------


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_text(D.docs(spark, sf_dir))


def chunk_small_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk.chunk_text(D.docs(spark, sf_dir), chunk_size=40, overlap=15)
    return made.select("doc_name", "chunk_id", "char_start", "char_end", F.md5("text").alias("text_md5"))


def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chunks_per_document(chunk_documents(spark, sf_dir))


def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.documents(chunk_documents(spark, sf_dir))


def _labelled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = D.table(spark, sf_dir, "labels").selectExpr("CAST(doc_id AS STRING) AS doc_name")
    return chunk.chunk_text(D.docs(spark, sf_dir).join(labelled, "doc_name", "left_semi"))


def chunks_to_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, given twice, into a table of the labelled ones."""
    given = chunk_documents(spark, sf_dir)
    made = index.new_rows(given.unionByName(given), _labelled_chunks(spark, sf_dir))
    return made.select("doc_name", "chunk_id", "char_start", "char_end")


def upserted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written to a chunk table: rows added by each step."""
    table = index.ChunkIndex(spark, new_folder(spark, "index"))
    table.create()

    def with_vector(df):
        return df.withColumn("embedding", F.array(F.length("text").cast("float")))

    given = with_vector(chunk_documents(spark, sf_dir))
    steps = [
        ("replace", table.replace(with_vector(_labelled_chunks(spark, sf_dir)))),
        ("insert", table.insert(given)),
        ("again", table.insert(given)),
        ("count", table.count()),
    ]
    return spark.createDataFrame(steps, "step string, n bigint")


def vector_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = D.table(spark, sf_dir, "documents").selectExpr("doc_id AS id")
    right = D.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id")
    return index.pairing(left, right, ["id"])


# --- retrieval ----------------------------------------------------------------


def knn_label_means(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return retrieve.top_k(D.vectors(spark, sf_dir), D.label_queries(spark, sf_dir), **options)


def _vector_index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    made = vector_index.VectorIndex(spark, new_folder(spark, "vector-index"))
    made.build(D.vectors(spark, sf_dir))
    return made


def knn_index_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all cells of an index the result is the exact one."""
    return _vector_index(spark, sf_dir).search(D.label_queries(spark, sf_dir), nprobe=1 << 30)


def knn_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every 20th vector, from the cells measured to do."""
    return _vector_index(spark, sf_dir).search(D.vector_queries(spark, sf_dir), k=10)


def knn_approx_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the exact hits the index finds: nine tenths at least."""
    queries = D.vector_queries(spark, sf_dir)
    exact = retrieve.top_k(D.vectors(spark, sf_dir), queries, k=10)
    found = vector_index.recall(knn_approx(spark, sf_dir), exact)
    return found.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("hits").alias("hits"), (F.sum("found") >= 0.9 * F.sum("hits")).alias("found")
    )


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = D.label_queries(spark, sf_dir)
    hits = retrieve.top_k(D.vectors(spark, sf_dir), queries, k=3, min_score=0.4)
    texts = D.texts(spark, sf_dir)
    return retrieve.with_text(hits, texts, keys=("chunk_id",), at_most=3 * queries.count()), queries


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.context_blocks(*_hits(spark, sf_dir))


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search_results(*_hits(spark, sf_dir)).withColumn(
        "fragmentos", F.to_json("fragmentos")
    )


def retrieval_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = D.label_queries(spark, sf_dir)
    hits = retrieve.top_k(D.vectors(spark, sf_dir), queries, k=5, min_score=0.3)
    expected = queries.selectExpr("query_id", "concat('label_', query_id) AS expected_doc")
    return retrieve.retrieval_check(hits, expected)


# --- evaluation ---------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.case_results(D.cases(spark, sf_dir), D.answers(spark, sf_dir))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).withColumn("tools_usadas", F.array_join("tools_usadas", ","))


def eval_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.global_metrics(_results(spark, sf_dir))


def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.category_metrics(_results(spark, sf_dir))


def eval_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.case_details(_results(spark, sf_dir))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_lines(_results(spark, sf_dir))


def judge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = D.cases(spark, sf_dir).join(D.answers(spark, sf_dir), "id")
    columns = [F.col(c) for c in ("pregunta", "respuesta_esperada", "fuente_esperada", "answer")]
    return both.select("id", evaluate.judge_input(*columns).alias("judge_input"))


def agent_tool_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = D.cases(spark, sf_dir).join(D.answers(spark, sf_dir), "id")
    runs = runs.withColumn("tools_usadas", evaluate.used_tools(F.col("trace")))
    return evaluate.tool_check(runs).groupBy("tool_esperada", "resultado").agg(F.count(F.lit(1)).alias("n"))


# --- rate limits ----------------------------------------------------------------


def throttle_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.attempts(D.log(spark, sf_dir), window=24 * HOUR)


def throttle_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.admitted(D.log(spark, sf_dir), limit=3, window=24 * HOUR)


def throttle_daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.daily_cap(D.log(spark, sf_dir), limit=1, window=6 * HOUR, cap=100)


PARTS = 3


def _streamed(spark: SparkSession, sf_dir: str, late: bool = False, cap: int | None = None) -> DataFrame:
    """The log as a stream that arrives in parts, each a run of the stream on
    the state of the one before. With ``late`` one event in 50 arrives with the
    last part; with ``cap`` the second stage follows each part."""
    log = D.parts_by_time(D.log(spark, sf_dir), PARTS)
    if late:
        log = log.withColumn("part", F.when(F.col("event_id") % 50 == 0, PARTS - 1).otherwise(F.col("part")))
    arrived, out, state, capped = (new_folder(spark, n) for n in ("arrived", "admitted", "stream-state", "capped"))
    log = materialize(log.select("client", "t", "event_id", "part"), "arrivals")
    for part in range(PARTS):
        log.where(F.col("part") == part).drop("part").write.mode("append").parquet(arrived)
        events = spark.readStream.schema(log.drop("part").schema).parquet(arrived)
        first = admitted_stream(events, limit=3, window=24 * HOUR).writeStream.format("parquet")
        first.option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        if cap is not None:
            admissions = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out)
            daily_cap_stream(admissions, capped, cap=cap).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out if cap is None else f"{capped}/flags")


def throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).drop("late")


def throttle_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, late=True)


def throttle_stream_daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, cap=100).drop("batch")


def _capped(spark: SparkSession, arrivals: list[DataFrame], idle_ms: list[int | None]) -> tuple[DataFrame, str]:
    """Both stages as one stream, run once after each arrival; its result and
    its checkpoint."""
    arrived, out, state = (new_folder(spark, n) for n in ("arrived", "capped", "capped-state"))
    for part, idle in zip(arrivals, idle_ms):
        part.write.mode("append").parquet(arrived)
        events = spark.readStream.schema(part.schema).parquet(arrived)
        flags = capped_stream(events, limit=3, window=24 * HOUR, cap=100, idle_ms=idle)
        with timer_state(spark, until_read=True):
            writer = flags.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
            writer.trigger(availableNow=True).start(out).awaitTermination()
        if idle is not None:
            time.sleep(idle / 1000)
    return spark.read.parquet(out), state


def throttle_stream_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in parts by time through both stages in one query."""
    log = materialize(D.parts_by_time(D.log(spark, sf_dir), PARTS), "arrivals")
    arrivals = [log.where(F.col("part") == p).select("client", "t", "event_id") for p in range(PARTS)]
    return _capped(spark, arrivals, [None] * PARTS)[0].drop("late")


def throttle_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with state after those of even numbers have been idle: the ones
    that arrived last."""
    log = D.log(spark, sf_dir)
    arrivals = [log.where("client % 2 = 0"), log.where("client % 2 = 1")]
    state = _capped(spark, arrivals, [1000, None])[1]
    return clients_in_state(spark, state).orderBy("client")


QUERIES = {
    "profile_orders": partial(profile_of, "orders"),
    "profile_customer": partial(profile_of, "customer"),
    "profile_lineitem": partial(profile_of, "lineitem"),
    "profile_documents": partial(profile_of, "documents"),
    "profile_pages": partial(profile_of, "pages"),
    "profile_conversations": partial(profile_of, "conversations"),
    "profile_dirty_events": partial(profile_of, "dirty_events"),
    "profile_incremental": profile_incremental,
    "profile_dirty_events_all_values": partial(profile_of, "dirty_events", sample="all"),
    "table_profiles": table_profiles,
    "profile_digest": profile_digest,
    "duplicate_rows_documents": duplicate_rows_documents,
    "duplicate_rows_lineitem": duplicate_rows_lineitem,
    "value_predicates": value_predicates,
    "client_ips": client_ips,
    "csv_kinds": csv_kinds,
    "csv_round_trip": csv_round_trip,
    "csv_mixed_headers": csv_mixed_headers,
    "csv_skiprows": csv_skiprows,
    "csv_multiline": csv_multiline,
    "load_metadata": load_metadata,
    "separator_votes": separator_votes,
    "null_table": null_table,
    "date_columns": date_columns,
    "no_aplica_counts": no_aplica_counts,
    "mixed_column_examples": mixed_column_examples,
    "non_numeric_amounts": non_numeric_amounts,
    "missing_half": missing_half,
    "executive_summary": executive_summary,
    "chunk_documents": chunk_documents,
    "chunk_small_windows": chunk_small_windows,
    "chunks_per_document": chunks_per_document,
    "indexed_documents": indexed_documents,
    "chunks_to_insert": chunks_to_insert,
    "upserted_index": upserted_index,
    "vector_pairing": vector_pairing,
    "knn_label_means": knn_label_means,
    "knn_min_score": partial(knn_label_means, k=20, min_score=0.25),
    "knn_min_score_rounded": partial(knn_label_means, k=20, min_score=0.25, threshold="rounded"),
    "knn_index_all_cells": knn_index_all_cells,
    "knn_approx": knn_approx,
    "knn_approx_recall": knn_approx_recall,
    "context_blocks": context_blocks,
    "search_results": search_results,
    "retrieval_check": retrieval_check,
    "eval_cases": eval_cases,
    "eval_global": eval_global,
    "eval_by_category": eval_by_category,
    "eval_details": eval_details,
    "eval_report": eval_report,
    "judge_inputs": judge_inputs,
    "agent_tool_check": agent_tool_check,
    "throttle_attempts": throttle_attempts,
    "throttle_admitted": throttle_admitted,
    "throttle_daily_cap": throttle_daily_cap,
    "throttle_stream": throttle_stream,
    "throttle_stream_late": throttle_stream_late,
    "throttle_stream_daily_cap": throttle_stream_daily_cap,
    "throttle_stream_capped": throttle_stream_capped,
    "throttle_stream_state": throttle_stream_state,
}
