import datetime as dt
import decimal
import json

from pyspark.sql import functions as F

from tamiz.operators import profile as pr
from tamiz.sources.table import SourceTable


def profile(spark, df, **options):
    return {r["name"]: r for r in pr.profile_columns(df, "t", **options).collect()}


def texts(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def kind(spark, values, name="v"):
    return profile(spark, texts(spark, values, name), order_by=["i"])[name]["dtype_inferred"]


def test_types_of_text_columns(spark):
    assert kind(spark, [None] * 3) == "empty"
    assert kind(spark, ["2024-01-02"] * 7 + ["x"] * 3, "fecha") == "date"
    assert kind(spark, ["2024-01-02"] * 6 + ["x"] * 4, "fecha") == "categorical"
    assert kind(spark, ["2024-01-02"] * 9, "dia") == "categorical"
    assert kind(spark, ["1", "2", "3", "4", "x"]) == "numeric_int"
    assert kind(spark, ["1", "2", "3", "4,5", "x"]) == "numeric_float"
    assert kind(spark, ["1", "2", "3", "x", "y"]) == "categorical"
    assert kind(spark, ["1", "0", "1"]) == "numeric_int"
    assert kind(spark, ["si"] * 9 + ["quizas"]) == "boolean"
    assert kind(spark, [f"AB{i:04d}" for i in range(60)]) == "identifier"
    assert kind(spark, ["x" * (i % 30) + str(i) + "z" for i in range(60)]) == "text"
    assert kind(spark, [f"v{i % 30}" for i in range(60)]) == "text"
    assert kind(spark, [f"v{i % 30}" for i in range(601)]) == "categorical"


def test_only_the_first_values_decide_and_order_is_explicit(spark):
    df = texts(spark, ["7"] * 50 + ["hola"] * 100).repartition(7)
    assert profile(spark, df, order_by=["i"])["v"]["dtype_inferred"] == "numeric_int"
    assert profile(spark, df, order_by=["i"], sample="all")["v"]["dtype_inferred"] == "categorical"
    assert profile(spark, df.coalesce(1), order_by=["i"])["v"]["sample_values"] == ["7"] * 5


def test_physical_types(spark):
    row = (1, 1.5, True, decimal.Decimal("1.50"), decimal.Decimal("3"), dt.date(2020, 1, 1),
           dt.datetime(2020, 1, 1), [1, 2], {"a": 1}, bytearray(b"x"))
    df = spark.createDataFrame(
        [row], "a smallint, b float, c boolean, d decimal(9,2), e decimal(9,0), f date, g timestamp, "
        "h array<int>, m map<string,int>, b2 binary")
    got = profile(spark, df)
    want = dict(a="numeric_int", b="numeric_float", c="boolean", d="numeric_float", e="numeric_int", f="date", g="date")
    assert {k: got[k]["dtype_inferred"] for k in want} == want
    assert all("string" not in " ".join(got[k]["quality_flags"]) for k in want)
    assert got["h"]["sample_values"] == ["[1,2]"] and got["m"]["unique_count"] == 1


def test_nulls_nan_and_flags(spark):
    n = 20
    rows = [
        (
            None,
            float("nan") if i < 16 else 1.0 * i,
            None if i < 10 else "x",
            "No Aplica" if i < 2 else f"v{i}",
            "it's",
            i,
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "vacia string, alta double, media string, sem string, uno string, id int")
    got = profile(spark, df, order_by=["id"])
    assert got["vacia"]["quality_flags"] == ["columna_100pct_vacia"]
    assert got["alta"]["quality_flags"] == ["alta_tasa_nulos_80pct"]
    assert (got["alta"]["null_count"], got["alta"]["unique_count"]) == (16, 4)
    assert got["media"]["quality_flags"] == ["mayoria_nulos_50pct", "un_solo_valor_unico='x'"]
    assert got["sem"]["quality_flags"] == ["nulos_semanticos_10pct"]
    assert got["sem"]["effective_null_pct"] == 10.0
    assert got["uno"]["quality_flags"] == ['un_solo_valor_unico="it\'s"']
    assert got["id"]["quality_flags"] == ["todos_valores_unicos"]


def test_five_percent_semantic_nulls_are_not_flagged(spark):
    values = ["s/d"] + [f"v{i}" for i in range(19)]
    assert profile(spark, texts(spark, values), order_by=["i"])["v"]["quality_flags"] == ["todos_valores_unicos"]


def test_text_flags(spark):
    got = profile(spark, texts(spark, ["2024-01-02", "2024-01-03"], "fecha"), order_by=["i"])["fecha"]
    assert got["quality_flags"] == ["fecha_guardada_como_string"]
    got = profile(spark, texts(spark, ["1", "2"]), order_by=["i"])["v"]
    assert got["quality_flags"] == ["numerico_guardado_como_string"]


def pii(spark, values):
    return profile(spark, texts(spark, values), order_by=["i"])["v"]["pii_type"]


def test_pii_by_value(spark):
    assert pii(spark, ["12.345.678-K", "x"]) == "rut"
    assert pii(spark, ["12.345.678-K", "x", "y"]) is None
    assert pii(spark, ["a@b.cl"] * 10 + ["x"] * 10 + ["a@b.cl"] * 50) == "email"
    assert pii(spark, ["a@b.cl"] * 9 + ["x"] * 11 + ["a@b.cl"] * 50) is None
    assert pii(spark, ["18-12-2012"] * 19 + ["+56912345678"]) == "telefono"
    assert pii(spark, ["18-12-2012"] * 20) is None
    ints = spark.createDataFrame([(56912345678,)], "v bigint")
    assert profile(spark, ints)["v"]["pii_type"] == "telefono"


def test_sparse_column_beyond_the_head(spark):
    """Values that only occur far behind the first rows are still found."""
    df = spark.range(5000).select(
        F.col("id").alias("i"),
        F.when(F.col("id") >= 3000, F.concat(F.lit("u"), "id", F.lit("@x.cl"))).alias("v"),
    ).repartition(8)
    got = profile(spark, df, order_by=["i"])["v"]
    assert got["sample_values"] == [f"u{i}@x.cl" for i in range(3000, 3005)]
    assert got["pii_type"] == "email"


def test_order_by_time_and_tied_keys(spark):
    df = spark.range(900).selectExpr(
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST((899 - id) / 300 AS INT)) AS ts",
        "id", "CAST(id AS STRING) AS v",
    ).repartition(5)
    for zone in ("UTC", "America/Santiago"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        plain = profile(spark, df, order_by=["ts", "id"])["v"]["sample_values"]
        zoned = df.withColumn("ts", F.col("ts").cast("timestamp"))
        in_zone = profile(spark, zoned, order_by=["ts", "id"])["v"]["sample_values"]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert plain == in_zone == ["600", "601", "602", "603", "604"]


def test_file_order_without_order_by(spark, folder):
    spark.range(1000).select(F.col("id").alias("x")).coalesce(1).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    assert profile(spark, df)["x"]["sample_values"] == ["0", "1", "2", "3", "4"]


def test_duplicate_rows(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (None, "a", float("nan")), (None, "a", float("nan")), (None, None, None),
            (None, None, None), ("1", "a", 1.0), (2, None, 0.0), (None, "2", 0.0)]
    rows = [(None if a is None else int(a), b, c) for a, b, c in rows]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    assert pr.duplicate_rows(df).first() == (9, 3)
    hot = df.limit(1).crossJoin(spark.range(5000).select()).unionByName(df)
    assert pr.duplicate_rows(hot).first()["duplicate_rows"] == 5003
    assert pr.duplicate_rows(df.limit(0)).first() == (0, 0)
    long = spark.createDataFrame([("x" * 500 + str(i % 3),) for i in range(9)], "s string")
    assert pr.duplicate_rows(long).first() == (9, 6)


def test_long_values_are_counted_apart(spark):
    df = spark.createDataFrame([("x" * 300 + str(i % 7),) for i in range(70)], "s string")
    assert profile(spark, df)["s"]["unique_count"] == 7
    assert profile(spark, df, approx=True)["s"]["unique_count"] == 7


def test_nullable_int_as_float(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert profile(spark, df)["a"]["dtype_inferred"] == "numeric_int"
    assert profile(spark, df, nullable_int_as_float=True)["a"]["dtype_inferred"] == "numeric_float"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    made = pr.profile_table(SourceTable(df, "x", "t"))
    assert [r["dtype_inferred"] for r in made.columns.collect()] == ["empty", "empty"]
    t = made.table.first()
    assert (t["n_rows"], t["row_duplicate_pct"], t["summary"]["nulos_pct_global"]) == (0, 0.0, 0.0)


def test_table_row_and_digest(spark):
    rows = [("11.111.111-1", "Ana", "a@x.cl", None, 30)] * 2 + [("22.222.222-2", "Eva", "e@x.cl", "912345678", 40)]
    df = spark.createDataFrame(rows, "rut string, nombre string, email string, telefono string, edad int")
    made = pr.profile_table(SourceTable(df, "postgres", "public.demo"))
    t = made.table.first()
    assert (t["table_name"], t["n_rows"], t["n_cols"], t["row_duplicate_count"]) == ("public.demo", 3, 5, 1)
    assert t["pii_columns"] == ["rut", "nombre", "email", "telefono"]
    assert t["quality_flags"] == ["filas_duplicadas_1", "columnas_con_multiples_problemas=1"]
    d = json.loads(pr.digest(made.columns, made.table).first()["digest"])
    assert d["shape"] == {"filas": 3, "columnas": 5} and d["columnas"][4]["pii"] is None
    assert [c["nombre"] for c in d["columnas"]] == df.columns


def test_table_name_from_path(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert pr.profile_table(SourceTable(df, "csv", "/data/x/clientes.csv")).table.first()["table_name"] == "clientes"
