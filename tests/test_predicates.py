import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tamiz.functions import fixed, predicates as P

VALUES = [
    "", " ", "\t\n", "No Aplica", " n/a ", "NA", " null ", "sin información", "S/D", "hola", "nd.",
    "1", "-1", "+5", "1e5", "1_000", "1__0", "_1", "1.", ".5", ".", "1,5", "1,234.56", "12d", "12f", "0x1p3", "nan",
    "-Infinity", "INF", "infinit", "1e", "1e+", " 7 ", "1 2",
    "2024-01-02", "1/2/3", "2024.1.2", "20240102", "2024-1", "12345-1-1", " 1-1-1 ", "1-1-12345",
    "true", "FALSE", "Si", "sí", "yes ", "verdadero", "0", "2",
    "12.345.678-K", "12345678-9", "1.234.567-k", "123.456.789-1", "12345678", "1234567-X",
    "a@b.cl", "a.b+c@d-e.org", "a@b", "@b.cl", "a@b.c", "a b@c.cl",
    "+56912345678", "(+562) 2560-5844", "1234567", "123456", "1" * 20, "1" * 21, "12-34-5678", "18-12-2012", "123.4567",
    "x" * 100, " " * 90 + "na" + " " * 90,
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def as_float(v):
    try:
        float(v.replace(",", ".").strip())
        return True
    except ValueError:
        return False


def test_value_predicates_agree_with_python(spark):
    nulls, words = set(fixed.SEMANTIC_NULLS), set(fixed.BOOLEAN_WORDS)

    def matching(pattern):
        return lambda v: re.match(pattern, v.strip(), re.ASCII) is not None

    checks = [
        (P.strip, str.strip),
        (P.is_semantic_null, lambda v: v.lower().strip() in nulls),
        (P.is_numeric_text, as_float),
        (P.has_decimal_mark, lambda v: "." in v or "," in v),
        (P.is_date_text, matching(fixed.DATE_TEXT_PATTERN)),
        (P.is_boolean_text, lambda v: v.lower().strip() in words),
        (P.is_rut, matching(fixed.RUT_PATTERN)),
        (P.is_email, matching(fixed.EMAIL_PATTERN)),
        (P.is_phone, matching(fixed.PHONE_PATTERN)),
        (P.is_date_like, matching(fixed.DATE_LIKE_PATTERN)),
        (P.is_not_digits, lambda v: re.fullmatch("[0-9]+", re.sub("[.-]", "", v)) is None),
    ]
    for expr, want in checks:
        assert column(spark, VALUES, expr) == [want(v) for v in VALUES], expr.__name__


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-_.,eEinfaINFTY \t ", max_size=9), min_size=1, max_size=80))
def test_numeric_text_is_what_float_takes(spark, values):
    assert column(spark, values, P.is_numeric_text) == [as_float(v) for v in values]


def test_pii_by_name_takes_the_first_keyword(spark):
    names = {
        "Email-Corp": "email", "ruta": "rut", "truncated": "rut", "teléfono": "telefono", "dirección": None, "fecha_nac": "fecha_nacimiento",
        "c_name": "nombre", "LastName": "nombre", "correo del run": "rut", "monthly wage": "salario",
        "Direccion": "direccion", "codigo": None, "mailing address": "email",
    }
    assert column(spark, list(names), P.pii_by_name) == list(names.values())


def test_other_names_and_scores(spark):
    paths = ["a/b/clientes.csv", "public.demo", "/x/.hidden", "dir/archivo", "x\\y.tar.gz"]
    assert column(spark, paths, P.table_name_of) == ["clientes", "public.demo", ".hidden", "archivo", "y.tar"]
    scores = ["-3", "0", "1", "4.9", "5", "99"]
    assert column(spark, scores, lambda c: P.clamp_score(c.cast("double"))) == [1, 1, 1, 4, 5, 5]
    hints = ["fecha_x", "UPDATED", "x_dt", "dt_x", "width", "Ingreso", "cierre", "nombre"]
    assert column(spark, hints, P.has_date_name) == [True, True, True, True, False, True, True, False]


def test_client_ip(spark):
    rows = [(" 1.1.1.1 , 2.2.2.2", "h"), ("", "h"), (None, "h"), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "xff string, host string")
    got = [r[0] for r in df.select(P.client_ip(F.col("xff"), F.col("host"))).collect()]
    assert got == ["1.1.1.1", "h", "h", "unknown", "unknown"]


def test_percent_rounds_half_to_even_like_python(spark):
    pairs = [(k, n) for n in (1, 7, 8, 16, 32, 80, 125, 800) for k in range(n + 1)]
    df = spark.createDataFrame(pairs, "k bigint, n bigint")
    for digits in (1, 2):
        got = [r[0] for r in df.select(P.percent(F.col("k"), F.col("n"), digits)).collect()]
        assert got == [round(k / n * 100, digits) for k, n in pairs]
    empty = spark.createDataFrame([(0, 0)], "k bigint, n bigint")
    assert empty.select(P.percent(F.col("k"), F.col("n"))).first()[0] == 0.0
