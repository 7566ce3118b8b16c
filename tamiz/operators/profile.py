"""Column and table profiles."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, predicates as P
from ..session import materialize
from ..sources.table import SourceTable
from .cells import Cell, cells_of, is_semantic_null_key, long_form
from .samples import first_values

# Hashes of repeated rows up to this many (8 MB) are sent to every task.
_MAX_BROADCAST_HASHES = 1_000_000

# Name of a rate, and the predicate it is the share of.
_TEXT_RATES = {
    "date_rate": P.is_date_text,
    "numeric_rate": P.is_numeric_text,
    "boolean_rate": P.is_boolean_text,
}


@dataclass
class Profile:
    """``columns`` has one row per column, ``table`` one row."""

    columns: DataFrame
    table: DataFrame


# --- counts ---------------------------------------------------------------


def column_counts(df: DataFrame, cells: list[Cell]) -> DataFrame:
    """``(pos, present, unique_count, semantic)`` of columns with any value.

    Columns of one type are unpivoted together and grouped by (column, value).
    Equal values meet in the map-side combine, so a value held by a third of
    the rows costs one row per task; and a value is tested for being a semantic
    null once, not once per row.
    """
    families: dict[str, list[Cell]] = {}
    for c in cells:
        families.setdefault(f"{c.family}{'?' if c.is_text else ''}", []).append(c)
    counted = []
    for members in families.values():
        semantic = F.lit(0)
        if members[0].is_text:
            semantic = F.when(is_semantic_null_key(F.col("key")), F.col("n")).otherwise(0)
        keys = df.select(*[c.key.alias(str(c.pos)) for c in members])
        counted.append(
            keys.unpivot([], keys.columns, "pos", "key")
            .where("key IS NOT NULL")
            .groupBy("pos", "key")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy(F.col("pos").cast("int").alias("pos"))
            .agg(
                F.sum("n").alias("present"),
                F.count(F.lit(1)).alias("unique_count"),
                F.sum(semantic).cast("bigint").alias("semantic"),
            )
        )
    return reduce(DataFrame.unionByName, counted)


def approx_column_counts(df: DataFrame, cells: list[Cell]) -> DataFrame:
    """The same with a sketch for ``unique_count``: no shuffle of values."""
    wide = df.agg(
        *[F.count_if(c.present).alias(f"p{c.pos}") for c in cells],
        *[F.approx_count_distinct(c.key).alias(f"u{c.pos}") for c in cells],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c.pos).alias("pos"),
                F.col(f"p{c.pos}").alias("present"),
                F.col(f"u{c.pos}").alias("unique_count"),
            )
            for c in cells
        ]
    )
    counted = wide.select(F.inline(rows))
    texts = {c.pos: c.text for c in cells if c.is_text}
    if not texts:
        return counted.withColumn("semantic", F.lit(0).cast("bigint"))
    semantic = (
        long_form(df, "pos", texts)
        .groupBy("pos")
        .agg(F.count_if(P.is_semantic_null(F.col("value"))).alias("semantic"))
    )
    return counted.join(F.broadcast(semantic), "pos", "left")


def present_counts(df: DataFrame, cells: list[Cell]) -> DataFrame:
    """``(n_rows, pos, present)`` from one scan and one row per task."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(c.present).alias(f"p{c.pos}") for c in cells],
    )
    rows = [F.struct(F.lit(c.pos).alias("pos"), F.col(f"p{c.pos}").alias("present")) for c in cells]
    return wide.select("n_rows", F.inline(F.array(*rows)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, duplicate_rows)``: rows beyond the first equal one.

    Nulls equal nulls and NaN equals NaN. The first pass groups 64-bit hashes
    of the rows; only rows whose hash occurs more than once are then compared
    by value. The hashes of those are sent to every task while they are few, so
    a table with few copies is never shuffled whole. Beyond that all rows are
    grouped by value; copies meet in the map-side combine either way.
    """
    cells = cells_of(df)
    values = df.select(*[c.key.alias(f"v{c.pos}") for c in cells])
    names = values.columns
    # A null is skipped by the hash, so its place is hashed along with it.
    nulls = F.concat(*[F.when(F.col(v).isNull(), "1").otherwise("0") for v in names])
    hashed = values.withColumn("h", F.xxhash64(*names, nulls))
    by_hash = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(by_hash.where("n > 1"), "repeated-rows")
    n_hashes = repeated.count()
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if n_hashes == 0:
        return total.withColumn("duplicate_rows", F.lit(0).cast("bigint"))
    suspects = hashed
    if n_hashes <= _MAX_BROADCAST_HASHES:
        suspects = hashed.join(F.broadcast(repeated.select("h")), "h", "left_semi")
    extra = (
        suspects.groupBy(*names)
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.sum("extra").alias("duplicate_rows"))
    )
    return total.withColumn("one", F.lit(1)).join(
        F.broadcast(extra.withColumn("one", F.lit(1))), "one"
    ).select("n_rows", "duplicate_rows")


# --- rates ----------------------------------------------------------------


def _rate(hit: Column) -> Column:
    return F.avg(hit.cast("int"))


def _phone_rate(value: Column, among: Column) -> Column:
    return F.avg(F.when(among & ~P.is_date_like(value), P.is_phone(value).cast("int")))


def sample_rates(samples: DataFrame) -> DataFrame:
    """Rates per column over its first values (50 for types, 20 for PII)."""
    v = F.col("value")
    for_pii = F.col("rn") <= fixed.PII_SAMPLE
    shown = F.sort_array(
        F.collect_list(F.when(F.col("rn") <= fixed.SHOWN_SAMPLE, F.struct("rn", "value")))
    )
    return samples.groupBy("pos").agg(
        *[_rate(test(v)).alias(name) for name, test in _TEXT_RATES.items()],
        F.max(P.has_decimal_mark(v)).alias("decimal_mark"),
        F.stddev_samp(F.length(v)).alias("length_std"),
        F.avg(F.when(for_pii, P.is_rut(v).cast("int"))).alias("rut_rate"),
        F.avg(F.when(for_pii, P.is_email(v).cast("int"))).alias("email_rate"),
        _phone_rate(v, for_pii).alias("phone_rate"),
        F.transform(shown, lambda s: s["value"]).alias("sample_values"),
    )


def full_rates(df: DataFrame, cells: list[Cell]) -> DataFrame:
    """The same rates over all values, whatever the row order.

    One scan; one row per task and column is shuffled.
    """
    v = F.col("value")
    return (
        long_form(df, "pos", {c.pos: c.text for c in cells})
        .groupBy("pos")
        .agg(
            *[_rate(test(v)).alias(name) for name, test in _TEXT_RATES.items()],
            F.max(P.has_decimal_mark(v)).alias("decimal_mark"),
            F.stddev_samp(F.length(v)).alias("length_std"),
            _rate(P.is_rut(v)).alias("rut_rate"),
            _rate(P.is_email(v)).alias("email_rate"),
            _phone_rate(v, F.lit(True)).alias("phone_rate"),
        )
    )


# --- rules ----------------------------------------------------------------


def inferred_type() -> Column:
    """Ordered rules; the first that holds names the type."""
    unique_share = F.col("unique_count") / F.col("present")
    numeric = F.when(F.col("decimal_mark"), "numeric_float").otherwise("numeric_int")
    few = (F.col("unique_count") <= 20) | (unique_share < 0.05)
    code = (unique_share > 0.95) & F.coalesce(F.col("length_std") < 3, F.lit(False))
    return (
        F.when(F.col("present") == 0, "empty")
        .when(F.col("built_in_type").isNotNull(), F.col("built_in_type"))
        .when(P.has_date_name(F.col("name")) & (F.col("date_rate") >= 0.7), "date")
        .when(F.col("numeric_rate") >= 0.8, numeric)
        .when(F.col("boolean_rate") >= 0.9, "boolean")
        .when(few, "categorical")
        .when(code, "identifier")
        .otherwise("text")
    )


def pii_kind() -> Column:
    """By name first, then by the share of values that match a pattern."""
    return F.coalesce(
        P.pii_by_name(F.col("name")),
        F.when(F.col("rut_rate") >= 0.5, "rut"),
        F.when(F.col("email_rate") >= 0.5, "email"),
        F.when(F.col("phone_rate") >= 0.5, "telefono"),
    )


def _quoted(text: Column) -> Column:
    escaped = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(text.contains("'") & ~text.contains('"'), double).otherwise(single)


def quality_flags() -> Column:
    """Names of the problems of a column, in a fixed order."""
    null_pct, semantic_pct = F.col("null_pct"), F.col("semantic_null_pct")
    kind, stored_as_text = F.col("dtype_inferred"), F.col("is_text")
    first = F.col("sample_values").getItem(0)
    only_value = F.when(F.col("is_text"), _quoted(first)).otherwise(first)
    flags = F.array(
        F.when(null_pct == 100.0, F.lit("columna_100pct_vacia"))
        .when(null_pct >= 80, F.concat(F.lit("alta_tasa_nulos_"), P.whole_percent(null_pct), F.lit("pct")))
        .when(null_pct >= 50, F.concat(F.lit("mayoria_nulos_"), P.whole_percent(null_pct), F.lit("pct"))),
        F.when(
            (semantic_pct > 0) & (null_pct + semantic_pct > null_pct + 5),
            F.concat(F.lit("nulos_semanticos_"), P.whole_percent(semantic_pct), F.lit("pct")),
        ),
        F.when((F.col("unique_pct") == 100.0) & (F.col("n_rows") > 10), F.lit("todos_valores_unicos")),
        F.when(F.col("unique_count") == 1, F.concat(F.lit("un_solo_valor_unico="), only_value)),
        F.when((kind == "date") & stored_as_text, F.lit("fecha_guardada_como_string")),
        F.when(
            kind.isin("numeric_int", "numeric_float") & stored_as_text,
            F.lit("numerico_guardado_como_string"),
        ),
    )
    return F.filter(flags, lambda f: f.isNotNull())


# --- assembly -------------------------------------------------------------


def profile_columns(
    df: DataFrame,
    table_name: str,
    *,
    order_by: list[str] | None = None,
    sample: str = "first",
    approx: bool = False,
    nullable_int_as_float: bool = False,
) -> DataFrame:
    """One row per column of ``df``.

    ``sample="first"`` judges types and PII by the first values in the order of
    ``order_by`` (a total order; file order when None). ``sample="all"`` judges
    by every value. ``approx`` counts distinct values with a sketch.
    """
    if sample not in ("first", "all"):
        raise ValueError("sample is 'first' or 'all'")
    cells = cells_of(df)
    n_shown = fixed.TYPE_SAMPLE if sample == "first" else fixed.SHOWN_SAMPLE
    rates = sample_rates(first_values(df, cells, n_shown, order_by))
    if sample == "all":
        rates = rates.select("pos", "sample_values").join(F.broadcast(full_rates(df, cells)), "pos")

    described = F.array(
        *[
            F.struct(
                F.lit(c.pos).alias("pos"),
                F.lit(c.name).alias("name"),
                F.lit(c.dtype.simpleString()).alias("dtype_physical"),
                F.lit(c.built_in_type).cast("string").alias("built_in_type"),
                F.lit(c.is_text).alias("is_text"),
            )
            for c in cells
        ]
    )
    counts = approx_column_counts(df, cells) if approx else column_counts(df, cells)
    # One row per column from here on: every side is as small as the schema.
    rows = (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select("n_rows", F.inline(described))
        .join(F.broadcast(counts), "pos", "left")
        .join(F.broadcast(rates), "pos", "left")
        .withColumns(
            {
                **{c: F.coalesce(c, F.lit(0)) for c in ("present", "unique_count", "semantic")},
                "sample_values": F.coalesce("sample_values", F.array().cast("array<string>")),
            }
        )
    )
    if nullable_int_as_float:
        had_nulls = (F.col("built_in_type") == "numeric_int") & (F.col("present") < F.col("n_rows"))
        rows = rows.withColumn(
            "built_in_type", F.when(had_nulls, "numeric_float").otherwise(F.col("built_in_type"))
        )
    return judged(rows, table_name)


def judged(rows: DataFrame, table_name: str) -> DataFrame:
    """Profile rows from counts, rates and samples, one row per column each."""
    n = F.col("n_rows")
    rows = rows.withColumns(
        {
            "table_name": F.lit(table_name),
            "null_count": n - F.col("present"),
            "null_pct": P.percent(n - F.col("present"), n),
            "semantic_null_count": F.col("semantic"),
            "semantic_null_pct": P.percent(F.col("semantic"), n),
            "unique_pct": P.percent(F.col("unique_count"), n),
            "dtype_inferred": inferred_type(),
            "pii_type": pii_kind(),
        }
    )
    rows = rows.withColumns(
        {
            "effective_null_pct": F.bround(
                F.least(F.col("null_pct") + F.col("semantic_null_pct"), F.lit(100.0)), 2
            ),
            "pii_flag": F.col("pii_type").isNotNull(),
            "quality_flags": quality_flags(),
        }
    )
    return rows.select(
        "table_name",
        F.col("pos").alias("col_pos"),
        "name",
        "dtype_physical",
        "dtype_inferred",
        "n_rows",
        "null_count",
        "null_pct",
        "semantic_null_count",
        "semantic_null_pct",
        "effective_null_pct",
        "unique_count",
        "unique_pct",
        "sample_values",
        "pii_flag",
        "pii_type",
        "quality_flags",
    )


def summarize_tables(columns: DataFrame, duplicates: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per table from column rows.

    ``duplicates`` is ``(table_name, duplicate_rows)``, ``sources`` is
    ``(table_name, source, path_or_table)``; both have one row per table.
    """

    def having(flag: str) -> Column:
        return F.count_if(F.array_contains("quality_flags", flag))

    per_table = columns.groupBy("table_name").agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).cast("int").alias("n_cols"),
        F.sum("null_count").alias("nulls"),
        F.count_if(F.col("null_count") > 0).alias("columnas_con_nulos"),
        F.count_if(F.col("semantic_null_count") > 0).alias("columnas_con_nulos_semanticos"),
        F.count_if("pii_flag").alias("columnas_pii"),
        having("fecha_guardada_como_string").alias("fechas_como_string"),
        having("columna_100pct_vacia").alias("columnas_vacias"),
        F.count_if(F.size("quality_flags") >= 2).alias("multiple"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("pii_flag"), F.struct("col_pos", "name")))),
            lambda c: c["name"],
        ).alias("pii_columns"),
    )
    n = F.col("n_rows")
    global_pct = P.percent(F.col("nulls"), n * F.col("n_cols"), 1)
    flags = F.array(
        F.when(
            F.col("nulos_pct_global") >= 30,
            F.concat(
                F.lit("alta_tasa_nulos_global_"), F.col("nulos_pct_global").cast("string"), F.lit("pct")
            ),
        ),
        F.when(
            F.col("duplicate_rows") > 0,
            F.concat(F.lit("filas_duplicadas_"), F.col("duplicate_rows").cast("string")),
        ),
        F.when(
            F.col("multiple") > 0,
            F.concat(F.lit("columnas_con_multiples_problemas="), F.col("multiple").cast("string")),
        ),
    )
    return (
        per_table.join(duplicates, "table_name")
        .join(sources, "table_name")
        .withColumn("nulos_pct_global", global_pct)
        .select(
            "table_name",
            "source",
            "path_or_table",
            "n_rows",
            "n_cols",
            F.col("duplicate_rows").alias("row_duplicate_count"),
            P.percent(F.col("duplicate_rows"), n).alias("row_duplicate_pct"),
            "pii_columns",
            F.filter(flags, lambda f: f.isNotNull()).alias("quality_flags"),
            F.struct(
                n.alias("filas"),
                F.col("n_cols").alias("columnas"),
                F.col("duplicate_rows").alias("duplicados_filas"),
                "nulos_pct_global",
                "columnas_con_nulos",
                "columnas_con_nulos_semanticos",
                "columnas_pii",
                "fechas_como_string",
                "columnas_vacias",
            ).alias("summary"),
        )
    )


def _name_of(table: SourceTable) -> str:
    path = table.path_or_table
    if "/" not in path and "\\" not in path:
        return path
    stem, dot, _ = path.rstrip("/").rpartition("/")[2].rpartition(".")
    return stem if dot and stem else path.rstrip("/").rpartition("/")[2]


def profile_catalog(tables: dict[str, SourceTable], **options) -> Profile:
    """Profile many tables; ``columns`` and ``table`` have rows for all.

    Tables are profiled side by side. The column rows, as few as the columns,
    are written to the shared folder, so that the table rows and digests made
    from them do not read the tables again.
    """
    if not tables:
        raise ValueError("no table to profile")
    spark = next(iter(tables.values())).df.sparkSession

    def columns_of(item: tuple[str, SourceTable]) -> DataFrame:
        name, t = item
        made = profile_columns(t.df, name, order_by=t.order_by, **options)
        return materialize(made, "column-profiles")

    def duplicates_of(item: tuple[str, SourceTable]) -> DataFrame:
        name, t = item
        made = duplicate_rows(t.df).select(F.lit(name).alias("table_name"), "duplicate_rows")
        return materialize(made, "duplicate-rows")

    with ThreadPoolExecutor(min(8, 2 * len(tables))) as pool:
        columns = pool.map(columns_of, tables.items())
        duplicates = list(pool.map(duplicates_of, tables.items()))
        all_columns = reduce(DataFrame.unionByName, columns)
    sources = [(name, t.source, t.path_or_table) for name, t in tables.items()]
    origin = spark.createDataFrame(
        sources, "table_name string, source string, path_or_table string"
    )
    table = summarize_tables(
        all_columns, reduce(DataFrame.unionByName, duplicates), F.broadcast(origin)
    )
    return Profile(all_columns, table)


def profile_table(table: SourceTable, table_name: str | None = None, **options) -> Profile:
    return profile_catalog({table_name or _name_of(table): table}, **options)


def digest(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """``(table_name, digest)``: the short JSON report of each table."""
    listed = F.struct(
        "col_pos",
        F.struct(
            F.col("name").alias("nombre"),
            F.col("dtype_inferred").alias("tipo_inferido"),
            F.col("null_pct").alias("nulos_pct"),
            F.col("effective_null_pct").alias("nulos_efectivos_pct"),
            F.col("pii_type").alias("pii"),
            F.col("quality_flags").alias("flags_calidad"),
        ).alias("columna"),
    )
    per_table = columns.groupBy("table_name").agg(
        F.transform(F.sort_array(F.collect_list(listed)), lambda c: c["columna"]).alias("columnas")
    )
    report = F.struct(
        "table_name",
        "source",
        F.struct(F.col("n_rows").alias("filas"), F.col("n_cols").alias("columnas")).alias("shape"),
        F.col("row_duplicate_count").alias("filas_duplicadas"),
        F.col("pii_columns").alias("columnas_pii"),
        F.col("quality_flags").alias("flags_calidad_tabla"),
        F.col("summary").alias("resumen"),
        "columnas",
    )
    return tables.join(per_table, "table_name").select(
        "table_name", F.to_json(report, {"ignoreNullFields": "false"}).alias("digest")
    )
