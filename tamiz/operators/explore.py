"""The exploration report: one small DataFrame per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import is_not_digits, percent
from .cells import Cell, cells_of
from .profile import present_counts
from .samples import RowOrder, first_values

# The exact text counted, and the name fragments looked for.
NO_APLICA = "No Aplica"
DATE_FRAGMENTS = ["fecha", "date"]
MIXED_FRAGMENTS = ["telefono", "codigo", "servicio"]


def _named(cells: list[Cell], value: str) -> Column:
    names = F.array(*[F.lit(c.name) for c in cells])
    return F.get(names, F.col("pos")).alias(value)


def column_types(df: DataFrame) -> DataFrame:
    """``(col_pos, name, dtype)``."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "col_pos int, name string, dtype string")


def null_table(df: DataFrame) -> DataFrame:
    """Columns with nulls, most nulls first; one '#' of the bar is 5 percent."""
    cells = cells_of(df)
    nulls = F.col("n_rows") - F.col("present")
    pct = percent(nulls, F.col("n_rows"), 1)
    return (
        present_counts(df, cells)
        .select("pos", _named(cells, "name"), nulls.alias("nulls"), pct.alias("pct"))
        .where("nulls > 0")
        .withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("pct") / 5).cast("int")))
        .orderBy(F.desc("nulls"), "pos")
        .drop("pos")
    )


def is_date_named(name: str) -> bool:
    return any(part in name.lower() for part in DATE_FRAGMENTS)


def date_columns(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``(name, dtype, example)`` of columns named like a date."""
    cells = [c for c in cells_of(df) if is_date_named(c.name)]
    if not cells:
        return df.sparkSession.createDataFrame([], "name string, dtype string, example string")
    types = F.array(*[F.lit(c.dtype.simpleString()) for c in cells_of(df)])
    examples = first_values(df, cells, 1, order_by).select("pos", F.col("value").alias("example"))
    listed = F.array(*[F.lit(c.pos) for c in cells])
    all_names = cells_of(df)
    return (
        df.sparkSession.range(1)
        .select(F.explode(listed).alias("pos"))
        .join(F.broadcast(examples), "pos", "left")
        .select(_named(all_names, "name"), F.get(types, F.col("pos")).alias("dtype"), "example")
    )


def no_aplica_counts(df: DataFrame) -> DataFrame:
    """``(name, n, pct)`` of text columns that hold the exact text."""
    cells = [c for c in cells_of(df) if isinstance(c.dtype, T.StringType)]
    if not cells:
        return df.sparkSession.createDataFrame([], "name string, n bigint, pct double")
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(c.raw == NO_APLICA).alias(f"n{i}") for i, c in enumerate(cells)],
    )
    rows = F.array(
        *[F.struct(F.lit(c.name).alias("name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cells)]
    )
    return (
        wide.select("n_rows", F.inline(rows))
        .where("n > 0")
        .select("name", "n", percent(F.col("n"), F.col("n_rows"), 1).alias("pct"))
    )


def mixed_columns(df: DataFrame) -> list[str]:
    """Columns whose name suggests that they mix two fields."""
    return [
        c for c in df.columns if "_" in c and any(part in c.lower() for part in MIXED_FRAGMENTS)
    ]


def non_numeric(df: DataFrame, column: str) -> DataFrame:
    """One row: values of a column that are not made of digits."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("present"), F.count_if(is_not_digits(c.cast("string"))).alias("non_numeric")
    )


def missing(df: DataFrame, column: str) -> DataFrame:
    """One row: rows without a value in a column, and their percentage."""
    n = F.count(F.lit(1))
    absent = F.count_if(F.col(column).isNull())
    return df.agg(absent.alias("missing"), percent(absent, n, 1).alias("pct"))


def first_rows(df: DataFrame, columns: list[str], n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First n rows of those columns that exist."""
    present = [c for c in columns if c in df.columns]
    order = RowOrder(df, order_by)
    return order.first(order.keyed(order.head(n), *[F.col(c) for c in present]), n).select(*present)


def executive_summary(df: DataFrame) -> DataFrame:
    """One row with the totals of the report."""
    cells = cells_of(df)
    marked = [F.count_if(c.raw == NO_APLICA) if isinstance(c.dtype, T.StringType) else F.lit(0) for c in cells]
    present = [F.count_if(c.present).alias(f"p{c.pos}") for c in cells]
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *present,
        *[m.cast("bigint").alias(f"m{c.pos}") for m, c in zip(marked, cells)],
    )

    def over(test) -> Column:
        return sum((test(c).cast("int") for c in cells), F.lit(0))

    def pct(c: Cell) -> Column:
        return percent(F.col("rows") - F.col(f"p{c.pos}"), F.col("rows"), 1)

    filled = sum((F.col(f"p{c.pos}") for c in cells), F.lit(0))
    n_cells = F.col("rows") * F.lit(len(cells))
    return wide.select(
        F.col("rows").alias("filas"),
        F.lit(len(cells)).alias("columnas"),
        (n_cells - filled).alias("celdas_nulas"),
        n_cells.alias("celdas"),
        percent(n_cells - filled, n_cells, 1).alias("nulos_pct"),
        over(lambda c: pct(c) > 50).alias("columnas_mas_50pct_nulas"),
        F.lit(sum(is_date_named(c.name) for c in cells)).alias("columnas_fecha"),
        over(lambda c: F.col(f"m{c.pos}") > 0).alias("columnas_no_aplica"),
    )
