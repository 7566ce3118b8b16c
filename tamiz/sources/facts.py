"""What a load reports about a table: shape, nulls, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import percent
from ..operators.cells import cells_of


def load_metadata(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, global null percentage (the mean of the
    columns' null rates), names of columns without any value."""
    cells = cells_of(df)
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(c.present).alias(f"p{c.pos}") for c in cells],
    )
    n_cells = F.col("n_rows") * F.lit(len(cells))
    filled = sum((F.col(f"p{c.pos}") for c in cells), F.lit(0))
    empty = F.array(*[F.when(F.col(f"p{c.pos}") == 0, F.lit(c.name)) for c in cells])
    return wide.select(
        "n_rows",
        F.lit(len(cells)).alias("n_cols"),
        n_cells.alias("total_cells"),
        percent(n_cells - filled, n_cells).alias("null_pct_global"),
        F.when(F.col("n_rows") > 0, F.filter(empty, lambda n: n.isNotNull()))
        .otherwise(F.array().cast("array<string>"))
        .alias("columns_all_null"),
    )


def facts_of(n_rows: int, present: dict[str, int], empty_warning: bool = False) -> dict:
    """The same as a dict with warnings, from the number of values per column.
    A warning is a code with its number or columns: ``no_rows``, ``null_cells``
    (over 30 %), ``empty_columns``."""
    cells = n_rows * len(present)
    exact = (cells - sum(present.values())) / cells * 100 if cells else 0.0
    empty = [name for name, n in present.items() if n == 0] if n_rows else []
    warnings = []
    if empty_warning and n_rows == 0:
        warnings.append("no_rows")
    if exact > 30:
        warnings.append(f"null_cells={exact:.1f}%")
    if empty:
        warnings.append(f"empty_columns={','.join(empty)}")
    return {
        "shape": {"rows": n_rows, "columns": len(present)},
        "total_cells": cells,
        "null_pct_global": round(exact, 2),
        "columns_all_null": empty,
        "warnings": warnings,
    }


def load_facts(df: DataFrame, empty_warning: bool = False) -> dict:
    """Facts of a loaded table: one scan, one row fetched."""
    cells = cells_of(df)
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(c.present).alias(f"p{c.pos}") for c in cells],
    ).first()
    return facts_of(row["n_rows"], {c.name: row[f"p{c.pos}"] for c in cells}, empty_warning)


def load_digest(table) -> dict:
    """Short answer after a load: name, source, shape, columns, warnings."""
    return {
        "table_name": table.path_or_table,
        "source": table.source,
        "shape": table.metadata["shape"],
        "columnas": table.df.columns,
        "advertencias": table.metadata.get("warnings", []),
    }
