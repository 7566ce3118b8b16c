"""The first values of every column in a fixed row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.errors import AnalysisException

from .cells import Cell


class RowOrder:
    """A total order of the rows: given columns, or the order of the files."""

    def __init__(self, df: DataFrame, order_by: list[str] | None):
        self.df = df
        if order_by:
            self.keys = [F.col(c) for c in order_by]
            self.pushed = self.keys[0]
        else:
            self.keys, self.pushed = self._file_order()

    def _file_order(self) -> tuple[list[Column], Column | None]:
        path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        try:
            self.df.select(path, start).schema
        except AnalysisException:
            return [F.monotonically_increasing_id()], None
        return [path, start, F.monotonically_increasing_id()], path

    def keyed(self, df: DataFrame, *values: Column) -> DataFrame:
        return df.select(*[k.alias(f"_k{i}") for i, k in enumerate(self.keys)], *values)

    def first(self, keyed: DataFrame, n: int) -> DataFrame:
        """First n rows: a bounded heap per task, then one small merge."""
        return keyed.orderBy(*[f"_k{i}" for i in range(len(self.keys))]).limit(n)

    def head(self, n: int) -> DataFrame:
        """Rows among which the first n lie.

        Finds the n-th order key from the key columns alone, so that the scan
        of all columns afterwards carries a pushed-down bound on the first key.
        """
        if self.pushed is None:
            return self.df
        key_type = self.df.select(self.pushed).schema[0].dataType
        found = (
            self.first(self.keyed(self.df), n)
            .agg(_fetched(F.max("_k0"), key_type).alias("bound"), F.count(F.lit(1)).alias("n"))
            .first()
        )
        if found["n"] < n or found["bound"] is None:
            return self.df
        bound = _restored(found["bound"], key_type)
        return self.df.where(self.pushed.isNull() | (self.pushed <= bound))


def _fetched(c: Column, dtype: T.DataType) -> Column:
    """A form that comes to the driver and back whatever the time zones."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return c.cast("string") if isinstance(dtype, T.TimestampNTZType) else c


def _restored(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(dtype)


def first_values(
    df: DataFrame, cells: list[Cell], n: int, order_by: list[str] | None = None
) -> DataFrame:
    """``(pos, rn, value)``: the first n present values of each column as text.

    The head of the table answers for most columns. Only a column that is
    still short of n values there gets a scan of its own, which reads that
    column and the order key and keeps n rows per task.
    """
    order = RowOrder(df, order_by)
    n_head = 4 * n
    names = [f"_v{c.pos}" for c in cells]
    head = order.first(
        order.keyed(order.head(n_head), *[c.text.alias(v) for c, v in zip(cells, names)]), n_head
    )
    seen = head.agg(F.count(F.lit(1)).alias("rows"), *[F.count(v).alias(v) for v in names]).first()
    rest = [] if seen["rows"] < n_head else [c for c, v in zip(cells, names) if seen[v] < n]

    keys = [f"_k{i}" for i in range(len(order.keys))]
    done = [c for c in cells if c not in rest]
    parts = []
    if done:
        pairs = F.array(
            *[F.struct(F.lit(c.pos).alias("pos"), F.col(f"_v{c.pos}").alias("value")) for c in done]
        )
        parts.append(head.select(*keys, F.inline(pairs)).where("value IS NOT NULL"))
    for c in rest:
        own = order.keyed(df.where(c.present), F.lit(c.pos).alias("pos"), c.text.alias("value"))
        parts.append(order.first(own, n))
    found = reduce(DataFrame.unionByName, parts)
    in_order = Window.partitionBy("pos").orderBy(*keys)
    return (
        found.withColumn("rn", F.row_number().over(in_order))
        .where(F.col("rn") <= n)
        .select("pos", "rn", "value")
    )
