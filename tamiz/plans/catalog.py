"""Named tables and their stored profiles."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.profile import digest, profile_catalog
from ..sources.table import SourceTable


_64_BITS = 0xFFFFFFFFFFFFFFFF


class Catalog:
    """Tables by name, and profiles kept under ``store`` per fingerprint.

    ``known`` maps a name to a path that is loaded on demand by ``loader``.
    """

    def __init__(
        self,
        spark: SparkSession,
        store: str,
        known: dict[str, str] | None = None,
        loader: Callable[[SparkSession, str], SourceTable] | None = None,
    ):
        self.spark, self.store = spark, store
        self.known, self.loader = dict(known or {}), loader
        self._loaded: dict[str, SourceTable] = {}

    def register(self, name: str, table: SourceTable) -> None:
        self._loaded[name] = table
        table.df.createOrReplaceTempView(_view(name))

    def get(self, name: str) -> SourceTable | None:
        return self._loaded.get(name)

    def loaded(self) -> list[str]:
        return sorted(self._loaded)

    def known_names(self) -> list[str]:
        return sorted(self.known)

    def profiled(self) -> list[str]:
        rows = self._stored("tables")
        if rows is None:
            return []
        return sorted(r["table_name"] for r in rows.select("table_name").distinct().collect())

    def listing(self) -> dict[str, list[str]]:
        return {
            "tablas_cargadas": self.loaded(),
            "tablas_perfiladas": self.profiled(),
            "tablas_disponibles": self.known_names(),
        }

    def resolve(self, name: str) -> SourceTable:
        """Loaded table, else known path, else an error that lists the names."""
        table = self.get(name)
        if table is None:
            if name not in self.known or self.loader is None:
                raise KeyError(f"unknown table {name!r}; available: {self.known_names()}")
            table = self.loader(self.spark, self.known[name])
            self.register(name, table)
        return table

    def fingerprint(self, table: SourceTable) -> str:
        """Changes with the query, the schema, the facts of the load, and the
        files read, their sizes or times. What a table without files holds can't
        be seen: its fingerprint is new each time, unless the metadata have a
        ``version`` that the caller vouches for."""
        # Numbers of columns differ from one plan to the next.
        plan = re.sub(r"#\d+L?", "", table.df._jdf.queryExecution().analyzed().toString())
        facts = json.dumps([plan, table.df.schema.jsonValue(), table.metadata], sort_keys=True, default=str)
        known = F.xxhash64(F.lit(facts)).alias("known")
        file = ("file_path", "file_size", "file_modification_time")
        try:
            files = table.df.select(*[F.col(f"_metadata.{c}") for c in file]).distinct()
        except AnalysisException:
            version = (table.metadata or {}).get("version") or uuid.uuid4().hex
            files = table.df.select(F.lit(f"{table.path_or_table} {version}").alias("t"))
        r = files.agg(
            F.coalesce(F.bit_xor(F.xxhash64(*files.columns)), F.lit(0)).alias("h"),
            F.count(F.lit(1)).alias("n"),
        ).select("*", known).first()
        return f"{r['h'] & _64_BITS:016x}-{r['known'] & _64_BITS:016x}-{r['n']}"

    def profile(self, name: str) -> DataFrame:
        """``(table_name, digest)``; computed once per state of the table."""
        table = self.resolve(name)
        mark = self.fingerprint(table)
        same = (F.col("table_name") == name) & (F.col("fingerprint") == mark)
        tables = self._stored("tables")
        if tables is None or not tables.where(same).take(1):
            made = profile_catalog({name: table})
            for part, df in (("columns", made.columns), ("tables", made.table)):
                df.withColumn("fingerprint", F.lit(mark)).write.mode("append").parquet(f"{self.store}/{part}")
        columns, tables = self._stored("columns"), self._stored("tables")
        return digest(columns.where(same), tables.where(same))

    def reset(self) -> None:
        """Forget the loaded tables; stored profiles stay valid by fingerprint."""
        for name in self._loaded:
            self.spark.catalog.dropTempView(_view(name))
        self._loaded.clear()

    def _stored(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.store}/{part}")
        except AnalysisException:
            return None


def _view(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)
