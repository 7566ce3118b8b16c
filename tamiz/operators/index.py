"""The chunk table: create, insert once, replace, count, list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

KEY = ["doc_name", "chunk_id"]

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("doc_name", T.StringType(), False),
        T.StructField("chunk_id", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def first_of_key(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row per key: the first in ``order``, else the first as the rows are
    read. Copies of one key meet in the map-side combine, so a key with very
    many copies is no hot spot."""
    rest = [c for c in rows.columns if c not in KEY]
    by = F.col(order) if order else F.col("read_at")
    return (
        rows.withColumn("read_at", F.monotonically_increasing_id())
        .groupBy(*KEY)
        .agg(F.min_by(F.struct(*rest), by).alias("row"))
        .select(*KEY, "row.*")
    )


def new_rows(rows: DataFrame, existing: DataFrame, order: str | None = None) -> DataFrame:
    """Rows whose key is not in ``existing`` yet, one per key. Of ``existing``
    only the key columns are read."""
    rest = [c for c in rows.columns if c not in KEY]
    # Known keys go before their rows are grouped with all they carry; the place
    # where a row was read is noted before rows move.
    placed = rows if order else rows.withColumn("place", F.monotonically_increasing_id())
    unknown = placed.join(existing.select(*KEY), KEY, "left_anti")
    return first_of_key(unknown, order or "place").select(*KEY, *rest)


def pair(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their ``embedding``; raises when a side has a key the other
    lacks."""
    missing = pairing(chunks, vectors).first()
    if missing["only_left"] or missing["only_right"]:
        raise ValueError(
            f"{missing['only_left']} chunks without a vector, "
            f"{missing['only_right']} vectors without a chunk"
        )
    return chunks.join(vectors.select(*KEY, "embedding"), KEY)


def pairing(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row: keys on both sides, only left, only right."""
    both = left.select(*keys, F.lit(1).alias("l")).join(
        right.select(*keys, F.lit(1).alias("r")), keys, "full_outer"
    )
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("paired"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
    )


def documents(index: DataFrame) -> DataFrame:
    return index.select("doc_name").distinct().orderBy("doc_name")


def chunks_per_document(index: DataFrame) -> DataFrame:
    return index.groupBy("doc_name").agg(F.count(F.lit(1)).alias("n_chunks"))


class ChunkIndex:
    """A chunk table at a path (``store="path"``) or in the catalog
    (``store="table"``)."""

    def __init__(self, spark: SparkSession, name: str, store: str = "path"):
        if store not in ("path", "table"):
            raise ValueError("store is 'path' or 'table'")
        self.spark, self.name, self.store = spark, name, store

    def _write(self, df: DataFrame, mode: str) -> None:
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in CHUNK_SCHEMA.fields])
        writer = rows.write.mode(mode).format("parquet")
        if self.store == "path":
            writer.save(self.name)
        else:
            writer.saveAsTable(self.name)

    def exists(self) -> bool:
        if self.store == "table":
            return self.spark.catalog.tableExists(self.name)
        try:
            self.spark.read.schema(CHUNK_SCHEMA).parquet(self.name)
            return True
        except AnalysisException:
            return False

    def create(self, drop_first: bool = False) -> None:
        if drop_first or not self.exists():
            self._write(self.spark.createDataFrame([], CHUNK_SCHEMA), "overwrite")

    def read(self) -> DataFrame:
        if self.store == "table":
            return self.spark.table(self.name)
        return self.spark.read.schema(CHUNK_SCHEMA).parquet(self.name)

    def missing(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Rows not indexed yet: embed these, not all."""
        return new_rows(rows, self.read(), order)

    def insert(self, rows: DataFrame, order: str | None = None) -> int:
        """Append rows with new keys; a row already there wins. Returns how
        many were added."""
        before = self.count()
        self._write(self.missing(rows, order), "append")
        return self.count() - before

    def replace(self, rows: DataFrame) -> int:
        """Replace the content; returns the number of rows loaded."""
        self._write(rows, "overwrite")
        return self.count()

    def count(self) -> int:
        return self.read().count()

    def documents(self) -> DataFrame:
        return documents(self.read())
