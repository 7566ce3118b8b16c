"""Approximate top-k: vectors stored in cells, of which a search reads a few.

A cell holds the vectors nearest to one of the centroids that k-means finds on a
sample; neighbouring cells make an area. The stored table is partitioned by
area and sorted by cell, so a search prunes to the partitions, and in them to
the row groups, of the centroids nearest to its queries. How many cells a query
needs for a wanted recall is measured when the index is built: for a sample of
stored vectors, by their exact neighbours. Scores are exact, only rows in other
cells are missed; over all cells the result is that of ``retrieve.top_k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.predicates import similarity_score
from ..session import materialize
from ..workers import frugal
from .nearest import matrix, ranked_hits, search, unit_rows
from .retrieve import top_k

#: Rows of a cell, about. Small cells follow a query's surroundings closely.
ROWS_PER_CELL = 16
#: Different vectors that k-means sees per cell, about, and its rounds.
SAMPLE_PER_CELL = 16
ROUNDS = 8
#: Centroids go to every task.
CENTROID_BYTES = 64 << 20
#: Scores of vectors and centroids held at once by a task, and sums of cells that
#: it hands on at once.
MAX_SCORES, SUMS = 2_000_000, 4096
#: Stored vectors by which the number of cells to read is measured, and how
#: many of their neighbours.
MEASURED, NEIGHBOURS = 256, 10


def nearest_centroids(units: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each unit vector, nearest first."""
    out = np.empty((len(units), n), np.int32)
    width = max(1, MAX_SCORES // len(centroids))
    half = np.einsum("ij,ij->i", centroids, centroids) / 2
    for lo in range(0, len(units), width):
        score = units[lo : lo + width] @ centroids.T
        score -= half
        if n == 1:
            out[lo : lo + width, 0] = np.argmax(score, axis=1)
            continue
        np.negative(score, out=score)
        some = np.argpartition(score, n - 1, axis=1)[:, :n]
        order = np.argsort(np.take_along_axis(score, some, 1), axis=1, kind="stable")
        out[lo : lo + width] = np.take_along_axis(some, order, 1)
    return out


def _areas(centroids: np.ndarray, seed: int) -> np.ndarray:
    """Which area each centroid is in: about the square root of their number."""
    rng, n = np.random.default_rng(seed), round(len(centroids) ** 0.5)
    middle = centroids[rng.choice(len(centroids), n, replace=False)]
    for _ in range(4):
        own = nearest_centroids(centroids, middle, 1)[:, 0]
        for a in np.unique(own):
            middle[a] = centroids[own == a].mean(0)
    return nearest_centroids(centroids, middle, 1)[:, 0]


def fit_centroids(points: DataFrame, n_cells: int, dim: int, seed: int) -> np.ndarray:
    """k-means over ``embedding`` of ``points``. A round is one job: each task
    sums its vectors per cell, sums of a cell meet, and the new centroids,
    bounded by ``CENTROID_BYTES``, go round."""
    first = points.orderBy(F.xxhash64("embedding", F.lit(seed))).limit(n_cells).collect()
    centroids = unit_rows(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), dim))[0]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, s in zip(batch.column("cell").to_pylist(), batch.column("s")):
                own = np.frombuffer(s.as_buffer())
                total[cell] = total[cell] + own if cell in total else own
        sums = [pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(sums, ["cell", "s"])

    for _ in range(ROUNDS if len(centroids) > 1 else 0):

        def own_sums(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(centroids.shape), np.zeros(len(centroids))
            for batch in batches:
                units, _ = unit_rows(matrix(batch.column("embedding"), dim))
                cell = nearest_centroids(units, centroids, 1)[:, 0] if len(units) else np.zeros(0, np.int32)
                np.add.at(sums, cell, units)
                counts += np.bincount(cell, minlength=len(centroids))
            every = np.flatnonzero(counts)
            for lo in range(0, len(every), SUMS):
                some = every[lo : lo + SUMS]
                rows = np.column_stack([counts[some], sums[some]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["cell", "s"]
                )

        parts = points.mapInArrow(frugal(own_sums), "cell int, s binary")
        for r in parts.repartition("cell").mapInArrow(frugal(meet), "cell int, s binary").collect():
            s = np.frombuffer(r["s"])
            centroids[r["cell"]] = s[1:] / s[0]
    return centroids


class VectorIndex:
    """Vectors in ``folder``: a table partitioned by area, and the centroids.

    ``keys`` name a row; its table has them and ``embedding``. Rows without a
    vector or with a zero vector have no similarity and are not stored.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = ("doc_name", "chunk_id")):
        self.spark, self.folder, self.keys = spark, folder, list(keys)

    def rows(self) -> DataFrame:
        """The stored rows: ``keys``, ``embedding``, ``cell`` and ``area``."""
        return self.spark.read.parquet(f"{self.folder}/rows")

    def cells(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Centroids and areas of the cells, and how many cells a query reads."""
        rows = self.spark.read.parquet(f"{self.folder}/cells").orderBy("cell").collect()
        centroids = np.array([r["centroid"] for r in rows], np.float64)
        return centroids, np.array([r["area"] for r in rows], np.int32), rows[0]["nprobe"]

    def _store_cells(self, centroids: np.ndarray, areas: np.ndarray, nprobe: int) -> None:
        rows = [(i, int(a), nprobe, [float(x) for x in c]) for i, (a, c) in enumerate(zip(areas, centroids))]
        made = self.spark.createDataFrame(rows, "cell int, area int, nprobe int, centroid array<double>")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells")

    def build(self, corpus: DataFrame, *, recall: float = 0.92, n_cells: int | None = None, seed: int = 7) -> int:
        """Store ``corpus`` in cells, of about ``ROWS_PER_CELL`` rows if their
        number is not given, and measure how many of them a query has to read
        for ``recall``. Returns the number of cells, of which the centroids take
        ``CENTROID_BYTES`` at most. k-means sees a sample chosen by a hash of
        the vectors; equal vectors count once there."""
        usable = corpus.where(F.size("embedding") > 0).select(*self.keys, "embedding")
        n, dim = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        if not n:
            raise ValueError("no vectors to index")
        wanted = n_cells or -(-n // ROWS_PER_CELL)
        wanted = max(1, min(wanted, CENTROID_BYTES // (8 * dim), n))
        share = min(1.0, SAMPLE_PER_CELL * wanted / n)
        slot = F.pmod(F.xxhash64("embedding", F.lit(seed + 1)), F.lit(1 << 31))
        points = usable.where(slot < int(share * (1 << 31))).select("embedding").distinct()
        centroids = fit_centroids(materialize(points, "index-sample"), wanted, dim, seed)
        areas = _areas(centroids, seed)
        self._write(usable, centroids, areas, "overwrite")
        self._store_cells(centroids, areas, self._measure(n, centroids, recall, seed))
        return len(centroids)

    def add(self, rows: DataFrame) -> None:
        """Store more rows in the cells as they are."""
        centroids, areas, _ = self.cells()
        self._write(rows.where(F.size("embedding") > 0).select(*self.keys, "embedding"), centroids, areas, "append")

    def _write(self, rows: DataFrame, centroids: np.ndarray, areas: np.ndarray, mode: str) -> None:
        dim = centroids.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units, usable = unit_rows(matrix(batch.column("embedding"), dim))
                if len(units):
                    cell = nearest_centroids(units, centroids, 1)[:, 0]
                    own = batch.filter(pa.array(usable)).append_column("cell", pa.array(cell))
                    yield own.append_column("area", pa.array(areas[cell]))

        fields = [T.StructField("cell", T.IntegerType()), T.StructField("area", T.IntegerType())]
        placed = rows.mapInArrow(frugal(assign), T.StructType([*rows.schema.fields, *fields]))
        # Rows of an area come together; an area of very many is split again.
        placed = placed.hint("rebalance", "area").sortWithinPartitions("area", "cell")
        placed.write.mode(mode).option("parquet.block.size", 4 << 20).partitionBy("area").parquet(f"{self.folder}/rows")

    def _measure(self, n: int, centroids: np.ndarray, recall: float, seed: int) -> int:
        """The least number of cells in which a share ``recall`` of the exact
        neighbours of some stored vectors is found."""
        slot = F.pmod(F.xxhash64(*self.keys, F.lit(seed)), F.lit(1 << 31))
        some = self.rows().where(slot < int(min(1.0, MEASURED / n) * (1 << 31)))
        some = materialize(some.select(F.struct(*self.keys).alias("query_id"), "embedding"), "measured")
        hits = top_k(self.rows(), some, k=NEIGHBOURS + 1, min_score=-1.0, keys=tuple(self.keys))
        hits = hits.where(~F.col("query_id").eqNullSafe(F.struct(*self.keys))).select("query_id", *self.keys)
        held = self.rows().select(*self.keys, "cell").join(F.broadcast(hits), self.keys)
        pairs = held.join(F.broadcast(some), "query_id").select("embedding", "cell").toArrow()
        if not pairs.num_rows:
            return len(centroids)
        units, usable = unit_rows(matrix(pairs.column("embedding").combine_chunks(), centroids.shape[1]))
        cell, place = pairs.column("cell").to_numpy()[usable], []
        for lo in range(0, len(units), 256):
            order = nearest_centroids(units[lo : lo + 256], centroids, len(centroids))
            place += np.argmax(order == cell[lo : lo + 256, None], axis=1).tolist()
        return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1

    def probes(self, queries: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
        """``(cell, query_id, embedding)``: the ``n`` cells to be searched for each query."""
        dim = centroids.shape[1]
        asked = queries.where(F.size("embedding") > 0).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units, usable = unit_rows(matrix(batch.column("embedding"), dim))
                if len(units):
                    cells = nearest_centroids(units, centroids, n)
                    rows = batch.filter(pa.array(usable))
                    yield rows.append_column("cells", pa.array(list(cells), pa.list_(pa.int32())))

        cells = T.StructField("cells", T.ArrayType(T.IntegerType()))
        found = asked.mapInArrow(frugal(choose), T.StructType([*asked.schema.fields, cells]))
        return found.select(F.explode("cells").alias("cell"), "query_id", "embedding")

    def search(self, queries: DataFrame, *, k: int = 5, min_score: float = 0.3, nprobe: int | None = None) -> DataFrame:
        """``(query_id, rank, *keys, score)``, as ``retrieve.top_k``, of the
        rows in the ``nprobe`` cells nearest to each query; if not given, in as
        many as the recall asked for when building took."""
        centroids, areas, measured = self.cells()
        probes = self.probes(queries, centroids, min(len(centroids), nprobe or measured))
        # As many rows as there are cells, at most.
        read = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
        cells = self.spark.createDataFrame([(r["cell"],) for r in read], "cell int")
        corpus = self.rows().where(F.col("area").isin(sorted({int(areas[r["cell"]]) for r in read})))
        corpus = corpus.join(F.broadcast(cells), "cell", "left_semi").select("cell", *self.keys, "embedding")
        asked = sum(r["n"] for r in read)
        found = search(corpus, probes, asked=asked, k=k, floor=min_score, keys=self.keys, dim=centroids.shape[1])
        hits = ranked_hits(found, k, self.keys).withColumn("score", similarity_score(F.col("similarity")))
        return hits.where(F.col("similarity") >= min_score).select("query_id", "rank", *self.keys, "score")


def recall(found: DataFrame, exact: DataFrame, keys: tuple[str, ...] = ("doc_name", "chunk_id")) -> DataFrame:
    """``(query_id, hits, found, recall)`` for each query with exact hits: how
    many of them an approximate search has found."""
    same = ["query_id", *keys]
    both = exact.select(*same).join(found.select(*same, F.lit(1).alias("got")), same, "left")
    counts = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.count("got").alias("found"))
    return counts.withColumn("recall", F.col("found") / F.col("hits"))
