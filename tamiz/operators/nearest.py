"""The best rows of a corpus for queries, in cells.

Corpus and queries meet in cells: one cell for an exact search, the cells of a
vector index otherwise. Few queries go to every task, which scans its part of
the corpus where it lies. For many, a cell is cut into tiles, some rows of the
corpus by a block of queries; a tile is one piece of work. Its task holds the
block and the k best rows found so far, and the corpus rows stream past. So
memory is bounded by the block whatever the size of either side, and nothing
passes through the driver but the two counts of each cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..workers import frugal

#: Query vectors that go to every task; more are searched in tiles.
BROADCAST_BYTES = 16 << 20
#: Query vectors of a tile.
BLOCK_BYTES = 8 << 20
#: Corpus rows of a tile, at most on average.
TILE_ROWS = 4_000_000
#: Partitions; bytes of vectors and similarities of one, about. A partition has
#: several tiles where they are small.
MOST_PARTITIONS, PARTITION_BYTES, PARTITION_PAIRS = 20_000, 16 << 20, 1 << 30
#: Similarities held at once by a task.
MAX_CELLS = 500_000
#: Similarities that agree to this many decimals count as equal.
TIE_DECIMALS = 12


def unit_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows brought to length 1, without zero rows, and which rows these are."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    usable = norms > 0
    return vectors[usable] / norms[usable, None], usable


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors of {dim} values expected, found {sorted(set(lengths.tolist()))}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def first_per_query(table: pa.Table, k: int, keys: list[str]) -> pa.Table:
    """The k best rows of each ``_q``; equal similarities in the order of the keys."""
    table = table.sort_by([("_q", "ascending"), ("similarity", "descending"), *[(c, "ascending") for c in keys]])
    q = table.column("_q").to_numpy()
    first = np.searchsorted(q, q, side="left")
    return table.filter(pa.array(np.arange(len(q)) - first < k))


class Best:
    """The k best rows for each query of a block, as corpus rows stream past."""

    def __init__(self, unit: np.ndarray, k: int, floor: float, keys: list[str]):
        self.unit, self.k, self.keys = unit, k, keys
        # What a row must reach at least: the k-th best so far.
        self.least = np.full(len(unit), floor)
        self.held: list[pa.Table] = []
        self.waiting = 0

    def add(self, table: pa.Table, units: np.ndarray, rows: np.ndarray) -> None:
        """``units`` are the vectors of the ``rows`` of ``table``."""
        width = max(1, MAX_CELLS // max(1, len(rows)))
        for lo in range(0, len(self.unit), width):
            sims = self.unit[lo : lo + width] @ units.T
            np.round(sims, TIE_DECIMALS, out=sims)
            some = sims >= self.least[lo : lo + width, None]
            if self.k < len(rows) and np.count_nonzero(some) > 2 * self.k * len(sims):
                # These rows alone tell what the k-th best reaches at least.
                some &= sims >= np.partition(np.where(some, sims, -np.inf), -self.k, axis=1)[:, -self.k, None]
            q, r = np.nonzero(some)
            if not len(q):
                continue
            found = table.select(self.keys).take(pa.array(rows[r]))
            found = found.add_column(0, "similarity", pa.array(sims[q, r]))
            found = found.add_column(0, "_q", pa.array((q + lo).astype(np.int32)))
            if len(q) > self.k:
                found = first_per_query(found, self.k, self.keys)
            self.held.append(found)
            self.waiting += len(found)
            if self.waiting > max(self.k * len(self.unit), 10_000):
                self._settle()

    def _settle(self) -> None:
        best = first_per_query(pa.concat_tables(self.held), self.k, self.keys).combine_chunks()
        self.held, self.waiting = [best], 0
        q, s = best.column("_q").to_numpy(), best.column("similarity").to_numpy()
        full = np.flatnonzero(np.bincount(q, minlength=len(self.unit)) >= self.k)
        last = np.searchsorted(q, full, side="right") - 1
        self.least[full] = np.maximum(self.least[full], s[last])

    def result(self) -> pa.Table | None:
        if self.held:
            self._settle()
        return self.held[0] if self.held else None


def search(
    corpus: DataFrame, queries: DataFrame, *, asked: int, k: int, floor: float, keys: list[str], dim: int, spread: bool = False
) -> DataFrame:
    """``(query_id, similarity, *keys)``: for each query its k best rows of
    every part of the corpus that a task has searched; the best of all are among
    them.

    ``corpus`` has ``cell`` (int), ``keys`` and ``embedding``; ``queries`` has
    ``cell``, ``query_id`` and ``embedding``, a row for each cell to be searched,
    ``asked`` rows at most. Vectors have ``dim`` values. With ``spread`` a cell
    is cut into as many tiles as there are cores, even if it is small.
    """
    if asked * dim * 8 <= BROADCAST_BYTES:
        return _scan_cells(corpus, queries, k, floor, keys, dim)
    return _search_tiles(corpus, queries, k, floor, keys, dim, spread)


def _scan_cells(corpus: DataFrame, queries: DataFrame, k: int, floor: float, keys: list[str], dim: int) -> DataFrame:
    """All queries in every task, by cell; the corpus is not shuffled."""
    spark = corpus.sparkSession
    rows = queries.collect()
    unit, usable = unit_rows(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dim))
    number, cell = np.flatnonzero(usable), np.array([r["cell"] for r in rows], np.int64)[usable]
    sent = spark.sparkContext.broadcast((number, cell, unit))
    schema = T.StructType(
        [T.StructField("_q", T.IntegerType()), T.StructField("similarity", T.DoubleType()), *(corpus.schema[c] for c in keys)]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, unit = sent.value
        best: dict[int, Best] = {}
        for batch in batches:
            at = batch.column("cell").to_numpy()
            for own in np.unique(at):
                if own not in best:
                    best[own] = Best(unit[cell == own], k, floor, keys)
                if not len(best[own].unit):
                    continue
                part = batch if (at == own).all() else batch.filter(pa.array(at == own))
                units, some = unit_rows(matrix(part.column("embedding"), dim))
                best[own].add(pa.Table.from_batches([part]), units, np.flatnonzero(some))
        for own, held in best.items():
            found = held.result()
            if found is not None:
                named = pa.array(number[cell == own].astype(np.int32)).take(found.column("_q").combine_chunks())
                yield from found.set_column(0, "_q", named).combine_chunks().to_batches()

    names = spark.createDataFrame(
        [(i, r["query_id"]) for i, r in enumerate(rows)],
        T.StructType([T.StructField("_q", T.IntegerType()), queries.schema["query_id"]]),
    )
    return corpus.select("cell", *keys, "embedding").mapInArrow(frugal(scan), schema).join(F.broadcast(names), "_q").drop("_q")


def _search_tiles(
    corpus: DataFrame, queries: DataFrame, k: int, floor: float, keys: list[str], dim: int, spread: bool
) -> DataFrame:
    spark = corpus.sparkSession
    block = max(1, BLOCK_BYTES // (8 * dim))
    cores = spark.sparkContext.defaultParallelism
    sizes = (
        corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        .join(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("wanted")), "cell")
    )
    tiles, moved, pairs, plan = 0, 0, 0, []
    for r in sizes.collect():
        across = -(-r["wanted"] // block)
        down = max(-(-r["rows"] // TILE_ROWS), -(-2 * cores // across) if spread else 1)
        plan.append((r["cell"], tiles, down, across))
        tiles += down * across
        moved += 8 * dim * (r["rows"] * across + r["wanted"] * down)
        pairs += r["rows"] * r["wanted"]
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, base long, down long, across long"))
    own = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType)])
    fields = [corpus.schema[c] for c in keys]

    def tiled(rows: DataFrame, number, others, kind: int) -> DataFrame:
        """Each row in every tile of its row or column of the cell."""
        rows = rows.join(plan, "cell").withColumn("_at", number).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
        place = F.col("_at") * F.col("across") + F.col("_other") if kind else F.col("_other") * F.col("across") + F.col("_at")
        return rows.withColumns({"_tile": F.col("base") + place, "_kind": F.lit(kind)})

    # Ids may repeat and keys may be anything: rows are dealt by their position.
    position = F.monotonically_increasing_id()
    asked = tiled(queries, F.pmod(position, F.col("across")), F.col("down"), 0).select(
        "_tile", "_kind", F.struct("query_id").alias("_own"), F.lit(None).cast(T.StructType(fields)).alias("_keys"), "embedding"
    )
    given = tiled(corpus, F.pmod(position, F.col("down")), F.col("across"), 1).select(
        "_tile", "_kind", F.lit(None).cast(own).alias("_own"), F.struct(*keys).alias("_keys"), "embedding"
    )
    both = asked.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(
        given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    )
    partitions = max(2 * cores, moved // PARTITION_BYTES, pairs // PARTITION_PAIRS)
    partitions = max(1, min(tiles, partitions, MOST_PARTITIONS))
    placed = both.repartitionById(partitions, F.pmod("_tile", F.lit(partitions)).cast("int")).sortWithinPartitions("_tile", "_kind")
    schema = T.StructType([*own.fields, T.StructField("similarity", T.DoubleType()), *fields])

    def named(ids: pa.Array, best: Best) -> Iterator[pa.RecordBatch]:
        found = best.result()
        if found is not None:
            found = found.set_column(0, "query_id", ids.take(found.column("_q").combine_chunks()))
            yield from found.combine_chunks().to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, vectors, best = None, [], [], None
        for batch in batches:
            number, kind = batch.column("_tile").to_numpy(), batch.column("_kind").to_numpy()
            edges = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(number)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if number[lo] != tile:
                    if best is not None:
                        yield from named(ids, best)
                    tile, ids, vectors, best = number[lo], [], [], None
                # Values under a list's null parts are no vectors; there are none here.
                x = matrix(part.column("embedding"), dim)
                if not kind[lo]:
                    ids.append(part.column("_own").field("query_id"))
                    vectors.append(x)
                    continue
                if not ids:
                    continue
                if best is None:
                    unit, usable = unit_rows(np.concatenate(vectors))
                    ids = pa.concat_arrays(ids).filter(pa.array(usable))
                    best, vectors = Best(unit, k, floor, keys), []
                units, usable = unit_rows(x)
                at = np.flatnonzero(usable)
                table = pa.table(part.column("_keys").flatten(), keys)
                best.add(table, units, at)
        if best is not None:
            yield from named(ids, best)

    return placed.mapInArrow(frugal(run), schema)


def ranked_hits(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best of all rows found for a query, with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *keys)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
