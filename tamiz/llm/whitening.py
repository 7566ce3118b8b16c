"""Vectors turned to uncorrelated components of equal variance.

Blocks of centred rows are reduced by QR to triangles, which are reduced in
turn until one is left: of the covariance it is the root. Its singular values
and vectors come from ``bidiagonal``, so the covariance itself, which would
square the rounding, is never formed.

Entries are counted in whole numbers (1024ths, moved by 100,000), so their sums
and each row's distance from the mean are exact.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tamiz.llm import bidiagonal
from tamiz.session import materialize

COMPONENTS = 8
SCALE, MOVED = 1024, 100_000
#: Entries beyond this count as not finite: their whole numbers would not
#: leave room for exact sums.
LARGEST = float(1 << 32)
#: Rows that one QR reduces, and triangles that meet in one task.
BLOCK_ROWS = 4096
MEET = 16


def whole_rows(column: pa.Array, dim: int | None = None):
    """Yields (length, places of rows, their entries as whole numbers) of the
    usable vectors of a column, one length at a time; ``dim`` selects one."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in [dim] if dim else np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        entries = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
        usable = (np.abs(entries) < LARGEST).all(1)
        yield size, at[usable], np.floor(SCALE * entries[usable]).astype(np.int64) + MOVED


def fit_sums(vectors: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(n, sum of each entry) of the usable vectors of the most frequent
    length (the shorter one of two); (0, []) if there are none."""

    def summed(batches):
        n, sums = {}, {}
        for b in batches:
            for size, _, x in whole_rows(b.column(0)):
                n[size] = n.get(size, 0) + len(x)
                # Whole numbers of Python do not overflow.
                sums[size] = sums.get(size, 0) + x.sum(0).astype(object)
        for size in n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, size, np.int32)),
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.array(np.full(size, n[size], np.int64)),
                    pa.array([Decimal(int(s)) for s in sums[size]], pa.decimal128(38, 0)),
                ],
                ["dim", "i", "n", "s"],
            )

    per_task = vectors.select(vector).mapInArrow(summed, "dim int, i int, n long, s decimal(38,0)")
    sums = materialize(per_task, "vector-sums").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = sums.where("i = 0 AND n > 0").orderBy(F.desc("n"), "dim").select("dim", "n").first()
    if best is None:
        return 0, []
    own = sums.where(F.col("dim") == best["dim"]).select("i", "s").collect()
    return best["n"], [int(r["s"]) for r in sorted(own)]


class Centre:
    """Rows less their mean, exactly: n times a row minus the sums."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.near = n, np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit numbers if they have room, else as Python's."""
        near = x - self.near
        if np.abs(near).max(initial=0) < (1 << 62) // self.n - 1:
            return near * self.n - np.array(self.rest, np.int64)
        return near.astype(object) * self.n - np.array(self.rest, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.times_n(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int]:
        d = self.times_n(x)
        if d.dtype == object or x.shape[1] * float(np.abs(d).max(initial=0)) ** 2 > 2.0**62:
            d = d.astype(object)
        return [int(s) for s in (d * d).sum(1)]


def triangle(parts: list[np.ndarray], dim: int) -> np.ndarray:
    """Square upper triangle with the cross products of all rows of ``parts``."""
    rows = np.concatenate([np.zeros((dim, dim)), *parts])
    return np.linalg.qr(rows, mode="r")


def reduce_rows(vectors: DataFrame, vector: str, centre: Centre) -> np.ndarray:
    """The triangle of all centred rows. Tasks reduce their own in blocks; then
    ``MEET`` triangles at a time meet, until one comes to the driver."""
    dim = len(centre.near)

    def own(batches):
        held = np.zeros((dim, dim))
        for b in batches:
            for _, _, x in whole_rows(b.column(0), dim):
                for lo in range(0, len(x), BLOCK_ROWS):
                    held = triangle([held, centre.rows(x[lo : lo + BLOCK_ROWS])], dim)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    def meet(batches):
        held, some = np.zeros((dim, dim)), False
        for b in batches:
            for r in b.column(0):
                some, held = True, triangle([held, np.frombuffer(r.as_buffer()).reshape(dim, dim)], dim)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    triangles = materialize(vectors.select(vector).mapInArrow(own, "r binary"), "triangles")
    while (count := triangles.count()) > 1:
        triangles = materialize(triangles.repartition(-(-count // MEET)).mapInArrow(meet, "r binary"), "triangles")
    return np.frombuffer(triangles.first()["r"]).reshape(dim, dim)


def whiten(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vector_id``, ``component``
    (from 1, by falling variance), ``n`` (usable vectors), ``deviation``
    (squared distance of n times the vector from the sum of all, exact, decimal),
    ``whitened``, ``explained`` (the component's share of all variance) and
    ``identity_error`` (largest difference between the covariance of
    ``whitened`` and the identity).

    Vectors that are null, empty, hold null, non-finite or larger entries than
    ``LARGEST``, or have another length than most, take no part and have no
    rows. Rows with a null or repeated id are vectors of their own. Vectors of
    fewer dimensions have as many components. A component without variance
    beyond rounding (all vectors equal, say) is whitened to 0, explains 0 and
    does not count in ``identity_error``. Of equal variances any set of
    directions serves. No usable vectors give no rows. Other columns are
    ignored, whatever their names.
    """
    spark, kind = vectors.sparkSession, vectors.schema[vector_id].dataType
    result = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, sums = fit_sums(vectors, vector)
    if not n:
        types = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], T.StructType([T.StructField(vector_id, kind)] + T._parse_datatype_string(types).fields))
    centre, dim = Centre(n, sums), len(sums)
    root = reduce_rows(vectors, vector, centre)
    values, directions = bidiagonal.leading_vectors(root, components)
    total = float((root * root).sum())
    real = values > (dim * bidiagonal.EPS) ** 2 * total
    per_unit = directions * np.where(real, np.sqrt(n / np.where(real, values, 1.0)), 0.0)
    explained = np.where(real, values / (total or 1.0), 0.0)
    projected = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("w", T.ArrayType(T.DoubleType())),
        ]
    )

    def project(batches):
        for b in batches:
            for _, at, x in whole_rows(b.column(1), dim):
                w = centre.rows(x) @ per_unit
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)),
                        pa.array([Decimal(d) for d in centre.deviations(x)], pa.decimal128(38, 0)),
                        pa.array(list(w), pa.list_(pa.float64())),
                    ],
                    projected.names,
                )

    def products(batches):
        total = np.zeros((len(values), len(values)))
        for b in batches:
            w = b.column(0).flatten().to_numpy().reshape(-1, len(values))
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    rows = materialize(vectors.select(vector_id, vector).mapInArrow(project, projected), "projected")
    # The mean of w is zero: its rows were centred exactly.
    pairs = rows.select("w").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    error = max((abs(r["s"] / n - (r["i"] == r["j"])) for r in pairs.collect() if real[r["i"]] and real[r["j"]]), default=0.0)
    share = F.array(*(F.lit(float(x)) for x in explained))
    return (
        rows.select(F.col("id").alias(vector_id), "deviation", F.posexplode("w").alias("at", "whitened"))
        .withColumns({"component": F.col("at") + 1, "n": F.lit(n).cast("long"), "explained": share[F.col("at")], "identity_error": F.lit(float(error))})
        .select(vector_id, *result)
    )
