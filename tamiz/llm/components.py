"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tamiz.session import materialize

#: Edges that a task makes into stars at a time.
STAR_EDGES = 1 << 17


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with ``m``, the smallest of u and all its partners. A
    partner of a third of all nodes is aggregated before the shuffle, and the
    join back is one that Spark can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _own_stars(edges: DataFrame) -> DataFrame:
    """Edges of the same components: those that a task has at hand, a bounded
    number at a time, become stars around their smallest nodes."""

    def stars(held):
        t = pa.Table.from_batches(held)
        names = pa.concat_arrays([*t.column("u").chunks, *t.column("v").chunks]).unique()
        names = names.take(pc.sort_indices(names))
        top = list(range(len(names)))

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for x, y in zip(*(pc.index_in(t.column(c), names).to_pylist() for c in ("u", "v"))):
            x, y = find(x), find(y)
            top[max(x, y)] = min(x, y)
        least = np.array([find(x) for x in range(len(top))], np.int64)
        below = np.flatnonzero(least != np.arange(len(least)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(below)), names.take(pa.array(least[below]))], ["u", "v"])

    def starred(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= STAR_EDGES:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return _ordered(edges.mapInArrow(starred, edges.schema))


def _facts(now: DataFrame) -> tuple[int, bool]:
    """How many edges (u, v), u > v, there are, and whether they are stars around
    their smallest nodes: no node has two smaller partners, nor a smaller and a
    larger one."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        now.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    mixed = F.max((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))
    n, mixed = ends.agg(F.sum("below"), mixed).first()
    return n or 0, not mixed


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for each node of the edges (u, v); a component has the
    name of its smallest node. Alternates stars of larger and of smaller
    partners until only stars are left; edges that are stars, or no more than a
    task makes into stars at a time, need none of that. Each round is written to
    the shared folder, so lineage stays short and a lost executor costs one round."""
    now = materialize(_ordered(edges).distinct(), "edges")
    for _ in range(rounds):
        n, settled = _facts(now)
        if settled:
            break
        if n > STAR_EDGES:
            large = _stars(_both_ways(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            small = _stars(large)
            small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m"))
            now = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = materialize(_own_stars(now.coalesce(-(-n // STAR_EDGES))), "edges")
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )
