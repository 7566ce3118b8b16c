"""Approximate nearest neighbours in a neighbour graph.

Build (NN-descent): every vector starts with its nearest ones among those near
it in a few random sorted orders. Then, round by round, the neighbours of each
vector (its own and some that have it as theirs) are compared with each other:
neighbours of neighbours are likely neighbours. Search: from a few entry points
each query walks along the graph, keeping the best found (greedy search with a
beam), until nothing in the beam is left to expand. Equal vectors are one node
with the smallest of their ids, so that copies neither fill lists nor beams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tamiz.session import materialize

#: Neighbours kept per vector, neighbours the other way, rounds of descent.
DEGREE, REVERSE, ROUNDS = 20, 20, 3
#: Random orders of the start, vectors compared at a time there, kept from each.
ORDERS, BLOCK, START = 8, 512, 10
#: Best found that a search keeps, and entry points.
BEAM, ENTRIES = 384, 64
#: Bytes of query vectors that are sent to all tasks at a time.
QUERY_BYTES = 32 << 20
#: An index (vectors and neighbours) up to so many bytes is sent as well.
INDEX_BYTES = 64 << 20
_SALTS = 8
_PLANES = 6


def usable_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(node, v) of vectors that take part: not null, with components, all of
    them finite and not all zero. Of rows that repeat an id the smallest vector
    counts, and of lengths the most frequent one."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("node"), F.col(column).cast("array<double>").alias("v")).where(
        F.col("node").isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1)
    same = rows.join(F.broadcast(lengths.select("size")), F.size("v") == F.col("size")).select("node", "v")
    return same.groupBy("node").agg(F.min("v").alias("v"))


def _ids_of_equals(table: DataFrame, k: int) -> DataFrame:
    """(h, v, node, i): of each vector its k smallest ids, counted from 1. The
    rank is limited in each task ahead of the shuffle, however many are equal."""
    order = Window.partitionBy("h", "v").orderBy("node")
    return table.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors packed as 32-bit floats, as rows."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def _top(edges: DataFrame, k: int, order: str) -> DataFrame:
    """The k first edges (u, v, d) of each u by ``order``, each once. Done per
    salt first, so that a hub's edges do not meet in one task before they are
    few."""
    pick = lambda c: F.slice(F.sort_array(F.array_distinct(c)), 1, k)
    keyed = edges.select("u", F.struct(F.expr(order).alias("o"), "v", "d").alias("e"))
    part = keyed.groupBy("u", F.pmod(F.xxhash64("e.v"), F.lit(_SALTS)).alias("salt")).agg(pick(F.collect_list("e")).alias("es"))
    whole = part.groupBy("u").agg(pick(F.flatten(F.collect_list("es"))).alias("es"))
    return whole.select("u", F.explode("es").alias("e")).select("u", "e.v", "e.d")


def _start(packed: DataFrame, kind: T.DataType, dim: int) -> DataFrame:
    """Edges between vectors near each other in some random order."""
    edge = T.StructType([T.StructField("u", kind), T.StructField("v", kind), T.StructField("d", T.FloatType())])
    rng = np.random.default_rng(17)
    planes = rng.normal(size=(ORDERS, dim, _PLANES)).astype(np.float32)
    lines = rng.normal(size=(ORDERS, dim)).astype(np.float32)
    placed = T.StructType(
        [T.StructField("o", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("p", T.FloatType()), T.StructField("node", kind), T.StructField("x", T.BinaryType())]
    )

    def place(batches):
        for b in batches:
            x = _matrix(b.column("x"))
            for o in range(ORDERS if len(x) else 0):
                code = ((x @ planes[o]) > 0) @ (1 << np.arange(_PLANES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), o, np.int32)), pa.array(code.astype(np.int32)), pa.array(x @ lines[o]), b.column("node"), b.column("x")],
                    placed.names,
                )

    def compare(t: pa.Table) -> pa.RecordBatch:
        x, node = _matrix(t.column("x").combine_chunks()), t.column("node").combine_chunks()
        d = _distances(x, x)
        d[t.column("o").to_numpy()[:, None] != t.column("o").to_numpy()[None, :]] = np.inf
        np.fill_diagonal(d, np.inf)
        k = min(START, len(x) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(x), 0), np.int64)
        dist = np.take_along_axis(d, near, 1).ravel()
        ok = np.isfinite(dist)
        u, v = np.repeat(np.arange(len(x)), k)[ok], near.ravel()[ok]
        return pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v)), pa.array(dist[ok].astype(np.float32))], ["u", "v", "d"])

    def blocks(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= 2 * BLOCK:
                yield compare(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
        if held is not None and held.num_rows:
            yield compare(held)

    ordered = packed.mapInArrow(place, placed).repartitionByRange("o", "code", "p", "node").sortWithinPartitions("o", "code", "p", "node")
    return ordered.mapInArrow(blocks, edge)


def _both_ways(graph: DataFrame, reverse: int) -> DataFrame:
    """Neighbours (u, v), and ``reverse`` random ones of those that have u."""
    other = _top(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), reverse, "xxhash64(u, v)")
    return graph.select("u", "v").unionByName(other.select("u", "v")).distinct()


def build_graph(packed: DataFrame, dim: int) -> DataFrame:
    """Edges (u, v, d) from each vector (node, x) to about its nearest ones."""
    kind = packed.schema["node"].dataType
    edge = T.StructType([T.StructField("u", kind), T.StructField("v", kind), T.StructField("d", T.FloatType())])
    graph = materialize(_top(_start(packed, kind, dim), DEGREE, "d"), "graph")

    def improve(batches):
        for b in batches:
            rows = b.column("l")
            node, x = rows.flatten().field("v"), _matrix(rows.flatten().field("x"))
            worst = rows.flatten().field("worst").to_numpy(zero_copy_only=False)
            at = np.cumsum([0, *(len(r) for r in rows)])
            first, second, dist = [], [], []
            for a, e in zip(at, at[1:]):
                d = _distances(x[a:e], x[a:e])
                np.fill_diagonal(d, np.inf)
                k = min(START, e - a - 1)
                if k <= 0:
                    continue
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                own = np.take_along_axis(d, near, 1)
                better = own < worst[a:e, None]
                first.append(a + np.nonzero(better)[0])
                second.append(a + near[better])
                dist.append(own[better])
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [
                    node.take(pa.array(np.concatenate(first or empty))),
                    node.take(pa.array(np.concatenate(second or empty))),
                    pa.array(np.concatenate(dist or empty).astype(np.float32)),
                ],
                ["u", "v", "d"],
            )

    for _ in range(ROUNDS):
        # A full list only takes what is nearer than its farthest.
        worst = graph.groupBy("u").agg(F.when(F.count("*") < DEGREE, float("inf")).otherwise(F.max("d")).cast("float").alias("worst"))
        known = packed.select(F.col("node").alias("v"), "x").join(worst.withColumnRenamed("u", "v"), "v")
        lists = _both_ways(graph, REVERSE).join(known, "v")
        together = lists.groupBy("u").agg(F.collect_list(F.struct("v", "x", "worst")).alias("l"))
        found = together.select("l").mapInArrow(improve, edge)
        graph = materialize(_top(graph.unionByName(found), DEGREE, "d"), "graph")
    return graph


def _walk(queries: DataFrame, packed: DataFrame, ways: DataFrame, entries: list, beam: int, small: bool) -> DataFrame:
    """(q, b): per query its beam, an array of (d, v, done), nearest first.
    The vectors of these queries are bounded and travel with the code."""
    kind = packed.schema["node"].dataType
    rows = queries.collect()
    keys, xs = [r["q"] for r in rows], np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    place = {k: i for i, k in enumerate(keys)}
    measured = T.StructType([T.StructField("q", kind), T.StructField("v", kind), T.StructField("d", T.FloatType())])

    def measure(batches):
        for b in batches:
            x = _matrix(b.column("x"))
            own = xs[[place[k] for k in b.column("q").to_pylist()]] if len(x) else x
            d = np.sqrt(((x - own) ** 2).sum(1)).astype(np.float32)
            near = pa.array(d < b.column("worst").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), pa.array(d)], measured.names).filter(near)

    def distances(candidates: DataFrame) -> DataFrame:
        """Candidates (q, v, worst) that are nearer than the worst kept."""
        vectors = packed.select(F.col("node").alias("v"), "x")
        return candidates.join(F.broadcast(vectors) if small else vectors, "v").select("q", "v", "x", "worst").mapInArrow(measure, measured)

    def merged(found: DataFrame, before: DataFrame | None) -> DataFrame:
        fresh = found.where("q <> v").select("q", F.struct("d", "v", F.lit(False).alias("done")).alias("e"))
        if before is not None:
            fresh = fresh.unionByName(before.select("q", F.explode("b").alias("e")))
        return fresh.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("e")), 1, beam).alias("b"))

    # A query that is a vector of the table also starts at its own neighbours.
    own = queries.select("q").join(ways.withColumnRenamed("u", "q"), "q").select("q", F.explode("vs").alias("v"))
    common = queries.select("q", F.explode(F.array(*[F.lit(e) for e in entries])).alias("v"))
    first = own.unionByName(common).distinct().withColumn("worst", F.lit(float("inf")).cast("float"))
    now = materialize(merged(distances(first), None), "beam")
    full = F.when(F.size("b") >= beam, F.element_at("b", -1)["d"]).otherwise(F.lit(float("inf"))).cast("float")
    while True:
        open_ = now.select("q", F.explode(F.filter("b", lambda e: ~e["done"])).alias("e")).select("q", F.col("e.v").alias("u"))
        if open_.isEmpty():
            return now
        reached = open_.join(F.broadcast(ways) if small else ways, "u").groupBy("q").agg(F.flatten(F.collect_list("vs")).alias("c"))
        # Each query's row has what it can reach: bounded by the beam and the
        # neighbours of a vector.
        fresh = F.array_except("c", F.transform("b", lambda e: e["v"]))
        candidates = reached.join(now, "q").select("q", F.explode(fresh).alias("v"), full.alias("worst"))
        done = now.select("q", F.transform("b", lambda e: F.struct(e["d"].alias("d"), e["v"].alias("v"), F.lit(True).alias("done"))).alias("b"))
        now = materialize(merged(distances(candidates), done), "beam")


def nearest(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", is_query=None, k: int = 10, beam: int = BEAM, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query_id, rank, ``key``, score): the k nearest found of each query among
    all other vectors by Euclidean distance, nearest first, ties to the smaller
    id. ``is_query`` is a condition on the id (default: divisible by 100).

    Every vector is in the graph; distances of the result are those of the
    original vectors in double precision. Vectors that are null, empty, zero or
    hold a null or a component that is not finite take no part, nor do rows
    without id or of an unusual length. Fewer than k other vectors are all
    found; without usable vectors there are no rows. Other columns are ignored.
    """
    is_query = is_query or (lambda c: c % 100 == 0)
    # A zero has no sign here: equal vectors are to have equal hashes.
    usable = usable_vectors(vectors, key, column).withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    table = materialize(usable.withColumn("h", F.xxhash64("v")), "vectors")
    kind = table.schema["node"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    some = table.select(F.size("v").alias("n")).first()
    if some is None:
        return table.sparkSession.createDataFrame([], schema)
    dim = some["n"]

    def pack(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "x"])

    equal = materialize(_ids_of_equals(table, k + 1), "equal-vectors")
    nodes = equal.where("i = 1").select("h", "v", "node")
    first = nodes.withColumnRenamed("node", "first")
    ids = materialize(equal.join(first, ["h", "v"]).select("first", "node"), "equal-ids")
    asked = materialize(table.where(is_query(F.col("node"))).join(first, ["h", "v"]).select(F.col("node").alias("id"), F.col("first").alias("q")), "queries")

    packed = materialize(
        nodes.select("node", "v").mapInArrow(pack, T.StructType([T.StructField("node", kind), T.StructField("x", T.BinaryType())])), "packed-vectors"
    )
    graph = build_graph(packed, dim)
    ways = materialize(_both_ways(graph, 2 * DEGREE).groupBy("u").agg(F.collect_list("v").alias("vs")), "ways")
    entries = [r["node"] for r in packed.orderBy(F.xxhash64("node"), "node").select("node").limit(ENTRIES).collect()]

    queries = materialize(packed.withColumnRenamed("node", "q").join(asked.select("q").distinct(), "q"), "query-vectors")
    small = packed.count() * (4 * dim + 8 * (3 * DEGREE + 2)) <= INDEX_BYTES
    blocks = max(1, -(-queries.count() * dim * 4 // query_bytes))
    beams = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block) if blocks > 1 else queries
        found = _walk(mine, packed, ways, entries, beam, small)
        beams = found if beams is None else beams.unionByName(found)

    # 32-bit distances may swap near ties: more than k go to the exact measure,
    # and all that the beam has about as far as the k-th.
    limit = F.when(F.size("b") >= k, F.element_at("b", F.least(F.lit(k), F.size("b")))["d"] * 1.0001).otherwise(F.lit(float("inf")))
    near = F.filter("b", lambda e, i: (i < 3 * k) | (e["d"] <= F.col("limit")))
    beams = beams.where(F.size("b") > 0).withColumn("limit", limit)
    close = beams.select("q", F.explode(near).alias("e")).select("q", F.col("e.v").alias("node"))
    pairs = close.join(nodes.select("node", "v"), "node").join(nodes.select(F.col("node").alias("q"), F.col("v").alias("w")), "q")
    score = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = pairs.select("q", F.col("node").alias("first"), score.alias("score"))
    own = asked.select("q").distinct().select("q", F.col("q").alias("first"), F.lit(0.0).alias("score"))
    # Its own id is one of them at most.
    best = scored.unionByName(own).join(ids, "first").groupBy("q").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("score", "node"))), 1, k + 1).alias("es")
    )
    others = F.slice(F.filter("es", lambda e: e["node"] != F.col("id")), 1, k)
    return asked.join(best, "q").select("id", F.posexplode(others).alias("i", "e")).select(
        F.col("id").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("e.node").alias(key), F.col("e.score").alias("score")
    )
