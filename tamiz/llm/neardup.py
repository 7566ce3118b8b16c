"""Near-duplicate documents by an LSH forest.

1. Documents with equal sets of word shingles are one class; the rest works on
   classes.
2. A class has a MinHash signature of 128 values of a byte. The forest is a
   number of sorted orders; each sorts the classes by the signature, begun at
   another value. Candidates are neighbours in an order with a long common
   prefix: where few classes share the least prefix (a sparse region), all of
   them (where it is only one, it is not sorted in); in a crowded region only the nearest, which share longer prefixes.
3. Candidates that the whole signature does not rule out are confirmed on the
   full sets: first each class's likeliest, then all between classes that are
   not yet in one component.
4. Crowded regions are where step 2 left pairs out. Where their classes are not
   all in one component, they go, with fresh signatures, through many more
   orders; only pairs of different components count, and a pair is met where
   its common prefix, up to the length of the keys, is longer than that of
   others. In regions crowded in these orders too, only the nearest are met.
5. Such regions, where still not whole, are
   compared in full: regions with common classes are one group, and in a group
   the shared shingles of all pairs are counted.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tamiz.llm import hashing as H
from tamiz.llm.components import connected_components
from tamiz.llm.workers import frugal
from tamiz.session import materialize

VALUES = 128
ORDERS = 16
WIDTH = 8
#: In crowded regions: neighbours in an order; signatures, width and length of
#: the keys of the later orders.
CROWDED_FIRST, CROWDED_SIGNATURES, CROWDED_WIDTH, CROWDED_KEY = 2, 4, 48, 12
#: There a bit each of so many fresh signatures' values tells how similar two are.
BIT_SIGNATURES = 16
#: Shingle sets and lists of ids that are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 48 << 20
#: Bytes of shingle sets that a task compares.
COMPARED_BYTES = 16 << 20
#: Bytes of shingle sets that are sent to all tasks at a time, and a block's rows
#: and columns where all pairs are counted.
SENT_BYTES, BLOCK_ROWS, BLOCK_COLUMNS = 16 << 20, 1024, 2048
#: A pair at the threshold is missed by all first orders with this chance at most.
MISS = 2e-5
#: Standard errors by which a signature may fall short of the threshold.
SLACK = 4.5


def least_depth(threshold: float, orders: int = ORDERS, miss: float = MISS) -> int:
    depth = 1
    while (1 - threshold ** (depth + 1)) ** orders <= miss:
        depth += 1
    return depth


def least_matches(threshold: float, values: int = VALUES, kinds: float = math.inf) -> int:
    """Values that a pair at the threshold has in common, less the slack. Values
    of few kinds agree by chance as well."""
    p = threshold + (1 - threshold) / kinds
    return math.floor(values * (p - SLACK * math.sqrt(p * (1 - p) / values)))


def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1000 + seed)
    return rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None], rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None] | np.uint32(1)


def signature(shingles: np.ndarray, seed: int) -> bytes:
    """A byte of the smallest permuted hash for each permutation."""
    shift, factor = _permutations(seed)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, np.uint32(0xFFFFFFFF))
    for lo in range(0, len(x), 1024):
        y = (x[None, lo : lo + 1024] ^ shift) * factor
        np.minimum(least, (y ^ (y >> np.uint32(15))).min(1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def shingle_sets(texts: pa.Array, size: int):
    """Sorted distinct shingle hashes of each text, a few MB of text at a time."""
    for lo, hi in H.row_groups(H.text_bytes(texts)[1], 2 << 20):
        words, at = H.word_hashes(texts.slice(lo, hi - lo), H.SPACE)
        shingles, at = H.shingle_hashes(words, at, size)
        for a, b in zip(at.tolist(), at[1:].tolist()):
            yield np.unique(shingles[a:b])


def _described(rows: DataFrame, size: int) -> DataFrame:
    """(d, n, digest, signature) of each row (d, t)."""
    schema = T.StructType(
        [rows.schema["d"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())]
    )

    def describe(batches):
        for b in batches:
            n, digest, sketch = [], [], []
            for s in shingle_sets(b.column("t"), size):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append(signature(s, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())],
                ["d", "n", "digest", "signature"],
            )

    return rows.mapInArrow(frugal(describe), schema)


def _texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the given nodes (column ``node``), one per text. Their list is
    small beside the texts, which stay where they are read if it may be sent."""
    nodes = nodes.withColumnRenamed("node", "d")
    few = nodes.count() * 64 <= BROADCAST_BYTES
    return rows.join(F.broadcast(nodes) if few else nodes, "d")


def _places_with_company(classes: DataFrame, turned, depth: int) -> DataFrame:
    """(node, ats) of the classes that share a least prefix with another one, and
    the orders in which they do: most classes are alone in nearly all of them.
    Prefixes are sorted by their hash; one at the edge of a batch is kept, as its
    like may be in the next one."""
    places = classes.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))).withColumn("turned", turned)
    places = places.select("node", "at", F.expr(f"xxhash64(at, substring(turned, 1, {depth}))").alias("place"))

    def shared(batches):
        for b in batches:
            place = b.column("place").to_numpy()
            if len(place):
                like = place[1:] == place[:-1]
                keep = np.concatenate([[True], like]) | np.concatenate([like, [True]])
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("at")], ["node", "at"]).filter(pa.array(keep))

    ordered = places.repartitionByRange("place", "node").sortWithinPartitions("place")
    found = ordered.mapInArrow(shared, T.StructType([classes.schema["node"], T.StructField("at", T.IntegerType())]))
    return found.groupBy("node").agg(F.collect_set("at").alias("ats"))


def _neighbours(
    placed: DataFrame, depth: int, matches: int, percent: int, width: int, crowded_width: int, bits: bool = False
) -> DataFrame:
    """Scan orders: ``placed`` has (o, key, sketch, node, n, component). Gives
    rows (a, b, m) of candidate pairs with their matching values (the bytes of
    the sketch, or its bits), and (a, null, region) for classes in crowded
    regions. Without a sketch the key is one.

    Partitions are ranges of (order, key, node), so any run of equal keys can
    be split; what faces each other over the edge of two ranges is compared in
    a second, small step."""
    node = placed.schema["node"].dataType
    pair = T.StructType([T.StructField("a", node), T.StructField("b", node), T.StructField("m", T.LongType())])
    row = [T.StructField("o", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("node", node), T.StructField("n", T.LongType()), T.StructField("component", node)]
    scanned = T.StructType([*pair.fields, T.StructField("edge", T.LongType()), T.StructField("place", T.IntegerType()), *row])
    columns = ["o", "key", "sketch", "node", "n", "component"]

    def found(t: pa.Table, fresh: int) -> list:
        """Pairs whose second row is at ``fresh`` or later, and crowded rows."""
        keys = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        sketch = keys
        if bits:
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        o, n = t.column("o").to_numpy(), t.column("n").to_numpy()
        # Rows with one prefix in one order, as one number.
        head = np.zeros(len(o), np.uint64) + o.astype(np.uint64)
        for k in range(depth):
            head = (head << np.uint64(8)) | keys[:, k]
        component = t.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        node_of = t.column("node").combine_chunks()
        first, second, matching, crowd = [], [], [], np.zeros(0, np.int64)
        end = len(o)
        beyond = np.zeros(end, bool)
        if end > width:
            far = np.flatnonzero(head[width:] == head[:-width])
            beyond[far] = beyond[far + width] = True
            crowd = far[far + width >= fresh]
            crowd = np.unique(np.concatenate([crowd, crowd + width]))
        for step in range(1, min(width, end - 1) + 1):
            i = np.arange(max(fresh, step), end)
            i = i[(head[i] == head[i - step]) & (component[i] != component[i - step])]
            if step > crowded_width:
                i = i[~(beyond[i] & beyond[i - step])]
            j = i - step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            close = small * 100 >= large * percent
            i, j = i[close], j[close]
            if bits:
                same = 64 * sketch.shape[1] - np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
            else:
                same = (sketch[i] == sketch[j]).sum(1)
            close = same >= matches
            first.append(j[close])
            second.append(i[close])
            matching.append(same[close])
        joined = lambda xs: pa.array(np.concatenate([np.zeros(0, np.int64), *xs]))
        # Crowded rows follow the pairs; their region stands in for the matches.
        a = node_of.take(joined([*first, crowd]))
        b = pa.concat_arrays([node_of.take(joined(second)), pa.nulls(len(crowd), node_of.type)])
        return [a, b, joined([*matching, H.mix(head[crowd]).view(np.int64)])]

    def rows_of(pairs, t, edge=0, place=()):
        """Output batch: pairs and crowded rows, rows at the edge of the range."""
        m, e = len(pairs[0]), t.num_rows
        blank = lambda kind, size: pa.nulls(size, kind)
        arrays = [pa.concat_arrays([x, blank(x.type, e)]) for x in pairs]
        arrays.append(pa.concat_arrays([blank(pa.int64(), m), pa.array([edge] * e, pa.int64())]))
        arrays.append(pa.concat_arrays([blank(pa.int32(), m), pa.array(list(place), pa.int32())]))
        for c in columns:
            own = t.column(c).combine_chunks()
            arrays.append(pa.concat_arrays([blank(own.type, m), own]))
        return pa.RecordBatch.from_arrays(arrays, scanned.names)

    def run_of(t: pa.Table, step: int) -> int:
        """Rows from the first (or last) one on that share its prefix."""
        prefix = [(o, key[:depth]) for o, key in zip(t.column("o").to_pylist(), t.column("key").to_pylist())][::step]
        return next((i for i, p in enumerate(prefix) if p != prefix[0]), len(prefix))

    def scan(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, head = None, None
        for b in batches:
            t = pa.Table.from_batches([b]).select(columns)
            if not t.num_rows:
                continue
            before = 0 if held is None else held.num_rows
            whole = t if held is None else pa.concat_tables([held, t])
            yield rows_of(found(whole, before), whole.slice(0, 0))
            head = whole.slice(0, width) if head is None or head.num_rows < width else head
            held = whole.slice(max(0, whole.num_rows - width))
        if held is not None:
            none = held.column("node").combine_chunks().slice(0, 0)
            none = [none, none, pa.array([], pa.int64())]
            # The first rows meet the last ones of the range before, if their prefix goes on.
            head, held = head.slice(0, run_of(head, 1)), held.slice(held.num_rows - run_of(held, -1))
            yield rows_of(none, head, part, range(head.num_rows))
            yield rows_of(none, held, part + 1, range(-held.num_rows, 0))

    def over_edge(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        return pa.table(found(group.select(columns), int((group.column("place").to_numpy() < 0).sum())), ["a", "b", "m"])

    ordered = placed.select(columns).repartitionByRange("o", "key", "node").sortWithinPartitions("o", "key", "node")
    out = materialize(ordered.mapInArrow(frugal(scan), scanned), "neighbours")
    facing = out.where("edge IS NOT NULL").groupBy("edge").applyInArrow(over_edge, pair)
    return out.where("edge IS NULL").select("a", "b", "m").unionByName(facing)


def _shingled(rows: DataFrame, size: int) -> DataFrame:
    """Rows (d, t, ...) with their shingle set ``s`` in place of the text."""
    kept = [f for f in rows.schema if f.name != "t"]

    def shingled(batches):
        for b in batches:
            made = [s.tobytes() for s in shingle_sets(b.column("t"), size)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(made, pa.binary())], [*(f.name for f in kept), "s"])

    return rows.mapInArrow(frugal(shingled), T.StructType([*kept, T.StructField("s", T.BinaryType())]))


def _confirmed(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (u, v) of the pairs (a, b, ca, cb) whose full shingle sets are
    similar enough."""
    pairs = materialize(pairs.select("a", "b", "ca", "cb"), "to-confirm")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = materialize(nodes, "to-confirm")

    known = materialize(_shingled(_texts_of(rows, nodes).select("d", "t"), size), "shingle-sets")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType
    # The sets of crowded regions are few and their pairs many.
    sets = known.agg(F.sum(F.octet_length("s") + 32).alias("bytes"), F.count("*").alias("n")).first()
    few = (sets["bytes"] or 0) <= BROADCAST_BYTES
    if few:
        moved = pairs.count() * 2 * (sets["bytes"] or 0) // max(1, sets["n"])
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, moved // COMPARED_BYTES)
        pairs = pairs.repartition(int(parts), "a", "b")
    x, y = known.select(F.col("d").alias("a"), F.col("s").alias("x")), known.select(F.col("d").alias("b"), F.col("s").alias("y"))
    joined = (
        pairs.join(F.broadcast(x) if few else x, "a")
        .join(F.broadcast(y) if few else y, "b")
        .select(F.col("ca").alias("u"), F.col("cb").alias("v"), "x", "y")
    )
    return joined.mapInArrow(compare, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def _named(pairs: DataFrame, components: DataFrame | None) -> DataFrame:
    """Pairs (a, b, ...) between different components, with these (ca, cb). A
    node without component is one of its own."""
    if components is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    with_a = pairs.join(components.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    both = with_a.join(components.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return both.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def _linked(found: DataFrame, components: DataFrame | None, rows: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Components after confirming candidates: twice the likeliest pair of each
    node, which joins most of what belongs together, then every pair that is
    still between two components. None is left out: a pair within a component
    cannot change it."""
    pairs = found.where("b IS NOT NULL AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = materialize(pairs.agg(F.max("m").alias("m")), "pairs")
    for step in ("likeliest", "likeliest", "all"):
        left = materialize(_named(left.select("a", "b", "m"), components), "pairs")
        if left.isEmpty():
            break
        chosen = left
        if step == "likeliest":
            pair = ["a", "b", "m", "ca", "cb"]
            ways = left.select(F.col("a").alias("u"), *pair).unionByName(left.select(F.col("b").alias("u"), *pair))
            best = ways.groupBy("u").agg(F.max(F.struct("m", "a", "b", "ca", "cb")).alias("p"))
            chosen = materialize(best.select("p.a", "p.b", "p.ca", "p.cb").distinct(), "chosen")
            left = left.join(chosen, ["a", "b"], "left_anti")
        merged = materialize(connected_components(_confirmed(chosen, rows, size, percent)), "components")
        components = _merged(components, merged)
    return components


def _crowded(found: DataFrame, components: DataFrame | None) -> DataFrame:
    """(node, region, component) of the classes of crowded regions."""
    near = found.where("b IS NULL").select(F.col("a").alias("node"), F.col("m").alias("region")).distinct()
    if components is not None:
        near = near.join(components, "node", "left")
    else:
        near = near.withColumn("component", F.col("node"))
    return materialize(near.withColumn("component", F.coalesce("component", "node")), "crowded")


def _unsettled(found: DataFrame, components: DataFrame | None) -> DataFrame:
    """(node, component) of the classes of crowded regions whose component meets
    another one in such a region. Regions are joined by component, not by class."""
    near = _crowded(found, components)
    parts = materialize(near.select("region", "component").distinct(), "parts")
    mixed = parts.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    unsettled = parts.join(mixed, "region", "left_semi").select("component").distinct()
    return near.select("node", "component").distinct().join(unsettled, "component", "left_semi").select("node", "component")


def _mixed(found: DataFrame, components: DataFrame | None) -> DataFrame:
    """(node, region, component) of the classes of crowded regions that are not
    all in one component. Written once: what compares them reads them several times."""
    near = _crowded(found, components)
    mixed = near.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return materialize(near.join(mixed.select("region"), "region", "left_semi"), "mixed")


class _Sets:
    """Shingle sets of a group, smallest first: of element k, ``row`` and
    ``code``, its place among the group's ``shingles``."""

    def __init__(self, sets: pa.Array, names: np.ndarray, shingles: np.ndarray | None = None):
        size = np.array([len(s) // 8 for s in sets.to_pylist()], np.int64) if len(sets) else np.zeros(0, np.int64)
        order = np.argsort(size, kind="stable")
        self.size, self.names = size[order], names[order]
        values = np.frombuffer(b"".join(sets.take(pa.array(order)).to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(size)), self.size)
        if shingles is None:
            self.shingles, code = np.unique(values, return_inverse=True)
            self.row, self.code = row, code
        else:
            self.shingles = shingles
            code = np.minimum(np.searchsorted(shingles, values), len(shingles) - 1)
            known = shingles[code] == values
            self.row, self.code = row[known], code[known]

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.row, [lo, hi])
        return self.row[a:b] - lo, self.code[a:b]


def _shared(x: tuple, y: tuple, rows: int, columns: int) -> np.ndarray:
    """How many elements each of ``rows`` sets has in common with each of
    ``columns`` others."""
    kinds = np.intersect1d(x[1], y[1])
    counts = np.zeros((rows, columns), np.float32)
    for lo in range(0, len(kinds), BLOCK_COLUMNS):
        own = kinds[lo : lo + BLOCK_COLUMNS]
        sides = []
        for (row, code), n in ((x, rows), (y, columns)):
            at = np.minimum(np.searchsorted(own, code), len(own) - 1)
            known = own[at] == code
            side = np.zeros((n, len(own)), np.float32)
            side[row[known], at[known]] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    return counts


def _alike(x: _Sets, y: _Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of x and of y, different ones, between which there is a link."""
    found = [np.zeros((0, 2), np.int64)]
    for a in range(0, len(x.size), BLOCK_ROWS):
        e = min(a + BLOCK_ROWS, len(x.size))
        own = x.part(a, e)
        # Sets of other lengths cannot be similar enough.
        first = int(np.searchsorted(100 * y.size, percent * x.size[a], "left"))
        last = int(np.searchsorted(percent * y.size, 100 * x.size[e - 1], "right"))
        for lo in range(first, last, BLOCK_ROWS):
            hi = min(lo + BLOCK_ROWS, last)
            apart = x.names[a:e, None] != y.names[None, lo:hi]
            if not apart.any():
                continue
            shared = _shared(own, y.part(lo, hi), e - a, hi - lo).astype(np.int64)
            union = x.size[a:e, None] + y.size[None, lo:hi] - shared
            i, j = np.nonzero(apart & (100 * shared >= percent * union))
            found.append(np.unique(np.stack([x.names[a + i], y.names[lo + j]], 1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _compared(crowded: DataFrame, components: DataFrame | None, rows: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Components after comparing all classes of each group of regions of
    ``crowded`` (node, region, component). Sets are sent to all tasks a part at
    a time, so a group of any size is spread; none is left out."""
    least = crowded.groupBy("region").agg(F.min("node").alias("v"))
    groups = connected_components(crowded.join(least, "region").select(F.col("node").alias("u"), "v"))
    groups = groups.select("node", F.col("component").alias("g"))
    nodes = materialize(crowded.select("node", "component").distinct().join(groups, "node"), "crowd")
    if nodes.isEmpty():
        return components
    kind = rows.schema["d"].dataType
    texts = _texts_of(rows, nodes).select("g", "d", "component", "t")
    sets = materialize(_shingled(texts, size).repartitionByRange("g", "d").sortWithinPartitions("g", "d"), "crowd-sets")
    total = sets.agg(F.sum(F.octet_length("s") + 64).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // SENT_BYTES))
    pair = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    links = None
    for part in range(parts):
        sent = sets.where(F.pmod(F.xxhash64("d"), F.lit(parts)) == part).toArrow().combine_chunks()

        def compare(batches, sent=sent):
            group_of = sent.column("g").to_pylist()
            names = sent.column("component").combine_chunks().dictionary_encode()
            place = {c: i for i, c in enumerate(names.dictionary.to_pylist())}
            members: dict = {}
            for i, g in enumerate(group_of):
                members.setdefault(g, []).append(i)
            held, other = None, None
            for b in batches:
                at = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("s")).to_numpy(zero_copy_only=False))])
                for lo, hi in H.row_groups(at, 4 << 20):
                    t = b.slice(lo, hi - lo)
                    own = t.column("g").to_pylist()
                    cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
                    for a, e in zip(cuts, cuts[1:]):
                        g = own[a]
                        if g not in members:
                            continue
                        if held != g:
                            those = pa.array(members[g])
                            code = names.indices.take(those).to_numpy()
                            held, other = g, _Sets(sent.column("s").combine_chunks().take(those), code.astype(np.int64))
                        mine = t.column("component").slice(a, e - a).to_pylist()
                        # Components that no sent set has get numbers beyond.
                        beyond: dict = {}
                        code = [place[c] if c in place else beyond.setdefault(c, len(place) + len(beyond)) for c in mine]
                        every = {**{i: c for c, i in beyond.items()}, **{place[c]: c for c in mine if c in place}}
                        x = _Sets(t.column("s").slice(a, e - a), np.array(code, np.int64), other.shingles)
                        u, v = _alike(x, other, percent)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([every[i] for i in u.tolist()], b.schema.field("component").type), names.dictionary.take(pa.array(v))], ["u", "v"]
                        )

        found = materialize(sets.mapInArrow(compare, pair), "crowd-links")
        links = found if links is None else links.unionByName(found)
    merged = materialize(connected_components(links.distinct()), "components")
    return _merged(components, merged)


def _merged(components: DataFrame | None, merged: DataFrame) -> DataFrame:
    """Components after components (``node`` of ``merged``) became parts of others."""
    if components is None:
        return merged
    top = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = components.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = merged.join(components.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new.select("node", "component")), "components")


def link_documents(
    documents: DataFrame, document: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document row: ``document``, ``n_shingles``, ``component_id``
    (smallest id reachable by links, its own included) and ``kept``.

    A link joins two documents with ``100 * shared >= percent * union`` of their
    distinct shingles of ``words`` words. A text of fewer words is one shingle;
    a text without words, or null, has none and is linked with nothing. Rows of
    one id are one document with several texts. A row with null id is linked
    with nothing, has no component and is kept. No rows give no rows. Other
    columns are ignored, whatever their names.
    """
    rows = documents.select(F.col(document).alias("d"), F.col(text).alias("t"))
    described = materialize(_described(rows, words), "signatures")
    own = described.where("n > 0 AND d IS NOT NULL")
    classes = materialize(own.groupBy("digest", "n", "signature").agg(F.min("d").alias("node")), "classes")
    rows = rows.where("d IS NOT NULL")

    threshold = percent / 100
    depth, matches = least_depth(threshold), least_matches(threshold)
    step = VALUES // ORDERS

    turned = F.concat(F.expr(f"substring(signature, at * {step} + 1)"), F.expr(f"substring(signature, 1, at * {step})"))

    def in_orders(signed: DataFrame) -> DataFrame:
        """(o, key, ...): the signature begun at every ``step``-th value, in the
        orders ``ats`` if given."""
        key = turned if "sketch" not in signed.columns else F.expr(f"substring(turned, 1, {CROWDED_KEY})")
        ats = F.col("ats") if "ats" in signed.columns else F.sequence(F.lit(0), F.lit(ORDERS - 1))
        at = signed.withColumn("at", F.explode(ats)).withColumn("turned", turned)
        sketch = F.col("sketch") if "sketch" in signed.columns else F.lit(None).cast("binary")
        order = (F.col("base") * ORDERS + F.col("at")).cast("int")
        return at.select(order.alias("o"), key.alias("key"), sketch.alias("sketch"), "node", "n", "component")

    placed = classes.join(_places_with_company(classes, turned, depth), "node")
    first = materialize(
        _neighbours(
            in_orders(placed.select("signature", "node", "n", F.col("node").alias("component"), F.lit(0).alias("base"), "ats")),
            depth, matches, percent, WIDTH, CROWDED_FIRST,
        ),
        "candidates",
    )
    components = _linked(first, None, rows, words, percent)

    # Regions that step 2 did not compare in full and that are not yet whole.
    crowd = materialize(_unsettled(first, components), "crowd")
    if not crowd.isEmpty():
        kind = rows.schema["d"].dataType
        signed = T.StructType(
            [T.StructField("base", T.IntegerType()), T.StructField("signature", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("node", kind), T.StructField("n", T.LongType()), T.StructField("component", kind)]
        )

        def sign(batches):
            for b in batches:
                base, signatures, sketches, at, n = [], [], [], [], []
                for i, s in enumerate(shingle_sets(b.column("t"), words)):
                    own = [signature(s, seed) for seed in range(1, BIT_SIGNATURES + 1)]
                    sketch = np.packbits(np.frombuffer(b"".join(own), np.uint8) & 1).tobytes()
                    for seed in range(CROWDED_SIGNATURES):
                        base.append(seed)
                        signatures.append(own[seed])
                        sketches.append(sketch)
                        at.append(i)
                        n.append(len(s))
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base, pa.int32()), pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary()), b.column("d").take(at), pa.array(n, pa.int64()), b.column("component").take(at)],
                    signed.names,
                )

        fresh = materialize(_texts_of(rows, crowd).select("d", "t", "component").mapInArrow(frugal(sign), signed), "crowd-signatures")
        matches = least_matches(threshold, VALUES * BIT_SIGNATURES, 2)
        second = _neighbours(in_orders(fresh), depth, matches, percent, CROWDED_WIDTH, CROWDED_FIRST, bits=True)
        components = _linked(second, components, rows, words, percent)
        components = _compared(_mixed(second, components), components, rows, words, percent)

    if components is None:
        components = classes.select("node", F.col("node").alias("component")).limit(0)
    of_class = classes.join(components, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component"))
    # A class may have a third of all rows: the join can be split, a group can't.
    joined = described.withColumn("c", F.when(F.col("d").isNotNull() & (F.col("n") > 0), F.col("digest"))).join(
        of_class.select(F.col("digest").alias("c"), "component"), "c", "left"
    )
    component = F.coalesce("component", "d")
    return joined.select(
        F.col("d").alias(document),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("d") == component, F.lit(True)).alias("kept"),
    )
