"""Documents packed in order into training sequences.

The documents of a partition are one stream of ids. A shortest path over the
places where a sequence may end chooses the cuts: padding plus a penalty for
every cut inside a document, smaller after a sentence than within one. The
cheapest earlier place within reach is kept by a monotone queue, so the time is
linear in the places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tamiz.llm.tokens import default_path, encoder
from tamiz.llm.workers import frugal

#: Ids held back while choosing cuts; the last sequences of a stretch are
#: chosen again with the next one.
STRETCH = 1 << 20
KEPT_BACK = 8

#: Ids that a cut costs: after a sentence, and within one. Any sequence costs
#: SEQUENCE, so that short ones are not made where a long one does.
SENTENCE, INSIDE, SEQUENCE = 8.0, 96.0, 16.0
#: Without sentence ends, places for a cut are this far apart.
FORCED_GAP = 256


def padding(length: int, window: int) -> int:
    """Padding of a sequence: none at a power of two, else up to ``window``."""
    return 0 if length & (length - 1) == 0 else window - length


def choose_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the places (first and last included) that a cheapest series
    of sequences uses. Neighbouring places are at most ``window`` apart. Of
    equal costs the earlier place wins."""
    n = len(places)
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        at = np.searchsorted(places, places - size)
        for j in np.flatnonzero(places[at] == places - size):
            if at[j] < j:
                exact.setdefault(int(j), []).append(int(at[j]))
        size *= 2
    pos, fee = places.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    # Cost of the place plus its position: what a padded sequence from it adds.
    queue, value, head = [0], [float(pos[0])], 0
    for j in range(1, n):
        p = pos[j]
        while pos[queue[head]] < p - window:
            head += 1
        best, i = value[head] + window - p, queue[head]
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + fee[j] + SEQUENCE, i
        v = cost[j] + p
        while len(queue) > head and value[-1] > v:
            queue.pop()
            value.pop()
        queue.append(j)
        value.append(v)
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return np.array(path[::-1])


def cut_places(
    doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, window: int, free_tail: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Places 0..total where a sequence may end, with their penalties. The tail
    of a stream may be cut anywhere: powers of two need no padding there."""
    extra = np.arange(max(1, total - window), total) if free_tail else np.zeros(0, np.int64)
    known = np.unique(np.concatenate([[0], doc_ends, sentence_ends, [total]]))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > min(FORCED_GAP, window))
    step = min(FORCED_GAP, window)
    forced = [np.arange(known[i] + step, known[i + 1], step) for i in wide]
    places = np.unique(np.concatenate([known, extra, *forced]))
    penalty = np.full(len(places), INSIDE)
    penalty[np.searchsorted(places, sentence_ends)] = SENTENCE
    penalty[np.searchsorted(places, doc_ends)] = 0.0
    penalty[[0, -1]] = 0.0
    return places, penalty


class Stream:
    """Packs the documents of one partition, a stretch at a time."""

    def __init__(self, window: int, ends_sentence: np.ndarray, stretch: int):
        self.window, self.ends_sentence, self.stretch = window, ends_sentence, stretch
        self.ids = np.zeros(0, np.uint32)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        # Of documents not yet packed to their end: key, first id here, ids
        # packed before, all ids.
        self.docs: list[list] = []
        self.sequences = 0

    def add(self, key, ids: np.ndarray):
        self.docs.append([key, len(self.ids) + self.held, 0, len(ids)])
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.stretch:
            yield from self.flush(False)

    def flush(self, last: bool):
        ids = np.concatenate([self.ids, *self.waiting])
        self.waiting, self.held = [], 0
        if not len(ids):
            return
        begin = np.array([d[1] for d in self.docs])
        ends = np.append(begin[1:], len(ids))
        sentence = np.flatnonzero(self.ends_sentence[ids]) + 1
        places, penalty = cut_places(ends, sentence, len(ids), self.window, last)
        cuts = places[choose_cuts(places, penalty, self.window)]
        if not last:
            cuts = cuts[:-KEPT_BACK] if len(cuts) > KEPT_BACK + 1 else cuts[:1]
        done = int(cuts[-1])
        starts = np.unique(np.concatenate([cuts[:-1], begin[begin < done]]))
        stops = np.append(starts[1:], done)
        doc = np.searchsorted(begin, starts, "right") - 1
        sequence = np.searchsorted(cuts, starts, "right") - 1
        raw = ids[:done].astype("<u4").tobytes()
        for a, b, d, s in zip(starts.tolist(), stops.tolist(), doc.tolist(), sequence.tolist()):
            key, first, before, n = self.docs[d]
            yield key, a - first + before, b - a, n, self.sequences + s, a - int(cuts[s]), raw[4 * a : 4 * b]
        self.sequences += len(cuts) - 1
        self.ids = ids[done:]
        keep = int(np.searchsorted(ends, done, "right"))
        self.docs = self.docs[keep:]
        for d in self.docs:
            if d[1] < done:
                d[1], d[2] = 0, d[2] + done - d[1]
            else:
                d[1] -= done


def in_order(docs: DataFrame, document: str, text: str) -> DataFrame:
    """(doc, text) in ranges of ascending document ids, sorted, nulls first.
    Rows of one id may lie in several ranges, in the order they are read."""
    rows = docs.select(
        F.col(document).alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    return rows.repartitionByRange("doc", "row").sortWithinPartitions("doc", "row")


def pack(
    docs: DataFrame,
    document: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    window: int = 4096,
    end_id: int = 2,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row per piece of a document in a sequence: ``document``, ``start``
    and ``length`` in its ids, ``doc_tokens``, ``sequence_id``, ``offset`` in the
    sequence, ``ids`` (little-endian unsigned 32-bit). Ids of a document are
    those of its whole text and ``end_id``; each lies in exactly one piece.

    Sequences hold at most ``window`` ids. Sequence ids ascend with the
    documents and are unique, not gapless: each range of documents has its own
    upper part. A null or empty text is ``end_id`` alone; rows with a null or
    repeated id are documents of their own. No rows give no rows. Other columns
    are ignored, whatever their names.
    """
    path = tokenizer or default_path()
    key = docs.schema[document]
    schema = T.StructType(
        [
            T.StructField(document, key.dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def packed(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        encode = encoder(path)
        stream = Stream(window, encode.ends_sentence, stretch)
        names, types = [f.name for f in schema.fields], None

        def batch(rows):
            columns = list(zip(*rows))
            columns[4] = [first + s for s in columns[4]]
            arrays = [pa.array(columns[0], types)] + [pa.array(c, pa.int64()) for c in columns[1:6]]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(columns[6], pa.binary())], names)

        rows, size = [], 0
        for b in batches:
            types = b.schema.field("doc").type
            keys = b.column("doc").to_pylist()
            for lo, ids, at in encode.encode(b.column("text")):
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))
                    for row in stream.add(keys[lo + i], own):
                        rows.append(row)
                        size += len(row[6])
                if size > 16 << 20:
                    yield batch(rows)
                    rows, size = [], 0
        rows.extend(stream.flush(True))
        if rows:
            yield batch(rows)

    return in_order(docs, document, text).select("doc", "text").mapInArrow(frugal(packed), schema)
