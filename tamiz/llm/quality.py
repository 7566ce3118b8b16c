"""Quality of documents by a factorisation machine.

A text is described by its hashed words (shares of all its words) and by
statistics of its structure and length. The machine scores them with weights
and low-rank pairwise interactions; the sum over all pairs of features takes
linear time by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tamiz.llm import hashing as H
from tamiz.llm.workers import frugal

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
RANK = 8
#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 8000
SLICE = 1 << 20

# Kinds of bytes that are counted per text.
_KIND = np.zeros(256, np.uint8)
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[[ord(c) for c in " \t\r\v\f"]] = 4
_KIND[0x0A] = 5
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 6
_KIND[ord("!")] = 7
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 8
_KIND[0x80:] = 9
KINDS = 10
STATISTICS = KINDS + 7


def features(texts: pa.Array):
    """Yields (first row, words' buckets, offsets of rows, statistics) for
    ranges of rows of a text column; null counts as empty."""
    data, at = H.text_bytes(texts)
    for lo, hi in H.row_groups(at, SLICE):
        own = at[lo : hi + 1]
        rows = hi - lo
        hashes, start, end = H.byte_runs(data, own, H.SPACE)
        word_at = np.searchsorted(start, own)
        n = np.diff(word_at)
        size = np.diff(own)
        counts = np.zeros((rows, KINDS))
        for a in range(int(own[0]), int(own[-1]), SLICE):
            b = min(a + SLICE, int(own[-1]))
            row = np.searchsorted(own, np.arange(a, b), "right") - 1 if rows > 1 else np.zeros(b - a, np.int64)
            counts += np.bincount(row * KINDS + _KIND[data[a:b]], minlength=rows * KINDS).reshape(rows, KINDS)
        row = np.repeat(np.arange(rows), n)

        def share(marked: np.ndarray) -> np.ndarray:
            return np.bincount(row[: len(marked)][marked], minlength=rows) / np.maximum(n, 1)

        same = [np.append((hashes[k:] == hashes[:-k]) & (row[k:] == row[:-k]), np.zeros(k, bool))[: len(hashes)] if len(hashes) > k else np.zeros(len(hashes), bool) for k in (1, 2)]
        length = end - start
        statistics = np.column_stack(
            [
                counts / np.maximum(size, 1)[:, None],
                np.log1p(size) / 10,
                np.log1p(n) / 10,
                np.log1p(counts[:, 5]) / 5,
                np.bincount(row, length, rows) / np.maximum(n, 1) / 10,
                share(length == 1),
                share(same[0]),
                share(same[1]),
            ]
        )
        yield lo, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), word_at - word_at[0], statistics


class Machine:
    """Weights of buckets and statistics, and their factors."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = BUCKETS + STATISTICS
        self.bias = 0.0
        self.weight = np.zeros(size)
        self.factor = rng.normal(0, 0.05, (size, RANK))
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def _rows(self, buckets: np.ndarray, at: np.ndarray, statistics: np.ndarray):
        """Sparse rows: (row, feature, value) with repeated words summed."""
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        cell, times = np.unique(row * BUCKETS + buckets, return_counts=True)
        row, feature = cell // BUCKETS, cell % BUCKETS
        value = 2 * times / n[row]
        z = np.clip((statistics - self.mean) / self.scale, -4, 4) / 2
        rows = len(n)
        return (
            np.concatenate([row, np.repeat(np.arange(rows), STATISTICS)]),
            np.concatenate([feature, np.tile(BUCKETS + np.arange(STATISTICS), rows)]),
            np.concatenate([value, z.ravel()]),
        )

    def _logit(self, row, feature, value, rows):
        part = self.factor[feature] * value[:, None]
        total = np.column_stack([np.bincount(row, part[:, f], rows) for f in range(RANK)])
        square = np.bincount(row, (part * part).sum(1), rows)
        linear = np.bincount(row, self.weight[feature] * value, rows)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - square), total

    def score(self, buckets, at, statistics) -> np.ndarray:
        rows = len(at) - 1
        logit, _ = self._logit(*self._rows(buckets, at, statistics), rows)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def fit(self, parts: list[tuple], labels: np.ndarray, steps: int = 1500, rate: float = 0.05, seed: int = 3) -> None:
        """About ``steps`` adaptive gradient steps over shuffled batches; both
        kinds of labels keep their shares, so that scores are probabilities."""
        statistics = np.concatenate([p[2] for p in parts])
        self.mean, self.scale = statistics.mean(0), statistics.std(0) + 1e-6
        known = []
        for buckets, at, s in parts:
            row, feature, value = self._rows(buckets, at, s)
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(len(at)))
            known.extend((feature[order[a:b]], value[order[a:b]]) for a, b in zip(cut, cut[1:]))
        rng = np.random.default_rng(seed)
        self.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-3), np.full(self.factor.shape, 1e-3), 1e-3
        for _ in range(-(-steps * 64 // max(len(labels), 640))):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), 64):
                batch = order[lo : lo + 64]
                n = [len(known[i][0]) for i in batch]
                row = np.repeat(np.arange(len(batch)), n)
                feature = np.concatenate([known[i][0] for i in batch])
                value = np.concatenate([known[i][1] for i in batch])
                logit, total = self._logit(row, feature, value, len(batch))
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)
                some, where = np.unique(feature, return_inverse=True)
                push = error[row] * value
                w = np.bincount(where, push, len(some)) + 1e-5 * self.weight[some]
                inner = total[row] - self.factor[feature] * value[:, None]
                v = np.column_stack([np.bincount(where, push * inner[:, f], len(some)) for f in range(RANK)])
                v += 1e-4 * self.factor[some]
                seen_w[some] += w * w
                seen_v[some] += v * v
                seen_b += error.sum() ** 2
                self.weight[some] -= rate * w / np.sqrt(seen_w[some])
                self.factor[some] -= rate * v / np.sqrt(seen_v[some])
                self.bias -= rate * error.sum() / np.sqrt(seen_b)

    def to_bytes(self) -> bytes:
        head = np.concatenate([[self.bias], self.mean, self.scale, self.weight])
        return np.concatenate([head, self.factor.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Machine:
        made, x = cls(), np.frombuffer(raw)
        made.bias = float(x[0])
        made.mean, made.scale = x[1 : 1 + STATISTICS], x[1 + STATISTICS : 1 + 2 * STATISTICS]
        at = 1 + 2 * STATISTICS
        made.weight = x[at : at + BUCKETS + STATISTICS]
        made.factor = x[at + BUCKETS + STATISTICS :].reshape(-1, RANK)
        return made


def fit_quality(
    documents: DataFrame,
    labels: DataFrame,
    document: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn=None,
    sample: int = SAMPLE,
) -> Machine:
    """Machine fitted on at most ``sample`` labelled documents, chosen by a hash
    of the id. ``learn`` is a condition on the document id. Rows without id or
    label teach nothing; without any labels the machine scores 0.5."""
    usable = labels.select(F.col(document).alias("d"), F.col(label).cast("int").alias("y")).where(
        F.col("d").isNotNull() & F.col("y").isNotNull()
    )
    if learn is not None:
        usable = usable.where(learn(F.col("d")))
    chosen = usable.orderBy(F.xxhash64("d"), "d", "y").limit(sample)
    rows = documents.select(F.col(document).alias("d"), F.col(text).alias("t")).join(F.broadcast(chosen), "d")

    def train(batches):
        parts, labels = [], []
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            for lo, buckets, at, statistics in features(b.column("t")):
                parts.append((buckets, at, statistics))
                labels.append(y[lo : lo + len(at) - 1])
        made = Machine()
        if parts:
            made.fit(parts, np.concatenate(labels).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([made.to_bytes()], pa.binary())], ["model"])

    # Copies of one id would add rows beyond the sample: one of each is enough.
    bounded = rows.groupBy("d", "y").agg(F.min("t").alias("t")).repartition(1).sortWithinPartitions("d", "y")
    found = bounded.select("t", "y").mapInArrow(frugal(train), "model binary").collect()
    return Machine.from_bytes(found[0]["model"]) if found else Machine()


def score_quality(documents: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``documents`` with ``score`` (0 to 1, higher is better)
    and ``predicted`` (1 from ``threshold`` on). Scores depend on the text
    alone; a null or empty text has the score of no words. Columns of these two
    names are replaced. No rows give no rows."""
    raw = machine.to_bytes()
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def scored(batches):
        model = Machine.from_bytes(raw)
        for b in batches:
            # A batch for each range of rows: the JVM holds one of them at a time.
            for lo, buckets, at, statistics in features(b.column(text)):
                score = model.score(buckets, at, statistics)
                own = b.slice(lo, len(score))
                yield pa.RecordBatch.from_arrays([own.column(c) for c in kept] + [pa.array(score)], [*kept, "score"])

    out = documents.select(kept).mapInArrow(frugal(scored), schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
