"""Language of a text by its nearest centroid.

A text is the TF-IDF vector of its hashed character sequences of 2 to 4 bytes,
of unit length. Each language has several centroids, found by clustering its
sample; the centroid nearest by cosine decides. A text that is much farther
from it than nearly all texts of its language and length are is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tamiz.llm import hashing as H
from tamiz.llm.workers import frugal
from tamiz.session import materialize

BITS = 13
SIZE = 1 << BITS
#: Documents per language that the centroids are fitted on, at most about.
SAMPLE = 600
CENTROIDS = 4
UNKNOWN = "und"
SLICE = 1 << 19
_ROWS = 64
_LENGTHS = 24
#: Counts of longer texts are those of so many bytes, so that a text has the
#: same vector however often it is repeated.
LONG = 4096
#: Clusters below the first share of a language's texts are left out; the second
#: share of the texts of a length may be junk. Texts that a bound is taken from.
STRAY, JUNK, ENOUGH = 0.02, 0.05, 60
#: The share of texts that are farther from the centroids than a new one's start.
SEED = 0.1

# Bytes that are no letters are one sign; those of letters beyond ASCII stay.
_SIGN = np.arange(256, dtype=np.uint64)
_SIGN[[i for i in range(128) if not chr(i).isalpha()]] = 0


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each hashed sequence occurs in each row."""
    rows = len(at) - 1
    total = np.zeros(rows * SIZE, np.float32)
    for a in range(int(at[0]), int(at[-1]), SLICE):
        # Sequences begin in [a, b) and may end after it.
        b = min(a + SLICE, int(at[-1]))
        x = _SIGN[data[a : min(b + 3, int(at[-1]))]]
        row = np.searchsorted(at, np.arange(a, b), "right") - 1
        left = at[row + 1] - np.arange(a, b)
        key = x.copy()
        for n in (2, 3, 4):
            key = key[:-1] * np.uint64(257) + x[n - 1 :]
            bucket = (key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
            whole = left[: len(key)] >= n
            m = min(len(key), b - a)
            cell = (row[:m] * SIZE + bucket[:m].astype(np.int64))[whole[:m]]
            total += np.bincount(cell, minlength=rows * SIZE)
    return total.reshape(rows, SIZE)


def vectors(texts: pa.Array, idf: np.ndarray):
    """Yields (first row, unit vectors, number of bytes) for ranges of rows;
    empty and null texts have zero vectors."""
    data, at = H.text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    for lo, hi in H.row_groups(at, SLICE):
        for a in range(lo, hi, _ROWS):
            own = at[a : min(a + _ROWS, hi) + 1]
            damp = LONG / np.maximum(np.diff(own), LONG)
            x = np.log1p(_counts(data, own) * damp[:, None].astype(np.float32)) * idf
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            yield a, x / np.maximum(norm, 1e-9), np.diff(own)


def _clusters(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means, started far apart, but not at the
    farthest texts, which may be strays."""
    # All begin with a single text: a mean would be nearest to nearly all.
    chosen = [x[int((x @ x.mean(0)).argmax())]]
    for _ in range(min(k, len(x)) - 1):
        near = (x @ np.array(chosen).T).max(1)
        chosen.append(x[int(np.argsort(near, kind="stable")[int(SEED * len(x))])])
    c = np.array(chosen)
    for _ in range(rounds):
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
        of = (x @ c.T).argmax(1)
        c = np.array([x[of == i].mean(0) if (of == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)


def _length_class(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(int), _LENGTHS - 1)


def _nearness(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each vector to the nearest of the clusters around ``c``, its own
    one taken without it."""
    of = (x @ c.T).argmax(1)
    sums = np.zeros((len(c), x.shape[1]), np.float64)
    np.add.at(sums, of, x)
    dot = x @ sums.T
    size = (sums * sums).sum(1)
    cosine = dot / np.maximum(np.sqrt(size), 1e-9)
    own = np.arange(len(x)), of
    unit = (x * x).sum(1)
    rest = np.sqrt(np.maximum(size[of] - 2 * dot[own] + unit, 0))
    cosine[own] = np.where(rest > 1e-4, (dot[own] - unit) / np.maximum(rest, 1e-9), 0)
    return cosine.max(1)


def _bounds(near: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Half the cosine that all but ``JUNK`` of the texts of a class of length
    have; a class with few texts borrows those of the classes around it, longer
    ones as if the cosine fell with the root of the length."""
    out = np.zeros(_LENGTHS)
    for i in range(_LENGTHS):
        reach = 0
        while (np.abs(kind - i) <= reach).sum() < min(ENOUGH, len(kind)):
            reach += 1
        inside = np.abs(kind - i) <= reach
        own = np.sort(near[inside] * 2.0 ** (np.minimum(i - kind[inside], 0) / 2))
        out[i] = own[int(JUNK * len(own))]
    # Longer texts are nearer: a class allows what the shorter ones do not need.
    return 0.5 * np.minimum.accumulate(out[::-1])[::-1]


class Languages:
    """Fitted centroids: ``names`` (language per centroid), ``centroids``,
    ``idf`` and ``least``, the least cosine per centroid and class of length."""

    def __init__(self, names: list[str], centroids: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.names, self.centroids, self.idf, self.least = names, centroids, idf, least


def fit_languages(
    documents: DataFrame, text: str = "text", lang: str = "lang", where=None, sample: int = SAMPLE, centroids: int = CENTROIDS
) -> Languages:
    """Centroids from about ``sample`` different texts per language, chosen by a
    hash of the text. ``where`` is a condition on the rows to learn from; rows
    with null language, or without a letter, teach nothing. Only the columns
    ``text`` and ``lang`` are read."""
    rows = documents if where is None else documents.where(where)
    usable = rows.select(F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    usable = usable.withColumn("h", F.xxhash64("l", "t"))
    counted = usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n"))
    # A text may have a third of all rows: its copies meet before the shuffle.
    chosen = (
        usable.join(F.broadcast(counted), "l")
        .where(F.pmod("h", F.lit(1_000_003)) < F.lit(1_000_003.0) * sample / F.col("n"))
        .groupBy("l", "h")
        .agg(F.min("t").alias("t"))
        .select("l", "t")
    )
    kept = materialize(chosen, "language-sample")

    def frequencies(group: pa.Table) -> pa.Table:
        df = np.zeros(SIZE)
        for _, x, _ in vectors(group.column("t").combine_chunks(), np.ones(SIZE, np.float32)):
            df += (x > 0).sum(0)
        return pa.table({"n": [group.num_rows], "df": [df.tobytes()]})

    found = kept.groupBy("l").applyInArrow(frequencies, "n long, df binary").collect()
    if not found:
        return Languages([], np.zeros((0, SIZE), np.float32), np.ones(SIZE, np.float32), np.zeros((0, _LENGTHS)))
    df = sum(np.frombuffer(r["df"]) for r in found)
    idf = np.log((1 + sum(r["n"] for r in found)) / (1 + df)).astype(np.float32) + np.float32(0.05)

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        parts, sizes = [], []
        for _, x, size in vectors(group.column("t").combine_chunks(), idf):
            parts.append(x.astype(np.float32))
            sizes.append(size)
        x, size = np.concatenate(parts), np.concatenate(sizes)
        c, learned = _clusters(x, centroids), x
        for _ in range(centroids if len(x) >= ENOUGH else 0):
            # A stray text would be a centroid for more of its kind.
            of = (learned @ c.T).argmax(1)
            large = np.bincount(of, minlength=len(c)) >= STRAY * len(x)
            if large.all():
                break
            learned = learned[large[of]]
            c = _clusters(learned, centroids)
        least = _bounds(_nearness(x, c), _length_class(size))
        return pa.table({"l": group.column("l").slice(0, 1), "c": [c.astype(np.float32).tobytes()], "least": [least.tobytes()]})

    fitted = sorted(kept.groupBy("l").applyInArrow(cluster, "l string, c binary, least binary").collect())
    names, all_centroids, least = [], [], []
    for r in fitted:
        c = np.frombuffer(r["c"], np.float32).reshape(-1, SIZE)
        names += [r["l"]] * len(c)
        all_centroids.append(c)
        least += [np.frombuffer(r["least"])] * len(c)
    return Languages(names, np.concatenate(all_centroids), idf, np.array(least))


def identify(documents: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """All columns of ``documents`` with ``lang_pred``, ``score`` (cosine to the
    nearest centroid, 0 to 1) and ``rejected``.

    Only the text counts. A text that is null or has no letter is ``und`` with
    score 0 and rejected; any other has a learned language, even if rejected.
    Equal cosines go to the language first in order. Columns of these three
    names are replaced. No rows give no rows; without any learned language all
    are ``und``.
    """
    made = ("lang_pred", "score", "rejected")
    kept = [c for c in documents.columns if c not in made]
    schema = T.StructType(
        [documents.schema[c] for c in kept]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    names, centroids, idf, least = languages.names, languages.centroids.T.copy(), languages.idf, languages.least

    def rows(b, lang, score, rejected):
        arrays = [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
        return pa.RecordBatch.from_arrays([b.column(c) for c in kept] + arrays, [*kept, *made])

    def predicted(batches):
        for b in batches:
            if not names:
                yield rows(b, [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool))
                continue
            letters = pc.fill_null(pc.match_substring_regex(b.column(text), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            # A batch for each range of rows: the JVM holds one of them at a time.
            for lo, x, size in vectors(b.column(text), idf):
                cosine = x.astype(np.float32) @ centroids
                best = cosine.argmax(1)
                near = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
                known = letters[lo : lo + len(best)]
                lang = [names[i] if k else UNKNOWN for i, k in zip(best, known)]
                rejected = ~known | (near < least[best, _length_class(size)])
                yield rows(b.slice(lo, len(best)), lang, np.where(known, near, 0.0), rejected)

    return documents.select(kept).mapInArrow(frugal(predicted), schema)
