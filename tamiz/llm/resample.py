"""Documents drawn by their importance for a target distribution.

A text is a bag of word n-grams in hashed buckets. Each bucket has a gain, the
logarithm of how much more frequent it is in the target than in all documents;
a document's weight is the sum of the gains of its n-grams. Weights with Gumbel
noise, taken from a hash of the document's id, are ranked: the highest are a
draw without replacement in proportion to the documents' importance.

N-grams come from one scan of the text: separators collapse to single spaces,
then an overlapped regular expression, bounded by lookarounds, gives the span
of each n-gram, and the bytes of a span are hashed as they are. The buckets
found are written, 2 bytes a word, so that no text is scanned twice.
"""

from __future__ import annotations

import zlib
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tamiz.llm import hashing as H
from tamiz.session import materialize

BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024

#: A-Z folded, every byte that ends a word a space.
_PLAIN = np.where(H.NOT_ALNUM[H.FOLD], np.uint8(0x20), H.FOLD).tobytes()
_SPACES = regex.compile(rb" {2,}")
_SPAN = methodcaller("group")


def ngram_pattern(size: int) -> regex.Pattern:
    """Spans of ``size`` words in a text of single spaces. Overlapped matches
    begin one byte after one another, so the boundaries must be told."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (size - 1))


def spans(text: bytes, pattern: regex.Pattern):
    """All n-grams of a text, overlapping ones included, in order."""
    return map(_SPAN, pattern.finditer(_SPACES.sub(b" ", text.translate(_PLAIN)), overlapped=True))


def buckets_of(text: bytes, patterns: list[regex.Pattern], buckets: int):
    """Per size of n-grams, the bucket of each one."""
    for pattern in patterns:
        yield np.fromiter(map(zlib.crc32, spans(text, pattern)), np.uint32) % np.uint32(buckets)


def _texts(column: pa.Array):
    data, at = H.text_bytes(column)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield data[lo:hi].tobytes()


def scan(
    docs: DataFrame, document: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """(``document``, n_words, found) of every row: ``found`` holds the bucket
    of each n-gram of 1 to ``longest`` words, little-endian unsigned 32-bit, or
    16-bit if there are no more buckets than that."""
    patterns = [ngram_pattern(size) for size in range(1, longest + 1)]
    kind = number_type(buckets)
    schema = T.StructType(
        [
            T.StructField(document, docs.schema[document].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("found", T.BinaryType()),
        ]
    )

    def scanned(batches):
        for b in batches:
            words, found = [], []
            for t in _texts(b.column(1)):
                per_size = list(buckets_of(t, patterns, buckets))
                words.append(len(per_size[0]))
                found.append(b"".join(x.astype(kind).tobytes() for x in per_size))
            columns = [b.column(0), pa.array(words, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(document), F.col(text).cast("string")).mapInArrow(scanned, schema)


def number_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def count_buckets(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all rows of a scan per bucket; buckets without
    any have no row."""
    kind = number_type(buckets)

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for found in b.column(0):
                np.add.at(total, np.frombuffer(found.as_buffer(), kind), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    per_task = scanned.select("found").mapInArrow(counted, "bucket int, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, in thousandths of the natural logarithm, rounded
    down, from the counts of all documents and of the target; each bucket
    counts one more than it has. ``buckets`` numbers come to the driver."""
    spark = raw.sparkSession
    counts = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(F.broadcast(raw.withColumnRenamed("n", "s")), "bucket", "left")
        .join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left")
        .select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
        .toArrow()
    )
    order = np.argsort(counts.column("bucket").to_numpy())
    s, t = (counts.column(c).to_numpy()[order] for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(scanned: DataFrame, gains: np.ndarray, document: str = "doc_id") -> DataFrame:
    """(``document``, n_words, n_features, weight) of every row of a scan."""
    kind = number_type(len(gains))
    schema = T.StructType(
        [T.StructField(document, scanned.schema[document].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    )

    def weighed(batches):
        for b in batches:
            rows = np.zeros((b.num_rows, 2), np.int64)
            for i, found in enumerate(b.column(2)):
                found = np.frombuffer(found.as_buffer(), kind)
                rows[i] = len(found), gains[found].sum()
            columns = [b.column(0), b.column(1), pa.array(rows[:, 0]), pa.array(rows[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return scanned.select(document, "n_words", "found").mapInArrow(weighed, schema)


def gumbel(document: str, seed: int) -> Column:
    """Noise of a document, in thousandths, rounded down: from the first 32
    bits of a hash of the seed and its id (a null id as an empty text)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(document).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def with_ranks(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in this order, numbered within ranges
    of it that tasks sort on their own; of the ranges only their sizes meet."""
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(numbered.withColumn("at", F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumn("part", F.shiftright("at", 33))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return numbered.join(F.broadcast(bases), "part").withColumn("rank", rank).drop("at", "part", "base")


def resample(
    docs: DataFrame,
    target: DataFrame,
    document: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``document``, ``n_features``, ``weight``, ``score`` and ``rank`` of every
    row of ``docs``; ``rank`` is null unless the row is drawn. Drawn are
    ``percent`` of the rows with at least ``min_words`` words, rounded down.

    A null or empty text has no words and weight 0. Equal scores rank by the
    smaller id, null ids last. Rows that repeat an id are documents of their own
    with the same noise; those that also have the same text are interchangeable.
    An empty target makes the gains those of its absence; no documents give no
    rows. Other columns are ignored, whatever their names.
    """
    scanned = materialize(scan(docs, document, text, longest, buckets), "scanned")
    goal = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text"))
    wanted = scan(goal, "id", "text", longest, buckets)
    gains = bucket_gains(count_buckets(scanned, buckets), count_buckets(wanted, buckets), buckets)
    scored = weigh(scanned, gains, document).withColumn("score", F.col("weight") + gumbel(document, seed))
    scored = materialize(scored, "scored")
    enough = F.col("n_words") >= min_words
    drawn = scored.where(enough).count() * percent // 100
    order = (F.col("score").desc(), F.col(document).asc_nulls_last(), F.col("n_features"), F.col("weight"))
    ranked = with_ranks(scored.where(enough), *order)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("n_words")


def draw_documents(docs: DataFrame, target: DataFrame, document: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` of which the id is drawn, all columns as they are.
    A drawn id brings all rows that have it; rows without id are not drawn here."""
    drawn = resample(docs, target, document, **options).where("rank IS NOT NULL").select(document).distinct()
    return docs.join(drawn, document, "left_semi").select(docs.columns)
