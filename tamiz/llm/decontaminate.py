"""Passages of a benchmark inside documents, found word for word.

A set join with prefix filter. The shingles of an item window (runs of three
words) are ordered by rarity in the documents. A document that holds the whole
window holds all its shingles, so one of them, the rarest, is the prefix that
has to be joined. A match of it at a position fixes where the window would
start: it must lie inside the document (length and position bounds), and then
its words are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3

#: Windows that are broadcast together; more of them make more passes.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Words of a text with A-Z folded; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() folds more than A-Z, but not in texts of ASCII alone.
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # Only the first and the last part can be empty.
    parts = F.split(folded, WORD_BREAKS)
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    n = F.size(parts)
    last = F.when((n > 1) & (F.get(parts, n - 1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.greatest(n - first - last, F.lit(0)))


def _shingle(words: Column, at, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def _shingles(words: Column, size: int) -> Column:
    count = F.size(words) - (size - 1)
    return F.when(
        count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: _shingle(words, i, size))
    ).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, item: str, text: str, length: int) -> DataFrame:
    """Distinct windows of the items: ``window`` array of words, ``items`` that
    hold it. An item of fewer words, but not none, is one window."""
    w = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - length, F.lit(0))
    cut = w.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, length))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def _document_shingles(docs: DataFrame, sizes: list[int]) -> Column:
    """(size, position, hash) of all shingles of the sizes in use."""
    return [(size, _shingles(F.col("w"), size)) for size in sizes]


def _exploded(docs: DataFrame, size: int) -> DataFrame:
    return docs.select("*", F.posexplode(_shingles(F.col("w"), size)).alias("p", "h"))


def find_windows(
    documents: DataFrame,
    items: DataFrame,
    document: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    length: int = 10,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document row: ``document``, ``n_words``, ``hit_spans`` (array
    of struct(start, stop) in words, sorted, one per place where a window
    occurs) and ``items`` (sorted ids of items with an occurring window).

    A null or empty text has no words and no hits; an item without words
    matches nothing; equal items are each reported; a repeated document row
    gives a repeated result row. An empty benchmark leaves all documents clean.
    Other columns are ignored, whatever their names.

    Windows are broadcast in blocks of at most ``broadcast_bytes``; documents
    are read once per block, and once before to count shingles.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.col(document).alias("d"), F.xxhash64(text).alias("v"), words_of(F.col(text)).alias("w")
    ).select("d", "v", "w", F.size("w").alias("n"))
    windows = item_windows(items, item, item_text, length).withColumn("wid", F.xxhash64("window"))

    facts = windows.agg(
        F.sum(F.length(F.array_join("window", " ")) + 16 * F.size("window") + 64 * F.size("items")).alias("bytes"),
        F.collect_set(F.least(F.size("window"), F.lit(SHINGLE))).alias("sizes"),
    ).first()
    sizes = sorted(facts["sizes"])
    blocks = -(-(facts["bytes"] or 0) // broadcast_bytes)

    base = docs.select("d", "v", "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(None).cast(items.select(item).dtypes[0][1]).alias("item"))
    found = []
    for size in sizes:
        of_size = windows.where(F.least(F.size("window"), F.lit(SHINGLE)) == size)
        placed = of_size.select("wid", "window", "items", F.posexplode(_shingles(F.col("window"), size)).alias("o", "h"))
        for block in range(blocks):
            mine = placed.where(F.pmod("wid", F.lit(blocks)) == block) if blocks > 1 else placed
            vocabulary = F.broadcast(mine.select("h").distinct())
            counted = (
                docs.select(F.explode(_shingles(F.col("w"), size)).alias("h"))
                .join(vocabulary, "h")
                .groupBy("h")
                .agg(F.count("*").alias("seen"))
            )
            # The rarest shingle of each window is all of its prefix; a window
            # with a shingle that no document has can't occur.
            prefix = (
                mine.join(counted, "h", "left")
                .groupBy("wid", "window", "items")
                .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "o")).alias("r"))
                .where("r.seen > 0")
                .select(F.col("r.h").alias("h"), F.col("r.o").alias("o"), "window", "items")
            )
            at = F.col("p") - F.col("o")
            candidates = _exploded(docs, size).join(F.broadcast(prefix), "h").where(
                (at >= 0) & (at + F.size("window") <= F.col("n"))
            )
            exact = candidates.where(F.slice("w", at + 1, F.size("window")) == F.col("window"))
            found.append(
                exact.select("d", "v", "n", at.alias("start"), (at + F.size("window")).alias("stop"), F.explode("items").alias("item"))
            )
    rows = base
    for f in found:
        rows = rows.unionByName(f)
    per_document = rows.groupBy("d", "v", "n").agg(
        F.sum(F.when(F.col("start").isNull(), 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop")))).alias("hit_spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    each = per_document.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(F.col("d").alias(document), F.col("n").cast("long").alias("n_words"), "hit_spans", "items")


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans, each counted once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["stop"]).alias("end"),
            (a["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("sum"),
        ),
        lambda a: a["sum"],
    )


def decontaminate(documents: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """Digest of ``find_windows`` per document row: n_words, n_hit, n_items,
    items_sha256, contaminated."""
    document = columns.get("document", "doc_id")
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = covered(F.col("hit_spans"))
    return find_windows(documents, items, **columns).select(
        document,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
