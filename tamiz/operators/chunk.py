"""Overlapping word windows over text, with character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed


def chunk_text(
    docs: DataFrame,
    *,
    doc_name: str = "doc_name",
    text: str = "text",
    chunk_size: int = 300,
    overlap: int = 50,
) -> DataFrame:
    """``(doc_name, chunk_id, text, char_start, char_end)`` for every window.

    A window starts every ``chunk_size - overlap`` words for as long as words
    are left. Offsets count characters of the text with its words joined by
    single blanks. Each document is cut inside its own row, so nothing is
    shuffled, and only finished chunks leave the row.
    """
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    step = max(1, chunk_size - overlap)
    words = docs.select(
        F.col(doc_name).cast("string").alias("doc_name"),
        # Whitespace at either end leaves an empty word behind.
        F.array_remove(F.split(F.col(text), fixed.WHITESPACE_RUN), "").alias("words"),
    )

    def joined(start, n):
        return F.array_join(F.slice("words", start + 1, n), " ")

    # No words, no windows. (A filter would split the text a second time.)
    n = F.size("words")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )
    texts = words.select(
        "doc_name", "words", F.transform(starts, lambda s: joined(s, chunk_size)).alias("texts")
    )
    # Characters from one start to the next: the chunk less what it shares with
    # the next one, or all words up to there when they share nothing.
    if step < chunk_size:
        strides = F.transform(
            "texts", lambda t, i: F.length(t) - F.length(joined((i + 1) * step, chunk_size - step))
        )
    else:
        strides = F.transform("texts", lambda t, i: F.length(joined(i * step, step)) + 1)
    cut = texts.select("doc_name", "texts", strides.alias("strides"))
    placed = cut.select(
        "doc_name",
        "texts",
        F.aggregate(
            F.slice("strides", F.lit(1), F.greatest(F.size("strides") - 1, F.lit(0))),
            F.array(F.lit(0)),
            lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)),
        ).alias("offsets"),
    )
    return placed.select(
        "doc_name",
        F.inline(
            F.transform(
                "texts",
                lambda t, i: F.struct(
                    i.alias("chunk_id"),
                    t.alias("text"),
                    F.get("offsets", i).alias("char_start"),
                    (F.get("offsets", i) + F.length(t)).alias("char_end"),
                ),
            )
        ),
    )
