"""Exact cosine top-k for batches of queries, and what is made of the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.predicates import similarity_score
from .nearest import ranked_hits, search

# Hits up to this many are sent to every task to fetch their texts.
_MAX_BROADCAST_HITS = 200_000


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    min_score: float = 0.3,
    threshold: str = "unrounded",
    keys: tuple[str, ...] = ("doc_name", "chunk_id"),
) -> DataFrame:
    """``(query_id, rank, *keys, score)``: the k nearest rows of each query.

    ``corpus`` has ``keys`` and ``embedding``, ``queries`` has ``query_id`` and
    ``embedding``. Ranks go by (similarity descending, keys). Rows below
    ``min_score`` are left out; ``threshold`` says whether the similarity is
    compared before ("unrounded") or after ("rounded") rounding to 4 decimals.
    Rows without a vector or with a zero vector have no similarity.

    Up to 16 MiB of query vectors go to every task; the corpus is scanned once
    and never shuffled, and each task keeps k rows per query. More queries meet
    the corpus in tiles, in one job and without the driver (see ``nearest``).
    """
    if threshold not in ("unrounded", "rounded"):
        raise ValueError("threshold is 'unrounded' or 'rounded'")
    floor = min_score if threshold == "unrounded" else min_score - 1e-4
    usable = queries.where(F.size("embedding") > 0).select("query_id", "embedding")
    measured = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    keys = list(keys)
    one = F.lit(0).alias("cell")
    found = search(
        corpus.where(F.size("embedding") > 0).select(one, *keys, "embedding"),
        usable.select(one, "query_id", "embedding"),
        asked=measured["n"], k=k, floor=floor, keys=keys, dim=measured["dim"] or 1, spread=True,
    )
    hits = ranked_hits(found, k, keys).withColumn("score", similarity_score(F.col("similarity")))
    passed = F.col("score" if threshold == "rounded" else "similarity") >= min_score
    return hits.where(passed).select("query_id", "rank", *keys, "score")


def with_text(
    hits: DataFrame, corpus: DataFrame, *, keys=("doc_name", "chunk_id"), at_most: int | None = None
) -> DataFrame:
    """Add ``text`` to hits. They are sent to every task only when ``at_most``
    says how few they are; otherwise the join is chosen by their size."""
    if at_most is not None and at_most <= _MAX_BROADCAST_HITS:
        hits = F.broadcast(hits)
    return corpus.select(*keys, "text").join(hits, list(keys)).select(*hits.columns, "text")


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    min_score: float = 0.3,
    threshold: str = "unrounded",
) -> DataFrame:
    """``(query_id, rank, doc_name, chunk_id, text, score)`` for every query.

    The search reads keys and vectors only; texts are fetched for the hits.
    """
    hits = top_k(corpus, queries, k=k, min_score=min_score, threshold=threshold)
    return with_text(hits, corpus, at_most=k * queries.count())


def context_blocks(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, context)``: cited text of the hits; a fixed sentence when
    there are none."""
    relevance = F.format_string("%.2f", F.bround("score", 2))
    part = F.concat(
        F.lit("[FUENTE "), F.col("rank").cast("string"), F.lit("] Documento: "), F.col("doc_name"),
        F.lit(" | Fragmento #"), F.col("chunk_id").cast("string"), F.lit(" | Relevancia: "),
        relevance, F.lit("\n"), F.col("text"),
    )
    # A query has at most k hits, so its list is short.
    blocks = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["part"]), fixed.CONTEXT_SEPARATOR)
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit(fixed.CONTEXT_EMPTY)).alias("context")
    )


def search_results(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, n_resultados, fragmentos)`` for every query."""
    listed = hits.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "rank",
                    F.struct(
                        F.col("doc_name").alias("documento"),
                        F.col("chunk_id").alias("fragmento_id"),
                        F.col("score").alias("relevancia"),
                        F.col("text").alias("texto"),
                    ).alias("fragmento"),
                )
            )
        ).alias("found")
    )
    found = F.transform("found", lambda f: f["fragmento"])
    return queries.select("query_id").join(listed, "query_id", "left").select(
        "query_id",
        F.coalesce(F.size(found), F.lit(0)).alias("n_resultados"),
        F.coalesce(found, F.array()).alias("fragmentos"),
    )


def retrieval_check(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``(query_id, expected_doc, position, passed)``: where the expected
    document first occurs among the hits."""
    at = hits.join(
        expected.select("query_id", F.col("expected_doc").alias("doc_name")), ["query_id", "doc_name"]
    ).groupBy("query_id").agg(F.min("rank").alias("position"))
    return expected.join(at, "query_id", "left").select(
        "query_id", "expected_doc", "position", F.col("position").isNotNull().alias("passed")
    )
