"""Vectors for texts: a caller-supplied model, or hashed word counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.predicates import strip

EmbedBatch = Callable[[Sequence[str], str], Sequence[Sequence[float]]]

# How a model is told what a text is for.
DOCUMENT = "RETRIEVAL_DOCUMENT"
QUERY = "RETRIEVAL_QUERY"


def embed_column(
    df: DataFrame,
    embed_batch: EmbedBatch,
    *,
    text: str = "text",
    task_type: str = DOCUMENT,
    batch_size: int = 20,
    max_parallel: int | None = None,
) -> DataFrame:
    """Add ``embedding`` by calling ``embed_batch(texts, task_type)``.

    ``max_parallel`` bounds the number of tasks that call the model at once.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list[Sequence[float]] = []
            for at in range(0, len(texts), batch_size):
                part = texts.iloc[at : at + batch_size].tolist()
                got = embed_batch(part, task_type)
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts but {len(got)} vectors")
                vectors.extend(got)
            yield pd.Series([list(map(float, v)) for v in vectors], dtype=object)

    if max_parallel is not None:
        df = df.repartition(max_parallel)
    return df.withColumn("embedding", embed(F.col(text)))


def hashed_embedding(df: DataFrame, *, text: str = "text", dim: int = 256) -> DataFrame:
    """Add ``embedding``: unit-length hashed word counts. Needs no model."""
    words = F.split(strip(F.lower(F.col(text))), fixed.WHITESPACE_RUN)
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(
        df.withColumn("_words", words)
    )
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_words", "_tf", "_unit"
    )
