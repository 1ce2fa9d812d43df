"""User-supplied encoders run inside Spark tasks.

An encoder factory is called once per task and returns a function from a list of inputs (bytes or texts) to a list of
vectors, with None for an input it cannot read. Vectors come back unit length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.functions.vectors import l2_normalize
from reelgraph.operators.pooling import pool_vectors

Encoder = Callable[[list], list]
EPS = 1e-6


def _encode(encode: Encoder, inputs: list, state: dict) -> list:
    """Vectors in input order. A batch that fails is retried one by one, and so are all later batches of the task."""
    if state["batched"] and len(inputs) > 1:
        try:
            return list(encode(inputs))
        except Exception:
            state["batched"] = False
    out = []
    for one in inputs:
        try:
            out.append(encode([one])[0])
        except Exception:
            out.append(None)
    return out


def _unit(vector) -> list | None:
    if vector is None:
        return None
    v = np.asarray(vector, np.float64)
    return (v / (np.sqrt((v * v).sum()) + EPS)).astype(np.float32).tolist()


def embed(
    df: DataFrame, key: str, column: str, factory: Callable[[], Encoder], *, batch_size: int = 32
) -> DataFrame:
    """(key, embedding) for every row: null where the input is missing or unreadable. Results go by key, not position."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, state = factory(), {"batched": True}
        for batch in batches:
            vectors: list = [None] * len(batch)
            present = [i for i, x in enumerate(batch[column]) if x is not None]
            for start in range(0, len(present), batch_size):
                part = present[start:start + batch_size]
                for i, v in zip(part, _encode(encode, [batch[column].iat[i] for i in part], state), strict=True):
                    vectors[i] = _unit(v)
            yield pd.DataFrame({key: batch[key], "embedding": vectors})

    return df.select(key, column).mapInPandas(run, f"{key} {key_type}, embedding array<float>")


def embed_photos(photos: DataFrame, factory: Callable[[], Encoder], **options) -> DataFrame:
    """(path, embedding) of image files with their ``content``."""
    return embed(photos, "path", "content", factory, **options)


def embed_prompts(prompts: DataFrame, factory: Callable[[], Encoder], *, text: str = "prompt", **options) -> DataFrame:
    """``prompts`` with an embedding column. Each distinct text is encoded once.

    Prompts come out of lists in a row, which size estimates do not count; so the join asks for a merge, or it would
    broadcast them all.
    """
    texts = prompts.select(text).distinct().withColumn("_text", F.col(text))
    return prompts.join(embed(texts, text, "_text", factory, **options).hint("merge"), text)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull())


def query_vectors(prompt_vectors: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, embedding): renormalised mean over the prompts of a query.

    Queries are many and have few prompts each, which come spread by text. So rows move to their query before they are
    added up: sums by task would be about as many as the rows, and larger.
    """
    return pool_vectors(prompt_vectors.repartition(query_id), [query_id], eps=EPS)


def caption_query_vectors(queries: DataFrame, factory: Callable[[], Encoder], query_id: str = "query_id") -> DataFrame:
    """(query_id, embedding) for video search: the text and "a photo of " + text, added and normalised."""
    texts = queries.select(
        query_id, F.explode(F.array(F.col("text"), F.concat(F.lit("a photo of "), F.col("text")))).alias("prompt")
    )
    encoded = valid_vectors(embed_prompts(texts, factory))
    return pool_vectors(encoded, [query_id], how="sum", normalise=False).select(
        query_id, l2_normalize("embedding", eps=1e-9).alias("embedding")
    )
