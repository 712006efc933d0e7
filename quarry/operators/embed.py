"""Embedding hooks: a pseudo-random one, and a model given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_embedding(text: Column, dims: int = 1536) -> Column:
    """A unit vector drawn from a generator seeded by the text's sha256: equal for equal
    texts and without meaning otherwise."""

    @F.pandas_udf("array<float>")
    def draw(seeds: pd.Series) -> pd.Series:
        import numpy as np

        def one(seed):
            if seed is None or seed != seed:
                return None
            v = np.random.default_rng(int(seed)).standard_normal(dims).astype(np.float32)
            return v / (np.linalg.norm(v) or 1.0)

        return seeds.map(one)

    return draw(F.conv(F.substring(F.sha2(text, 256), 9, 8), 16, 10).cast("long"))


def model_embedding(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 128) -> DataFrame:
    """rows (id, text) with embedding by a model, called with up to ``size`` texts."""

    def each(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts = pdf["text"].tolist()
            made = [v for a in range(0, len(texts), size) for v in embed(texts[a : a + size])]
            yield pdf[["id", "text"]].assign(embedding=[list(map(float, v)) for v in made])

    return rows.select("id", "text").mapInPandas(each, f"id {rows.schema['id'].dataType.simpleString()}, text string, embedding array<float>")


@dataclass
class Embedder:
    """A model of the caller, or without one the pseudo-random vectors."""

    dims: int = 1536
    call: Callable[[list[str]], list[list[float]]] | None = None
    name: str = ""
    size: int = 128

    @property
    def provider(self) -> str:
        return "hash" if self.call is None else "model"

    @property
    def model(self) -> str:
        return self.name if self.call is not None else "sha256-random"

    def embedded(self, rows: DataFrame) -> DataFrame:
        """rows (chunk_id, embed_text) with embedding."""
        if self.call is None:
            return rows.withColumn("embedding", hash_embedding(F.col("embed_text"), self.dims))
        made = model_embedding(rows.select(F.col("chunk_id").alias("id"), F.col("embed_text").alias("text")), self.call, self.size)
        return made.select(F.col("id").alias("chunk_id"), F.col("text").alias("embed_text"), "embedding")
