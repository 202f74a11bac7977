"""Models behind an interface: embedders, rerankers and language models, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[str], list[str]], list[float]]
Generate = Callable[[list[str]], list[str]]


def hashed_embedder(dim: int = 64) -> Embed:
    """Signed feature hashing of lower-case tokens, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for r, text in enumerate(texts):
            for token in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                out[r, h % dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """Share of a query's distinct tokens that the text has."""
    out = []
    for q, t in zip(queries, texts):
        own = set((q or "").lower().split())
        out.append(len(own & set((t or "").lower().split())) / len(own) if own else 0.0)
    return out


def extractive_model(prompts: list[str]) -> list[str]:
    """The prompt's last non-empty line: a stand-in that invents nothing."""
    return [next((x for x in reversed((p or "").splitlines()) if x.strip()), "") for p in prompts]


def embed_texts(text: Column, embed: Embed, batch: int = 32) -> Column:
    """The vector of each text, `batch` texts a call."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            made: list[list[float]] = []
            for lo in range(0, len(s), batch):
                made += embed([x or "" for x in s.iloc[lo : lo + batch]])
            yield pd.Series(made, dtype=object)

    return F.pandas_udf(run, "array<float>")(text)


def embed_missing(nodes: DataFrame, embed: Embed, text: str = "text", column: str = "embedding", batch: int = 32) -> DataFrame:
    """Fill null embeddings, `batch` texts a call; rows that have one aren't sent to the model."""

    todo = nodes.where(F.col(column).isNull()).withColumn(column, embed_texts(F.col(text), embed, batch))
    return nodes.where(F.col(column).isNotNull()).unionByName(todo)


def score_pairs(query: Column, text: Column, score: Score = overlap_scorer) -> Column:
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in frames:
            yield pd.Series(score(q.tolist(), t.tolist()), dtype=float)

    return F.pandas_udf(run, "double")(query, text)


def generate(prompt: Column, model: Generate = extractive_model) -> Column:
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield pd.Series(model(s.tolist()), dtype=object)

    return F.pandas_udf(run, "string")(prompt)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
