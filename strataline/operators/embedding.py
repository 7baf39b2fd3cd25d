"""Embeddings of texts by a provider: batches of texts to token vectors, pooled, cleaned and normalised.

A provider is a function of a list of texts that gives one matrix (tokens x dimensions) for each, or one vector
(pooling None). It runs in the tasks, so it must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from ..shipping import ship

BATCH = 8
POOLINGS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "cls": lambda m: m[0], "mean": lambda m: m.mean(0), "max": lambda m: m.max(0), "mean_sqrt_len": lambda m: m.sum(0) / np.sqrt(len(m)), "last_token": lambda m: m[-1],
}


def normalised_text(text: str | None) -> str:
    """Dedented, stripped, no blanks at line ends; a blank text is one space."""
    return "\n".join(x.rstrip() for x in dedent(text or "").strip().splitlines()) or " "


def encode(texts: list[str | None], provider: Callable, pooling: str | None = "mean", batch: int = BATCH) -> list[list[float]]:
    """Unit vectors of the texts in their order; texts of about one length share a batch, and a wrong number of results is an error."""
    clean = [normalised_text(t) for t in texts]
    order = sorted(range(len(clean)), key=lambda k: len(clean[k]))
    out: list = [None] * len(clean)
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        found = provider([clean[k] for k in part])
        if len(found) != len(part):
            raise ValueError(f"the provider gave {len(found)} embeddings for {len(part)} texts")
        for k, x in zip(part, found, strict=True):
            v = np.asarray(x, np.float64)
            v = np.nan_to_num(POOLINGS[pooling](v) if pooling else v, nan=0.0, posinf=0.0, neginf=0.0)
            norm = np.linalg.norm(v)
            out[k] = (v / norm if norm > 0 else v).tolist()
    return out


def with_embeddings(rows: DataFrame, provider: Callable, text: str = "text", name: str = "embedding", pooling: str | None = "mean", batch: int = BATCH) -> DataFrame:
    """rows with the vectors of a text column."""
    ship(rows.sparkSession)

    @pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.tolist(), provider, pooling, batch), index=texts.index, dtype=object)

    return rows.withColumn(name, embed(text))
