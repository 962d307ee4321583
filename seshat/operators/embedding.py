"""Embeddings from a pluggable model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 256


def hash_embedding(texts: Sequence[str], dimensions: int = 384) -> list[list[float]]:
    """A stand-in without a model: bytes of the text's SHA-256 scaled to [-1, 1], repeated to the size."""
    out = []
    for t in texts:
        raw = np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8) / 127.5 - 1
        out.append(np.resize(raw, dimensions).tolist())
    return out


def embed(rows: DataFrame, keys: Sequence[str], model: Callable[[Sequence[str]], list[list[float]]] = hash_embedding, *, text: str = "text") -> DataFrame:
    """keys and embedding; the model sees batches of at most BATCH texts. A null text is embedded as an empty one."""
    own = rows.select(*keys, F.coalesce(text, F.lit("")).alias("seshat_text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in own.dtypes if k != "seshat_text") + ", embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [v for a in range(0, len(frame), BATCH) for v in model(frame["seshat_text"].iloc[a : a + BATCH].tolist())]
            yield frame.drop(columns="seshat_text").assign(embedding=pd.Series(found, index=frame.index, dtype=object))

    return own.mapInPandas(run, schema)
