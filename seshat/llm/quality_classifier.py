"""Quality classifier: ordinal cumulative-link regression on hashed text, for graded ratings.

One weight vector scores a text; ordered thresholds cut the score into grades: the chance of a grade above k
is logistic(score - threshold k). The expected grade and the chance of the top grade select documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 18
#: Rated documents that the model is fitted from, at most: those first by a hash of their ids.
SAMPLE = 20_000
#: Buckets found in fewer rated documents weigh nothing.
MIN_RATED = 6
#: Documents are selected from this chance of the top grade.
SELECT = 0.3

_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


@lru_cache(1 << 18)
def bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % WIDTH


def features(text: str | None) -> list[int]:
    """Buckets of a text, each once: words in lower case, how often a mark stands, how often a word repeats the one before."""
    tokens = _WORD.findall((text or "").lower())
    found = Counter(tokens)
    total = max(1, len(tokens))
    parts = [t if t.isalnum() else f"m {t} {(64 * n // total).bit_length()}" for t, n in found.items()]
    parts.append(f"r {(64 * sum(map(eq, tokens, tokens[1:])) // total).bit_length()}")
    parts.append(f"n {total.bit_length() // 3}")
    return sorted(set(map(bucket, parts)))


@dataclass(frozen=True)
class Ordinal:
    """weights: of the buckets; thresholds: ascending, one fewer than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the chances of a grade above 0, above 1, and so on."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index])])
        score = sums[offsets[1:]] - sums[offsets[:-1]]
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def fit(index: np.ndarray, offsets: np.ndarray, grades: np.ndarray, n_grades: int, *, l2: float = 2e-4, rate: float = 0.1, rounds: int = 300) -> Ordinal:
    """Full-batch Adam on the log likelihood; thresholds are a first one and positive gaps, so they stay ordered."""
    n = len(grades)
    used = np.bincount(index, minlength=WIDTH) >= MIN_RATED
    owner = np.repeat(np.arange(n), np.diff(offsets))
    keep = used[index]
    number = np.cumsum(used) - 1
    col, owner = number[index[keep]], owner[keep]
    share = np.bincount(grades, minlength=n_grades) / n
    above = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(n_grades - 1))
    w = np.zeros(int(used.sum()) + n_grades - 1)
    k = len(w) - (n_grades - 1)
    w[k] = start[0]
    w[k + 1 :] = np.log(np.maximum(np.diff(start), 1e-3))
    balance = (1 / (n_grades * np.maximum(share, 1e-9)))[grades]
    balance /= balance.sum()
    mean, square = np.zeros_like(w), np.zeros_like(w)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        cuts = np.concatenate([[w[k]], w[k] + np.cumsum(np.exp(w[k + 1 :]))])
        score = np.bincount(owner, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))  # above each cut
        edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        chance = np.maximum(edge[rows, grades] - edge[rows, grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], 1)
        low, high = slope[rows, grades] / chance * balance, slope[rows, grades + 1] / chance * balance
        grad = l2 * w
        grad[:k] -= np.bincount(col, (low - high)[owner], k)
        by_cut = np.bincount(grades, low, n_grades + 1)[1:n_grades] - np.bincount(grades + 1, high, n_grades + 1)[1:n_grades]
        grad[k] += by_cut.sum()
        grad[k + 1 :] += np.exp(w[k + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(WIDTH)
    weights[used] = w[:k]
    return Ordinal(weights, np.concatenate([[w[k]], w[k] + np.cumsum(np.exp(w[k + 1 :]))]))


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [features(t) for t in column.to_pylist()]
    return np.fromiter(chain.from_iterable(parts), np.int32), np.concatenate([[0], np.cumsum(list(map(len, parts)), dtype=np.int64)])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, offsets = _features(batch.column(0))
        lists = [index[a:b].astype("<i4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(lists, pa.binary())], names=["id", "grade", "features"])


def grade(quality: Column, toxic: Column) -> Column:
    """0: toxic; 1: of low quality; 2: good."""
    return F.when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, *, id_column: str = "doc_id", text_column: str = "text", grade_column: str = "grade", n_grades: int = 3) -> Ordinal | None:
    """A model from at most ``sample`` rated documents; None if there are none.

    A document with several ratings has the lowest; rows with null ids or grades don't count.
    """
    own = ratings.select(ratings[id_column].alias("id"), ratings[grade_column].cast("int").alias("grade")).dropna()
    chosen = own.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id")).join(F.broadcast(chosen), "id").select("text", "id", "grade")
    rows = texts.mapInArrow(_feature_batches, f"id {dict(texts.dtypes)['id']}, grade int, features binary")
    found = rows.groupBy("id").agg(F.min(F.struct("grade", "features")).alias("r")).orderBy("id").select("r.*").toPandas()
    if found.empty:
        return None
    parts = [np.frombuffer(f, "<i4") for f in found["features"]]
    offsets = np.concatenate([[0], np.cumsum(list(map(len, parts)), dtype=np.int64)])
    return fit(np.concatenate(parts), offsets, found["grade"].to_numpy(np.int64), n_grades)


def rate(docs: DataFrame, model: Ordinal | None, least: float = SELECT, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, expected_grade, p_top (chance of the top grade), kept (p_top is at least ``least``).

    A null text is rated as an empty one, by its lack of words. Without a model the grades are null and all
    documents are kept. Repeated rows and ids give a row each; an empty table gives none; other columns of
    ``docs`` are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                nulls = pa.nulls(len(batch), pa.float64())
                yield pa.record_batch([batch.column(1), nulls, nulls, pa.array(np.ones(len(batch), bool))], names=["id", "expected_grade", "p_top", "kept"])
                continue
            tails = model.tails(*_features(batch.column(0))).round(6)
            yield pa.record_batch([batch.column(1), pa.array(tails.sum(1).round(6)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], names=["id", "expected_grade", "p_top", "kept"])

    texts = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id"))
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, expected_grade double, p_top double, kept boolean").withColumnRenamed("id", id_column)
