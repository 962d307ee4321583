"""Quality rules: two fixed limits, then boosted trees over document statistics.

The trees are fitted from a bounded sample of labelled documents. Shares of symbols, of repeated words,
of repeated lines and of words equal to the one before can only lower the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosted_trees
from .text_statistics import COUNTS, statistics

#: Labelled documents that the trees are fitted from, at most: those first by a hash of their ids.
SAMPLE = 20_000
#: A document stays if the trees give it at least this chance of good quality.
KEEP = 0.5
FEATURES = {"symbols": -1, "repeats": -1, "dup_lines": -1, "same_next": -1, "word_length": 0, "distinct": 0, "digits": 0, "letters": 0, "log_words": 0}

_SCHEMA = ", ".join(f"{c} bigint" for c in COUNTS)


def features(counts: np.ndarray) -> np.ndarray:
    """Columns of FEATURES from columns of COUNTS."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64), strict=True))
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([c["n_symbols"] / chars, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_same_next"] / words, c["word_chars"] / words, c["n_distinct_words"] / words, c["n_digits"] / chars, c["n_letters"] / chars, np.log1p(c["n_words"])], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 20 words, or over 30 of 100 words in repeated windows."""
    words, repeats = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (words < 20) | (100 * repeats > 30 * words)


def _counts(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in column.to_pylist()], np.int64).reshape(-1, len(COUNTS))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns[1:], *map(pa.array, _counts(batch.column(0)).T)], names=[*batch.schema.names[1:], *COUNTS])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> boosted_trees.Forest | None:
    """Trees from at most ``sample`` labelled documents; None if no document has a label, or all have the same.

    A document with several labels has the largest; rows with null ids or labels don't count.
    """
    own = labels.select(labels[id_column].alias("id"), labels[label_column].alias("label")).dropna()
    chosen = own.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id")).join(F.broadcast(chosen), "id").select("text", "id", "label")
    counted = texts.mapInArrow(_count_batches, f"id {dict(texts.dtypes)['id']}, label {dict(texts.dtypes)['label']}, {_SCHEMA}")
    rows = counted.groupBy("id").agg(F.min(F.struct(*COUNTS, "label")).alias("r")).orderBy("id").select("r.*").toPandas().to_numpy(np.int64)
    label = rows[:, -1] > 0
    if label.all() or not label.any():
        return None
    return boosted_trees.fit(features(rows[:, :-1]), label.astype(np.float64), list(FEATURES.values()))


def _judged(forest: boosted_trees.Forest | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts(batch.column(0))
            failed = base_failed(counts)
            chance = 1 / (1 + np.exp(-forest.score(features(counts)))) if forest is not None else np.ones(len(counts))
            kept = ~failed & (chance >= least)
            columns = [*batch.columns[1:], *map(pa.array, counts.T[:5]), pa.array(failed), pa.array(kept), pa.array(np.round(chance, 6))]
            yield pa.record_batch(columns, names=[*batch.schema.names[1:], *COUNTS[:5], "base_failed", "kept", "chance"])

    return run


def judge(docs: DataFrame, forest: boosted_trees.Forest | None, least: float = KEEP, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, five counts, base_failed, kept, and the trees' chance of good quality.

    base_failed: fewer than 20 words, or over 30 % of them in 8-word windows that the text has twice or more.
    kept: not base_failed, and the chance is at least ``least``. Without trees all but base_failed stay.
    A null text has no words and fails. Repeated rows and ids give a row each; an empty table gives none;
    other columns of ``docs`` are not read. No shuffle.
    """
    texts = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id"))
    schema = f"id {dict(texts.dtypes)['id']}, {', '.join(f'{c} bigint' for c in COUNTS[:5])}, base_failed boolean, kept boolean, chance double"
    return texts.mapInArrow(_judged(forest, least), schema).withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, forest: boosted_trees.Forest | None, least: float = KEEP, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``judge`` keeps."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts(batch.column(at))
            chance = 1 / (1 + np.exp(-forest.score(features(counts)))) if forest is not None else np.ones(len(counts))
            yield batch.filter(pa.array(~base_failed(counts) & (chance >= least)))

    return docs.mapInArrow(run, docs.schema)
