"""An inverted file over vectors: cells around centroids, four-bit codes in each, and exact scores of the best codes.

Centroids, the codes' range and the number of cells that a search probes are fitted on a bounded sample; all vectors are
assigned and coded. A search reads the codes of its nearest cells, an eighth of what the vectors take, and then the vectors of
``RERANK`` times as many rows as it returns, whose scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vector

#: Vectors that an index is fitted on at most, those first by a hash of their keys; the most cells; rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS = 16384, 1024, 12
#: Of the neighbours of sampled vectors, the share that must lie in the cells probed; neighbours and vectors looked at.
TARGET, NEIGHBOURS, ASKED = 0.98, 10, 512
#: Rows scored exactly for each result.
RERANK = 4
#: Codes of a block, and queries of a pack, that meet in a task.
BLOCK, PACK = 8192, 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those without length stay zero."""
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * size:
        raise ValueError("vectors of different sizes")
    return flat.reshape(len(column), size)


@dataclass(frozen=True)
class Fitted:
    """centroids: unit vectors, one a cell; low, step: of codes; probes: cells that a search reads."""

    centroids: np.ndarray
    low: float
    step: float
    probes: int

    @property
    def size(self) -> int:
        return self.centroids.shape[1]

    def cells(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def code(self, unit: np.ndarray) -> np.ndarray:
        """Two components a byte."""
        levels = np.clip(np.round((unit - self.low) / self.step), 0, 15).astype(np.uint8)
        if levels.shape[1] % 2:
            levels = np.concatenate((levels, np.zeros((len(levels), 1), np.uint8)), 1)
        return (levels[:, ::2] << 4) | levels[:, 1::2]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        levels = np.empty((len(codes), codes.shape[1] * 2), np.float32)
        levels[:, ::2], levels[:, 1::2] = codes >> 4, codes & 15
        return levels[:, : self.size] * np.float32(self.step) + np.float32(self.low)


def fit(vectors: DataFrame, key: str, *, sample: int = SAMPLE, target: float = TARGET, seed: int = 7) -> Fitted:
    """From at most ``sample`` vectors. An empty table gives one cell of one dimension."""
    own = vectors.where("embedding IS NOT NULL").select(F.col(key).alias("k"), "embedding")
    found = own.orderBy(F.xxhash64("k"), "k").limit(sample).toArrow().column("embedding").combine_chunks()
    if not len(found):
        return Fitted(np.zeros((1, 1)), 0.0, 1.0, 1)
    unit, rng = _unit(_matrix(found, len(found[0]))), np.random.default_rng(seed)
    number = max(1, min(MOST_CELLS, int(np.sqrt(len(unit)) * 2)))
    centroids = unit[rng.choice(len(unit), number, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = (unit @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        some = np.bincount(nearest, minlength=number) > 0
        centroids[some] = _unit(sums[some])
    fitted = Fitted(centroids, float(unit.min()), max(float(unit.max() - unit.min()) / 15, 1e-9), number)
    asked = rng.choice(len(unit), min(ASKED, len(unit)), replace=False)
    scores = unit[asked] @ unit.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(unit) - 1)]
    place = np.empty((len(asked), number), np.int64)
    np.put_along_axis(place, fitted.cells(unit[asked], number), np.arange(number)[None].repeat(len(asked), 0), 1)
    ranks = np.take_along_axis(place, fitted.cells(unit)[:, 0][near], 1).ravel()
    probes = int(np.quantile(ranks, target, method="higher")) + 1 if len(ranks) else 1
    return Fitted(centroids, fitted.low, fitted.step, probes)


class InvertedFile:
    """``root/codes`` and ``root/vectors``, both in partitions by cell; a hot cell is several files."""

    def __init__(self, spark: SparkSession, root: str, key: str, fitted: Fitted):
        self.spark, self.root, self.key, self.fitted = spark, root, key, fitted

    @classmethod
    def write(cls, vectors: DataFrame, key: str, root: str, fitted: Fitted | None = None) -> InvertedFile:
        """Codes all vectors that aren't null; another size than the fitted one is an error."""
        fitted = fitted or fit(vectors, key)
        own = vectors.where("embedding IS NOT NULL").select(key, F.col("embedding").cast("array<float>").alias("embedding"))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _unit(_matrix(batch.column(1), fitted.size))
                yield pa.record_batch([pa.array(fitted.cells(unit)[:, 0], pa.int32()), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in fitted.code(unit)], pa.binary())], names=["cell", key, "embedding", "code"])

        table = own.mapInArrow(coded, f"cell int, {key} {dict(own.dtypes)[key]}, embedding array<float>, code binary")
        spread = table.repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("cell", key)
        spread.select("cell", key, "embedding").write.partitionBy("cell").parquet(f"{root}/vectors")
        stored = vectors.sparkSession.read.parquet(f"{root}/vectors")
        again = stored.select(key, "embedding").mapInArrow(coded, f"cell int, {key} {dict(own.dtypes)[key]}, embedding array<float>, code binary")
        again.select("cell", key, "code").repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).write.partitionBy("cell").parquet(f"{root}/codes")
        return cls(vectors.sparkSession, root, key, fitted)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def search(self, query: Sequence[float], k: int, *, allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
        """key, score, rk: as vector.search, but neighbours outside the cells probed may be missing. ``allowed`` (key) holds
        before the limit; where the cells probed have fewer than k such rows, all are read."""
        fitted, key, n = self.fitted, self.key, RERANK * k
        target = _unit(np.asarray(query, np.float64)[None])
        cells = [int(c) for c in fitted.cells(target, fitted.probes)[0]]

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), -1)
                score = fitted.decode(codes) @ target[0].astype(np.float32)
                top = np.sort(np.argsort(-score, kind="stable")[:n])
                yield pa.record_batch([batch.column(key).take(pa.array(top)), batch.column("cell").take(pa.array(top)), pa.array(score[top].astype(np.float64))], names=[key, "cell", "about"])

        def of(codes: DataFrame) -> list:
            codes = codes if allowed is None else codes.join(allowed.select(key), key, "left_semi")
            return codes.select(key, "cell", "code").mapInArrow(best, f"{key} {dict(codes.dtypes)[key]}, cell int, about double").orderBy(F.desc("about"), key).limit(n).collect()  # n rows

        rough = of(self._table("codes").where(F.col("cell").isin(*cells)))
        if len(rough) < k and len(cells) < len(fitted.centroids):
            rough = of(self._table("codes"))
        if not rough:
            return self._table("vectors").where("false").select(key, F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rk"))
        exact = self._table("vectors").where(F.col("cell").isin(*{r["cell"] for r in rough}) & F.col(key).isin(*[r[key] for r in rough]))
        return vector.search(exact, query, [key], k, digits=digits)

    def search_all(self, queries: DataFrame, k: int, *, digits: int = 6) -> DataFrame:
        """(query, key, score, rk) for each of ``queries`` (query, embedding); a query's own key is left out.

        Queries go to the cells that they probe, in packs; packs meet a cell's codes block by block. Each query's best codes
        of all its cells are then scored exactly.
        """
        fitted, key = self.fitted, self.key
        asked = queries.where("embedding IS NOT NULL").select("query", F.col("embedding").cast("array<float>").alias("embedding"))
        kinds = dict(asked.dtypes)["query"], dict(self._table("codes").dtypes)[key]

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = fitted.cells(_unit(_matrix(batch.column(1), fitted.size)), fitted.probes)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["query", "embedding", "cells"])

        spread = asked.mapInArrow(probed, f"query {kinds[0]}, embedding array<float>, cells array<int>").select("query", "embedding", F.explode("cells").alias("cell"))
        pieces = lambda df, by, size: df.withColumn("piece", F.pmod(F.xxhash64(by), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("cell")) / size))))
        packs = pieces(spread, "query", PACK).groupBy("cell", "piece").agg(F.collect_list(F.struct("query", "embedding")).alias("asked")).drop("piece")
        counts = self._table("codes").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
        blocks = self._table("codes").join(F.broadcast(counts), "cell").withColumn("piece", F.pmod(F.xxhash64(key), F.col("n"))).groupBy("cell", "piece").agg(F.collect_list(F.struct(key, "code")).alias("rows")).drop("piece")

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    asked_, rows = batch.column("asked")[i].values, batch.column("rows")[i].values
                    codes = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(len(rows), -1)
                    unit = _unit(_matrix(asked_.field("embedding"), fitted.size)).astype(np.float32)
                    score = unit @ fitted.decode(codes).T
                    n = min(RERANK * k + 1, len(rows))
                    top = np.argsort(-score, axis=1, kind="stable")[:, :n]
                    q = pa.array(np.repeat(np.arange(len(asked_)), n))
                    yield pa.record_batch([asked_.field("query").take(q), rows.field(key).take(pa.array(top.ravel())), pa.array(np.take_along_axis(score, top, 1).ravel().astype(np.float64))], names=["query", "key", "about"])

        rough = packs.join(blocks, "cell").mapInArrow(met, f"query {kinds[0]}, key {kinds[1]}, about double").where("query <> key")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "key"))
        chosen = rough.withColumn("place", place).where(F.col("place") <= RERANK * k).drop("place", "about")
        vectors = self._table("vectors").select(F.col(key).alias("key"), F.col("embedding").alias("theirs"))
        both = chosen.join(asked.withColumnRenamed("embedding", "own"), "query").join(vectors, "key")
        scored = both.select("query", "key", F.round(vector.cosine(F.col("theirs"), F.col("own")), digits).alias("score"))
        rk = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")).cast("bigint")
        return scored.withColumn("rk", rk).where(F.col("rk") <= k).withColumnRenamed("key", key)

    def read_share(self, k: int) -> float:
        """Bytes of codes and vectors that a search of k reads on average, as a share of the vectors' bytes, if cells were
        asked for as often as they are large."""
        counts = {r["cell"]: r["n"] for r in self._table("codes").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_CELLS
        total, fitted = sum(counts.values()), self.fitted
        if not total:
            return 0.0
        share = 0.0
        near = fitted.cells(fitted.centroids, fitted.probes)
        for cell, n in counts.items():
            share += n / total * sum(counts.get(int(c), 0) for c in near[cell]) / total
        return share / 8 + RERANK * k / total


def exact(vectors: DataFrame, queries: DataFrame, key: str, k: int, *, digits: int = 6) -> DataFrame:
    """(query, key, score, rk): what ``search_all`` approximates, from all vectors; for measurements. Queries meet vectors in
    blocks of both."""
    kinds = dict(queries.dtypes)["query"], dict(vectors.dtypes)[key]
    number = lambda df, size: max(1, -(-df.count() // size))
    n_packs, n_blocks = number(queries, PACK), number(vectors, BLOCK)
    dealt = lambda df, c, n, name: df.where("embedding IS NOT NULL").select(F.pmod(F.xxhash64(c), F.lit(n)).alias("piece"), F.struct(F.col(c).alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).alias("r")).groupBy("piece").agg(F.collect_list("r").alias(name))
    packs = dealt(queries, "query", n_packs, "asked").select("asked", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("piece"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q, v = batch.column("asked")[i].values, batch.column("rows")[i].values
                size = len(q.field("embedding")[0])
                score = np.round(_unit(_matrix(q.field("embedding"), size)) @ _unit(_matrix(v.field("embedding"), size)).T, digits)
                ids = v.field("id")
                order = np.argsort(np.array(ids.to_pylist()), kind="stable")
                top = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, : k + 1]]
                row = pa.array(np.repeat(np.arange(len(q)), top.shape[1]))
                yield pa.record_batch([q.field("id").take(row), ids.take(pa.array(top.ravel())), pa.array(np.take_along_axis(score, top, 1).ravel())], names=["query", key, "score"])

    found = packs.join(dealt(vectors, key, n_blocks, "rows"), "piece").mapInArrow(met, f"query {kinds[0]}, {key} {kinds[1]}, score double").where(F.col("query") != F.col(key))
    rk = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key)).cast("bigint")
    return found.withColumn("rk", rk).where(F.col("rk") <= k)


def recall(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row (recall): the share of the exact neighbours that were found; 1 where there are none."""
    hits = wanted.select("query", key).join(found.select("query", key).distinct().withColumn("hit", F.lit(1)), ["query", key], "left")
    return hits.agg(F.when(F.count("*") > 0, F.count("hit") / F.count("*")).otherwise(1.0).alias("recall"))
