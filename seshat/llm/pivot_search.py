"""Exact nearest vectors by inner product, with a table of distances to pivots.

|d(q, p) - d(v, p)| is no more than d(q, v) for every pivot p, so that the greatest of these over many pivots bounds the
inner product of q and v from above. Blocks of vectors, and then vectors, are left out where that bound is below the score
that a query has k times already; what is left is evaluated in the order of its bounds until no bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import Staging

#: Pivots, and the vectors that they are chosen from: a bounded sample, the first by a hash of their ids.
PIVOTS, SAMPLE = 32, 2048
#: Vectors of a block, queries of a pack, and blocks whose summaries meet a pack at once.
BLOCK, PACK, SUMMARIES = 1024, 256, 512
#: Candidates that are evaluated between two looks at the bounds.
SLICE = 256
#: Bounds are loosened by this share of the distances, as those are rounded; inner products are exact.
SLACK = 1e-6
#: Below this product of lengths, sums of products of integers are exact in double precision.
EXACT = 2.0**53


def _finite(c: Column) -> Column:
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _whole(lists: pa.ListArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) as integers, one row a vector, filled with zeros."""
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64)
    return out


def _distances(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    z, p = z.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((z * z).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (z @ p.T), 0))


def _pivots(z: np.ndarray, number: int) -> np.ndarray:
    """Vectors far from each other: the first, then always the one that is farthest from all before it."""
    chosen = [0]
    far = _distances(z, z[:1])[:, 0]
    while len(chosen) < min(number, len(z)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(z, z[chosen[-1:]])[:, 0])
    return z[chosen]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact as long as they fit in 64 bits."""
    longest = [float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))) for x in (a, b)]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if longest[0] * longest[1] < EXACT else a @ b.T


class Rows:
    """Vectors of a block or pack, as bytes: ids, places (numbers of rows), integers, distances to pivots, greatest score so far."""

    COLUMNS = "ids binary, places binary, z binary, near binary"

    def __init__(self, ids: np.ndarray, places: np.ndarray, z: np.ndarray, near: np.ndarray):
        self.ids, self.places, self.z, self.near = ids, places, z, near
        self.square = (z.astype(np.float64) ** 2).sum(1)

    @classmethod
    def read(cls, at, prefix: str, width: int) -> Rows:  # noqa: ANN001
        raw = [at(f"{prefix}{c}") for c in ("ids", "places", "z", "near")]
        ids = np.frombuffer(raw[0], np.int64)
        return cls(ids, np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.int64).reshape(len(ids), width), np.frombuffer(raw[3], np.float64).reshape(len(ids), -1))

    def bytes(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.places, self.z, self.near)]

    def some(self, which: np.ndarray) -> Rows:
        return Rows(self.ids[which], self.places[which], self.z[which], self.near[which])


def _bounds(squares: tuple[np.ndarray, np.ndarray], least: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """What an inner product is at most, if the distance is ``least`` at least: (|q|^2 + |v|^2 - d^2) / 2, loosened."""
    loose = np.maximum(least - SLACK * (reach + 1), 0)
    return (squares[0][:, None] + squares[1][None]) * (0.5 * (1 + 1e-12)) - loose * loose / 2 + SLACK


def bounds(q: Rows, v: Rows) -> np.ndarray:
    least = np.zeros((len(q.ids), len(v.ids)))
    for p in range(q.near.shape[1]):
        np.maximum(least, np.abs(q.near[:, p, None] - v.near[None, :, p]), out=least)
    reach = q.near.max(1, initial=0)[:, None] + v.near.max(1, initial=0)[None]
    return _bounds((q.square, v.square), least, reach)


def best(q: Rows, v: Rows, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score) of the k best of v for each of q, ties to smaller ids; those below ``floor`` may lack.

    Candidates come in slices by how far their bounds exceed what queries have, the farthest first, until none does.
    """
    limits = bounds(q, v)
    floor = floor.copy()
    order = np.argsort(-(limits - floor[:, None]).max(0), kind="stable")
    kept_score, kept_row = np.zeros((len(q.ids), 0), np.int64), np.zeros((len(q.ids), 0), np.int64)
    for at in range(0, len(order), SLICE):
        rest = order[at:]
        alive = np.flatnonzero((limits[:, rest] >= floor[:, None]).any(1))
        if not len(alive):
            break
        here = rest[:SLICE]
        score = np.full((len(q.ids), len(here)), np.iinfo(np.int64).min)
        score[alive] = products(q.z[alive], v.z[here])
        score[q.ids[:, None] == v.ids[None, here]] = np.iinfo(np.int64).min
        kept_score, kept_row = np.concatenate((kept_score, score), 1), np.concatenate((kept_row, np.broadcast_to(here, score.shape)), 1)
        if kept_score.shape[1] > 2 * k:
            # all that can be among the k best, ties at the end included, then by score and id
            least = -np.partition(-kept_score, k - 1, axis=1)[:, k - 1]
            floor = np.maximum(floor, np.where(least > np.iinfo(np.int64).min, least.astype(np.float64), -np.inf))
            keep = int((kept_score >= least[:, None]).sum(1).max())
            if keep < kept_score.shape[1]:
                place = np.argsort(-kept_score, axis=1, kind="stable")[:, :keep]
                kept_score, kept_row = np.take_along_axis(kept_score, place, 1), np.take_along_axis(kept_row, place, 1)
    row = np.repeat(np.arange(len(q.ids)), kept_score.shape[1])
    flat, cand = kept_score.ravel(), kept_row.ravel()
    real = (flat > np.iinfo(np.int64).min) & (flat >= floor[row])
    row, flat, cand = row[real], flat[real], cand[real]
    order = np.lexsort((v.ids[cand], -flat, row))
    row, flat, cand = row[order], flat[order], cand[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], cand[rank < k], flat[rank < k]


def _grouped(rows: DataFrame, size: int, pivots: int, width: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one cell: (block, cell, n, of Rows, low and high: distances to pivots, most: greatest square)."""
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one a pivot
    pieces = F.element_at(F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, max(1, -(-n // size))))), F.col("cell")) if counts else F.lit(1)
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("place"), pieces).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        take = lambda c, kind, shape: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(-1, shape)
        own = Rows(table.column("vec_id").to_numpy(), table.column("place").to_numpy(), take("z", np.int64, width), take("near", np.float64, pivots))
        cell, piece = table.column("cell")[0].as_py(), table.column("piece")[0].as_py()
        parts = [own.some(np.arange(a, min(a + size, len(own.ids)))) for a in range(0, len(own.ids), size)]
        out = [[(cell << 40) + (piece << 12) + k, cell, len(x.ids), *x.bytes(), x.near.min(0).tobytes(), x.near.max(0).tobytes(), float(x.square.max())] for k, x in enumerate(parts)]
        names = ("block", "cell", "n", "ids", "places", "z", "near", "low", "high", "most")
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.float64())
        return pa.table([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=list(names))

    return dealt.groupBy("cell", "piece").applyInArrow(pack, f"block bigint, cell int, n int, {Rows.COLUMNS}, low binary, high binary, most double")


def _reader(batch: pa.RecordBatch, i: int):  # noqa: ANN202
    return lambda name: batch.column(name)[i].as_py()


def search(vectors: DataFrame, *, every: int, k: int, scale: float, key: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, pack: int = PACK, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the greatest inner product of floor(scale * vector), for each row whose
    key is divisible by ``every``; ties go to smaller keys, and rows with the query's own key are left out.

    Null keys, null vectors and those with a component that is null or not finite take no part. Shorter vectors count as
    filled with zeros, empty ones too. A repeated query row is answered for itself; a repeated candidate is found again. An
    empty table gives no rows. Components are at most 2^62 in size and scores are right if they fit in 64 bits. Other columns
    of ``vectors`` are not read. Every query meets the summary of every block, and each block that it can't rule out.
    """
    spark = vectors.sparkSession
    staged = Staging(spark, "pivots")
    own = vectors.select(vectors[key].cast("bigint").alias("vec_id"), vectors[embedding].alias("embedding")).where(F.col("vec_id").isNotNull() & _finite(F.col("embedding")))
    width = max(1, own.agg(F.max(F.size("embedding"))).first()[0] or 0)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    chosen = _pivots(_whole(sample.column("embedding").combine_chunks(), scale, width), pivots) if len(sample) else np.zeros((1, width), np.int64)
    number = len(chosen)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _whole(batch.column("embedding"), scale, width)
            near = _distances(z, chosen)
            yield pa.record_batch([batch.column("vec_id"), batch.column("place"), pa.array([r.tobytes() for r in z], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary()), pa.array(near.argmin(1), pa.int32())], names=["vec_id", "place", "z", "near", "cell"])

    table = staged.write(own.withColumn("place", F.monotonically_increasing_id()).mapInArrow(measured, "vec_id bigint, place bigint, z binary, near binary, cell int"), "table")
    blocks = staged.write(_grouped(table, block, number, width), "blocks")
    packs = _grouped(table.where(F.pmod("vec_id", F.lit(every)) == 0), pack, number, width).drop("low", "high", "most", "n").withColumnsRenamed({c: f"q_{c}" for c in ("ids", "places", "z", "near")} | {"block": "pack"})

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs with what each query has k times in one block of its cell."""
        for batch in batches:
            floors = []
            for i in range(len(batch)):
                q = Rows.read(_reader(batch, i), "q_", width)
                floor = np.full(len(q.ids), -np.inf)
                if batch.column("ids")[i].is_valid:
                    row, _, score = best(q, Rows.read(_reader(batch, i), "", width), k, floor)
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    floor[row[rank == k - 1]] = score[rank == k - 1]
                floors.append(floor.tobytes())
            yield pa.record_batch([*(batch.column(c) for c in ("pack", "q_ids", "q_places", "q_z", "q_near")), pa.array(floors, pa.binary())], names=["pack", "q_ids", "q_places", "q_z", "q_near", "floor"])

    first = blocks.groupBy("cell").agg(F.min("block").alias("block")).join(blocks.select("block", "ids", "places", "z", "near"), "block").drop("block")
    columns = "pack bigint, q_ids binary, q_places binary, q_z binary, q_near binary, floor binary"
    packs = staged.write(packs.join(first, "cell", "left").mapInArrow(seeded, columns), "packs")

    groups = max(1, -(-blocks.count() // SUMMARIES))
    summaries = blocks.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), F.struct("block", "low", "high", "most").alias("s")).groupBy("group").agg(F.collect_list("s").alias("all"))
    meet = packs.select("pack", "q_z", "q_near", "q_ids", "q_places", "floor", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group")).join(summaries, "group")

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, block, which queries) where the block's summary rules out not all of them."""
        for batch in batches:
            for i in range(len(batch)):
                q, floor = Rows.read(_reader(batch, i), "q_", width), np.frombuffer(batch.column("floor")[i].as_py())
                found = batch.column("all")[i].as_py()
                low, high = (np.stack([np.frombuffer(s[c]) for s in found]) for c in ("low", "high"))
                least = np.zeros((len(q.ids), len(found)))
                for p in range(number):
                    at = q.near[:, p, None]
                    np.maximum(least, np.maximum(at - high[None, :, p], low[None, :, p] - at), out=least)
                limits = _bounds((q.square, np.array([s["most"] for s in found])), least, q.near.max(1)[:, None] + high.max(1)[None])
                reach = limits >= floor[:, None]
                some = np.flatnonzero(reach.any(0))
                yield pa.record_batch([pa.array([batch.column("pack")[i].as_py()] * len(some), pa.int64()), pa.array([found[j]["block"] for j in some], pa.int64()), pa.array([np.packbits(reach[:, j]).tobytes() for j in some], pa.binary())], names=["pack", "block", "which"])

    pairs = meet.mapInArrow(ruled, "pack bigint, block bigint, which binary")
    both = pairs.join(packs, "pack").join(blocks.select("block", "ids", "places", "z", "near"), "block")

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q, v = Rows.read(_reader(batch, i), "q_", width), Rows.read(_reader(batch, i), "", width)
                which = np.flatnonzero(np.unpackbits(np.frombuffer(batch.column("which")[i].as_py(), np.uint8), count=len(q.ids)))
                q = q.some(which)
                row, cand, score = best(q, v, k, np.frombuffer(batch.column("floor")[i].as_py())[which])
                yield pa.record_batch([pa.array(q.places[row]), pa.array(q.ids[row]), pa.array(v.ids[cand]), pa.array(score)], names=["place", "query_id", "vec_id", "score"])

    found = both.mapInArrow(evaluated, "place bigint, query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
