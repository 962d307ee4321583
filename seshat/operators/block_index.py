"""A stored keyword index in blocks that know their greatest share of a score, so that a search leaves most of them unread.

Rows that a task reads one after the other are a range. A block holds the postings of one token in one range, or in several if
it has few in each, so that a rare token's ranges share a stored row; and beside them its front: the largest counts of the token
with the shortest rows that have them, which bound the token's share of any score in the block. A search adds these bounds up for each range, scores the ranges with the greatest sums first, and reads of the others
only those that can still reach the k best. Tokens that together can't lift a row to the k-th score are read last, in the ranges
where a row still can with what its other tokens give it.

An index may have several parts, written one after the other: rows in later parts, and rows that a later part's ``gone`` names
by their owner, replace those of earlier parts. Counts of documents stay exact, as each part keeps what it has taken away.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .keyword import B, FIELDS, IDF_FLOOR, K1, query_phrases, ranked

#: Rows of a range, of which an index of fewer rows has RANGES about; ranges whose blocks of a token one task writes at most; characters of text for each partition by token,
#: and the most such partitions, as packed rows and files are ranges times partitions, which shall not grow together; packed bytes that
#: a task unpacks and sorts at once; postings of a token with which a block is full, and takes no further range.
RANGE, RANGES, TOGETHER, BUCKET_CHARS, MOST_BUCKETS, UNPACKED, FULL = 1024, 256, 64, 1 << 23, 64, 1 << 22, 64
#: Blocks that a task writes, or reads the postings of, at once.
AT_ONCE, READ_AT_ONCE = 4096, 64
#: Ranges of the greatest bounds that are scored before the bounds of the others are looked at: so many, and if that leaves
#: more to be read than these, more.
FIRST_RANGES = (3, 9, 27)
#: Folders that a task writes at once, and the setting that says so.
MOST_WRITERS, _WRITERS = 64, "spark.sql.maxConcurrentOutputFileWriters"
#: A place is the position of a token in its field, times this, and the number of the field.
MOST_FIELDS = 16

HEADS = "token string, ranges array<bigint>, n bigint, total bigint, front array<struct<f:int,length:int>>"
#: A block's postings as numbers side by side, and the types of the five columns; ``at`` says which of the block's ranges, masks are
#: left out for a single field.
PACKED = ("at", "lengths", "counts", "masks", "places")
LISTS = "kinds string, " + ", ".join(f"{c} binary" for c in PACKED)
MINUS, STATISTICS = "token string, n bigint", "n bigint, total bigint, minus_n bigint, minus_total bigint, buckets int"
#: What a part without folds has taken away: tokens, and one row without a token, of the rows and tokens in all.
MINUS_ROWS = f"{MINUS}, total bigint"


@dataclass(frozen=True)
class Part:
    """A written part: its folder, and the owners whose rows in earlier parts it replaces (None: nobody's)."""

    root: str
    gone: DataFrame | None = None


def _chars(fields: Sequence[str]) -> Column:
    return reduce(add, (F.coalesce(F.length(f), F.lit(0)) for f in fields)).cast("bigint")


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    """Lists of values that begin at ``starts`` and end where the next one begins."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where the values of sorted columns change."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, (c[1:] != c[:-1] for c in sorted_)))))


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """The stable order by these keys, each of which is not negative and below 2 ** 32: numpy sorts 16 bits in linear time."""
    order = None
    for key in reversed(keys):
        top = int(key.max()) if len(key) else 0
        for shift in (0, 16)[: 1 + (top >> 16 > 0)]:
            digit = (key >> shift & 0xFFFF).astype(np.uint16)
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order


def _buckets(found: pa.Array, number: int) -> np.ndarray:
    """The partition of each token."""
    return np.fromiter(map(zlib.crc32, found.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(found)) % number


def _first(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin."""
    return np.cumsum(sizes) - sizes


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first``, one run after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - _first(sizes), sizes)


def _kind(x: np.ndarray) -> str:
    """The narrowest type that holds these numbers, which are not negative."""
    top = int(x.max()) if len(x) else 0
    return "B" if top < 1 << 8 else "H" if top < 1 << 16 else "I"


def _bytes(x: np.ndarray, starts: np.ndarray, kind: str) -> pa.Array:
    """The numbers from each of ``starts`` to the next one as bytes."""
    data = np.ascontiguousarray(x, np.dtype(f"<{kind}"))
    ends = pa.array(np.append(starts, len(x)) * data.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, ends.buffers()[1], pa.py_buffer(data)])


def _numbers(packed: Sequence[pa.Buffer], kinds: Sequence[str]) -> np.ndarray:
    """What ``_bytes`` has packed, one after the other."""
    return np.concatenate([np.frombuffer(b, np.dtype(f"<{k}")).astype(np.int64) for b, k in zip(packed, kinds, strict=True)])


#: Columns of packed numbers of a range and a bucket.
SHUFFLED = ("n", "who", "count", "place", "length")


@dataclass(frozen=True)
class Postings:
    """Postings by token and row: tokens, with the number of rows of each; row numbers and counts of entries; places of
    occurrences; and of each row the kept columns and its length."""

    tokens: pa.Array
    n: np.ndarray
    who: np.ndarray
    count: np.ndarray
    place: np.ndarray
    kept: list[pa.Array]
    length: np.ndarray

    @classmethod
    def of(cls, kept: Sequence[pa.Array], fields: Sequence[pa.Array]) -> Postings:
        """fields: each a list of tokens a row."""
        rows, field, pos, words = [], [], [], []
        for i, column in enumerate(fields):
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            rows.append(np.repeat(np.arange(len(sizes)), sizes))
            pos.append(np.arange(int(sizes.sum())) - np.repeat(_first(sizes), sizes))
            field.append(np.full(len(pos[-1]), i))
            words.append(column.flatten())
        encoded = pa.concat_arrays(words).dictionary_encode()
        code, row, place = encoded.indices.to_numpy(), np.concatenate(rows), np.concatenate(pos) * MOST_FIELDS + np.concatenate(field)
        order = _sorted(code, row) if len(fields) > 1 else _sorted(code)  # a single field's rows are in order
        code, row = code[order], row[order]
        entry = _starts(code, row)
        block = _starts(code[entry])
        count = np.diff(np.append(entry, len(code)))
        return cls(encoded.dictionary.take(pa.array(code[entry][block])), np.diff(np.append(block, len(entry))), row[entry], count, place[order], list(kept), np.bincount(row, minlength=len(kept[0])))

    def ordered(self, order: np.ndarray) -> Postings:
        """The same with the tokens in this order."""
        places = np.add.reduceat(self.count, _first(self.n)) if len(self.n) else self.n
        entry = _spans(_first(self.n)[order], self.n[order])
        return Postings(self.tokens.take(pa.array(order)), self.n[order], self.who[entry], self.count[entry], self.place[_spans(_first(places)[order], places[order])], self.kept, self.length)

    def pack(self, bucket: np.ndarray, number: int) -> pa.RecordBatch:
        """One row for each bucket of tokens, with the rows that have them; ``bucket``: that of each token."""
        order = _sorted(bucket)
        own, bucket, rows = self.ordered(order), bucket[order], len(self.length)
        token = _starts(bucket)
        entry = _first(own.n)[token]
        place = _first(own.count)[entry]
        at = np.repeat(np.arange(len(token)) * rows, np.diff(np.append(entry, len(own.who)))) + own.who
        has = np.zeros(len(token) * rows, bool)
        has[at] = True
        first_row = _first(has.reshape(len(token), rows).sum(axis=1)) if rows else token
        who = np.cumsum(has)[at] - 1 - first_row[at // rows] if rows else own.who
        which = np.flatnonzero(has) % rows if rows else at
        numbers = {"n": (own.n, token), "who": (who, entry), "count": (own.count, entry), "place": (own.place, place), "length": (own.length[which], first_row)}
        kinds = "".join(_kind(numbers[c][0]) for c in SHUFFLED)
        columns = {
            "bucket": pa.array(bucket[token], pa.int32()), "range": pa.array(np.full(len(token), number), pa.int64()), "kinds": pa.array([kinds] * len(token), pa.string()), "tokens": _lists(own.tokens, token),
            **{c: _bytes(*numbers[c], k) for c, k in zip(SHUFFLED, kinds, strict=True)}, **{f"k{i}": _lists(c.take(pa.array(which)), first_row) for i, c in enumerate(self.kept)},
        }
        return pa.record_batch(list(columns.values()), names=list(columns))

    @classmethod
    def unpack(cls, packed: Sequence[dict[str, pa.Scalar]]) -> tuple[Postings, np.ndarray]:
        """Packed rows of one bucket, in order of ranges, as one by token and range, and the range of each token."""
        kinds = list(zip(*(p["kinds"].as_py() for p in packed), strict=True))
        n, who, count, place, length = (_numbers([p[c].as_buffer() for p in packed], k) for c, k in zip(SHUFFLED, kinds, strict=True))
        names, rows = [p["tokens"].values for p in packed], np.array([len(p["k0"].values) for p in packed])
        sizes = np.array([len(t) for t in names])
        entries = np.add.reduceat(n, _first(sizes))
        kept = [pa.concat_arrays([p[c].values for p in packed]) for c in packed[0] if c.startswith("k") and c != "kinds"]
        all_ = cls(pa.concat_arrays(names), n, who + np.repeat(_first(rows), entries), count, place, kept, length)
        encoded = all_.tokens.dictionary_encode()
        rank = np.empty(len(encoded.dictionary), np.int64)
        rank[pc.array_sort_indices(encoded.dictionary).to_numpy()] = np.arange(len(rank))
        order = _sorted(rank[encoded.indices.to_numpy()])
        return all_.ordered(order), np.repeat([p["range"].as_py() for p in packed], sizes)[order]

    def gathered(self) -> tuple[Postings, np.ndarray]:
        """Of tokens by range: the same with successive ranges of a token as one until it is full, and where each begins."""
        token = np.cumsum(np.concatenate(([True], pc.not_equal(self.tokens[1:], self.tokens[:-1]).to_numpy(zero_copy_only=False)))[: len(self.n)]) - 1
        before = _first(self.n)
        begins = _starts(token, (before - before[_starts(token)][token]) // FULL)
        n = np.add.reduceat(self.n, begins) if len(begins) else self.n
        return Postings(self.tokens.take(pa.array(begins)), n, self.who, self.count, self.place, self.kept, self.length), begins

    def blocks(self, number: np.ndarray, fields: int) -> pa.RecordBatch:
        """One row for each block of tokens by range; ``number``: the range of each."""
        own, begins = self.gathered()
        at = np.repeat(np.arange(len(number)) - np.repeat(begins, np.diff(np.append(begins, len(number)))), self.n)
        return own._rows(_lists(pa.array(number, pa.int64()), begins), at, fields)

    def _rows(self, ranges: pa.ListArray, at: np.ndarray, fields: int) -> pa.RecordBatch:
        first_entry, first_place = _first(self.n), _first(self.count)
        of = np.repeat(np.arange(len(self.n)), self.n)
        first, length = first_place[first_entry], self.length[self.who]
        octave = np.floor(np.log2(self.count)).astype(np.int64)
        ladder = _sorted(of, octave)
        step = _starts(of[ladder], octave[ladder])
        rungs = pa.StructArray.from_arrays([pa.array(f.reduceat(x[ladder], step), pa.int32()) for f, x in ((np.maximum, self.count), (np.minimum, length))], names=["f", "length"])
        mask = np.bitwise_or.reduceat(1 << (self.place % MOST_FIELDS), first_place) if fields > 1 else self.n[:0]
        numbers = {"at": (at, first_entry), "lengths": (length, first_entry), "counts": (self.count, first_entry), "masks": (mask, first_entry if fields > 1 else first_entry * 0), "places": (self.place, first)}
        kinds = "".join(_kind(numbers[c][0]) for c in PACKED)
        columns = {
            "token": self.tokens, "ranges": ranges, "n": pa.array(self.n, pa.int64()), "total": pa.array(np.diff(np.append(first, len(self.place))), pa.int64()),
            "front": _lists(rungs, _starts(of[ladder][step])), **{f"k{i}": _lists(c.take(pa.array(self.who)), first_entry) for i, c in enumerate(self.kept)},
            "kinds": pa.array([kinds] * len(self.n), pa.string()), **{c: _bytes(*numbers[c], k) for c, k in zip(PACKED, kinds, strict=True)},
        }
        return pa.record_batch(list(columns.values()), names=list(columns))


def _runs(packed: list[dict[str, pa.Scalar]]) -> Iterator[list[dict[str, pa.Scalar]]]:
    """The packed ranges of a bucket in runs of about UNPACKED bytes, each with one range at least."""
    run, size = [], 0
    for row in sorted(packed, key=lambda x: x["range"].as_py()):
        if run and size > UNPACKED:
            yield run
            run, size = [], 0
        run.append(row)
        size += sum(len(row[c].as_buffer()) for c in SHUFFLED)
    if run:
        yield run


def _split(rows: DataFrame, kept: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """kept and t0, t1, ...: the tokens of each field; each text is split once, behind a generator."""
    split = F.struct(*(tokens(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)))
    return rows.select(*kept, F.explode(F.array(split)).alias("seshat_t")).select(*kept, "seshat_t.*")


def write(corpus: DataFrame, keys: Sequence[str], fields: Sequence[str], root: str, *, owner: Sequence[str] = (), removed: DataFrame | None = None, folds: Sequence[str] = (), range_rows: int | None = None) -> None:
    """Writes a part below ``root``: blocks, minus (token, n) and one row of statistics.

    keys name a row; owner columns say whose it is. ``removed`` has the fields of the rows of earlier parts that this part
    takes away; instead, ``folds`` are the folders of parts whose rows, as far as they still hold, the corpus has: what these
    parts have taken away together is then what is missing between their counts and this part's. Rows without tokens count for
    the statistics. Blocks are made where the rows are; those of a range and a bucket are shuffled as one packed row, and
    sorted by token where they arrive, at most TOGETHER ranges and about UNPACKED bytes at once.
    """
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"at most {MOST_FIELDS} fields")
    spark, kept = corpus.sparkSession, [*dict.fromkeys([*keys, *owner])]
    sizes = corpus.agg(F.count("*").alias("n"), F.coalesce(F.sum(_chars(fields)), F.lit(0)).alias("chars")).first()
    range_rows = range_rows or min(RANGE, max(4, sizes["n"] // RANGES))
    buckets = min(MOST_BUCKETS, max(1, sizes["chars"] // BUCKET_CHARS))
    salts = max(1, -(-sizes["n"] // (range_rows * TOGETHER)))
    n_kept, n_fields = len(kept), len(fields)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All blocks of a range and a bucket in one row."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), range_rows):
                part = batch.slice(at, range_rows)
                whole = Postings.of(part.columns[:n_kept], part.columns[n_kept : n_kept + n_fields])
                if len(whole.tokens):
                    yield whole.pack(_buckets(whole.tokens, buckets), number)
                number += 1

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many rows each token is, and, without a token, the number of rows and of their tokens."""
        for batch in batches:
            for at in range(0, len(batch), RANGE):
                part = batch.slice(at, RANGE)
                own = Postings.of(part.columns[:1], part.columns[1:])
                yield pa.record_batch([pa.concat_arrays([own.tokens, pa.array([None], pa.string())]), pa.array(np.append(own.n, len(part))), pa.array(np.append(own.n * 0, own.length.sum()))], names=["token", "n", "total"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks by bucket, token and range."""
        found: dict[int, list[dict]] = {}
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                named = dict(zip(batch.schema.names, row, strict=True))
                found.setdefault(named["bucket"].as_py(), []).append(named)
        for bucket in sorted(found):  # what isn't at hand stays packed
            for some in _runs(found.pop(bucket)):
                own, number = Postings.unpack(some)
                blocks = own.blocks(number, n_fields)
                for at in range(0, len(blocks), AT_ONCE):
                    piece = blocks.slice(at, AT_ONCE)
                    yield pa.record_batch([*piece.columns, pa.array([bucket] * len(piece), pa.int32())], names=[*piece.schema.names, "bucket"])

    split = _split(corpus, kept, fields)
    types = dict(split.dtypes)
    own = ", ".join(f"k{i} array<{types[c]}>" for i, c in enumerate(kept))
    schema = f"{HEADS}, {own}, {LISTS}, bucket int"
    dealt = split.mapInArrow(packed, f"bucket int, range bigint, kinds string, tokens array<string>, {', '.join(f'{c} binary' for c in SHUFFLED)}, {own}").repartition("bucket", F.pmod(F.xxhash64("range"), F.lit(salts)))
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(MOST_WRITERS))  # rows come by bucket: no sort of them is needed to write their folders
    try:
        dealt.mapInArrow(unpacked, schema).write.partitionBy("bucket").parquet(f"{root}/blocks")
    finally:
        spark.conf.set(_WRITERS, before)
    written = spark.read.schema(HEADS).parquet(f"{root}/blocks")
    counts = lambda sign, df: df.groupBy("token").agg((sign * F.sum("n")).alias("n"))
    if folds:
        kinds = {"blocks": HEADS, "minus": MINUS, "statistics": STATISTICS}
        read = lambda name: [spark.read.schema(kinds[name]).parquet(f"{f}/{name}") for f in folds]
        net = [counts(1, written), *(counts(-1, b) for b in read("blocks")), *(counts(1, m.where("token IS NOT NULL")) for m in read("minus"))]
        counts(1, reduce(DataFrame.union, net)).where("n <> 0").write.parquet(f"{root}/minus")
        before = [r.first() for r in read("statistics")]
        minus = F.lit(sizes["n"] - sum(r["n"] - r["minus_n"] for r in before)).cast("bigint"), F.col("total") - sum(r["total"] - r["minus_total"] for r in before)
        sums = spark.range(1)
    else:
        lost = _split((spark.createDataFrame([], corpus.schema) if removed is None else removed).withColumn("seshat_row", F.lit(1)), ["seshat_row"], fields)
        lost.mapInArrow(taken, MINUS_ROWS).groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.parquet(f"{root}/minus")
        sums = spark.read.schema(MINUS_ROWS).parquet(f"{root}/minus").where("token IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lost_n"), F.coalesce(F.sum("total"), F.lit(0)).alias("lost_total"))
        minus = F.col("lost_n"), F.col("lost_total")
    total = written.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    total.join(sums).select(F.lit(sizes["n"]).cast("bigint").alias("n"), "total", minus[0].alias("minus_n"), minus[1].alias("minus_total"), F.lit(int(buckets)).alias("buckets")).write.parquet(f"{root}/statistics")


def _any(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(p))


class BlockIndex:
    """Parts in the order in which they were written; keys, fields and owner as they were written with."""

    def __init__(self, spark: SparkSession, parts: Sequence[Part], keys: Sequence[str], fields: Sequence[str] = FIELDS, owner: Sequence[str] = ()):
        self.spark, self.parts, self.keys, self.fields, self.owner = spark, list(parts), list(keys), list(fields), list(owner)
        rows = [spark.read.schema(STATISTICS).parquet(f"{p.root}/statistics").first() for p in self.parts]
        self._stored = [spark.read.parquet(f"{p.root}/blocks") if _any(spark, f"{p.root}/blocks") else None for p in self.parts]
        self.n, self.total = (sum(r[c] - r[f"minus_{c}"] for r in rows) for c in ("n", "total"))
        self._buckets = [r["buckets"] for r in rows]

    def _stored_blocks(self, wanted: Sequence[str]) -> DataFrame:
        """Blocks of tokens in all parts, with part; scans are pruned to the tokens' partitions and their row groups."""
        found = []
        for k, (stored, buckets) in enumerate(zip(self._stored, self._buckets, strict=True)):
            if stored is not None:
                own = _buckets(pa.array(wanted, pa.string()), buckets).tolist()
                found.append(stored.where(F.col("bucket").isin(*set(own)) & F.col("token").isin(*wanted)).withColumn("part", F.lit(k)))
        if not found:
            raise ValueError("the index has no tokens")
        return reduce(DataFrame.unionByName, found)

    def _blocks(self, wanted: Sequence[str]) -> DataFrame:
        """The same by range: a block of several is a row for each, with the number ``pos`` of its range."""
        found = self._stored_blocks(wanted)
        return found.select(*(c for c in found.columns if c != "ranges"), F.posexplode("ranges").alias("pos", "range"))

    def _entries(self, blocks: DataFrame, *, places: bool = False) -> DataFrame:
        """(part, range, token, keys, owner, length, f, mask, places) of the blocks' rows that no later part has taken away; of
        stored blocks all rows, without range."""
        kept, n_fields = [*dict.fromkeys([*self.keys, *self.owner])], len(self.fields)
        types = dict(blocks.dtypes)
        one = ["pos", "range"] if "pos" in types else []
        columns = ["part", "token", *one, *(f"k{i}" for i in range(len(kept))), "kinds", "at", "lengths", "counts", *(["masks"] if n_fields > 1 else []), *(["places"] if places else [])]

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), READ_AT_ONCE):
                    some = dict(zip(columns, batch.slice(at, READ_AT_ONCE).columns, strict=True))
                    kinds = list(zip(*some["kinds"].to_pylist(), strict=True))
                    numbers = {c: _numbers([x.as_buffer() for x in some[c]], k) for c, k in zip(PACKED, kinds, strict=True) if c in some}
                    of = np.repeat(np.arange(len(some["part"])), some["k0"].value_lengths().to_numpy(zero_copy_only=False))
                    here = np.flatnonzero(numbers["at"] == some["pos"].to_numpy()[of]) if one else np.arange(len(of))
                    counts, small, taken, block = numbers["counts"], lambda x: pa.array(x, pa.int32()), pa.array(here), pa.array(of[here])
                    found = [*(some[c].take(block) for c in ("part", "token", *one[1:])), *(some[f"k{i}"].flatten().take(taken) for i in range(len(kept))), small(numbers["lengths"][here]), small(counts[here]), small(numbers["masks"][here] if n_fields > 1 else np.ones(len(here)))]
                    yield pa.record_batch(found + ([_lists(small(numbers["places"][_spans(_first(counts)[here], counts[here])]), _first(counts[here]))] if places else []), names=names)

        names = ["part", "token", *one[1:], *kept, "length", "f", "mask", *(["places"] if places else [])]
        schema = f"part int, token string, {'range bigint, ' if one else ''}{', '.join(f'`{c}` ' + types[f'k{i}'][len('array<') : -1] for i, c in enumerate(kept))}, length int, f int, mask int" + (", places array<int>" if places else "")
        entries = blocks.select(*columns).mapInArrow(opened, schema)
        gone = [p.gone.select(*(F.col(c).alias(f"seshat_{c}") for c in self.owner), F.lit(k).alias("seshat_by")) for k, p in enumerate(self.parts) if p.gone is not None]
        if not gone:
            return entries
        last = reduce(DataFrame.union, gone).groupBy(*(f"seshat_{c}" for c in self.owner)).agg(F.max("seshat_by").alias("seshat_by"))
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"seshat_{c}")) for c in self.owner))
        return entries.join(last, same & (F.col("part") < F.col("seshat_by")), "left_anti")

    def frequencies(self, wanted: Sequence[str]) -> dict[str, int]:
        """In how many rows each token is."""
        blocks = self._stored_blocks(wanted).groupBy("token").agg(F.sum("n").alias("n"))
        minus = [self.spark.read.schema(MINUS).parquet(f"{p.root}/minus").where(F.col("token").isin(*wanted)) for p in self.parts]
        lost = reduce(DataFrame.union, minus).groupBy("token").agg(F.sum(-F.col("n")).alias("n"))
        return {r["token"]: r["n"] for r in blocks.union(lost).groupBy("token").agg(F.sum("n").alias("n")).collect()}  # one row a token

    def _idf(self, found: float) -> float:
        idf = math.log((self.n - found + 0.5) / (found + 0.5))
        return idf if idf > 0 else IDF_FLOOR

    def _part(self, idf: float, f: Column, length: Column) -> Column:
        f, norm = f.cast("double"), F.lit(1 - B) + F.lit(B) * length / F.lit(self.total / max(self.n, 1) or 1.0)
        return F.lit(idf) * f * (K1 + 1) / (f + K1 * norm)

    def _bounds(self, weights: dict[str, float]) -> DataFrame:
        """(part, range, token, bound): what no row of the range gets for the token."""
        heads = self._blocks(list(weights)).select("part", "range", "token", "front")
        most = lambda idf: F.array_max(F.transform("front", lambda r: self._part(idf, r["f"], r["length"])))
        share = reduce(lambda c, t: c.when(F.col("token") == t, most(weights[t])), weights, F.when(F.lit(False), 0.0))
        return heads.select("part", "range", "token", share.alias("bound"))

    def _scored(self, wanted: Sequence[str], blocks: DataFrame, score_of: dict[str, float], allowed: DataFrame | None, digits: int, *, where: bool = False) -> DataFrame:
        """keys, score, fields, and with ``where`` the part and range of each row."""
        rows, place = self._entries(blocks), ["part", "range"] if where else []
        rows = rows if allowed is None else rows.join(allowed.select(*self.keys), self.keys, "left_semi")
        f = [F.coalesce(F.max(F.when(F.col("token") == t, F.col("f"))), F.lit(0)).alias(f"f{k}") for k, t in enumerate(wanted)]
        grouped = rows.groupBy(*self.keys, *place).agg(F.max("length").alias("length"), F.bit_or("mask").alias("mask"), *f)
        total = reduce(add, (self._part(score_of[t], F.col(f"f{k}"), F.col("length")) for k, t in enumerate(wanted)))
        return grouped.select(*self.keys, *place, F.round(-total, digits).alias("score"), self._names(F.col("mask")).alias("fields"))

    def _names(self, mask: Column) -> Column:
        return F.array_compact(F.array(*(F.when(mask.bitwiseAND(1 << i) != 0, f) for i, f in sorted(enumerate(self.fields), key=lambda x: x[1]))))

    def _chosen(self, query: str, k: int, allowed: DataFrame | None, digits: int) -> tuple[dict[str, float], DataFrame, Column]:
        """Weights of the query's tokens, the blocks that can hold one of the k best rows, and which are scored first of all."""
        times = Counter(t for p in query_phrases(query) for t in p)
        found = self.frequencies(list(times))
        weights = {t: self._idf(found.get(t, 0)) * m for t, m in times.items()}
        blocks, shares, place = self._blocks(list(times)), self._bounds(weights), ["part", "range"]
        bounds = shares.groupBy(*place).agg(F.sum("bound").alias("bound"))
        early = F.lit(False)
        for number in FIRST_RANGES:
            first = bounds.orderBy(F.desc("bound"), "part", "range").limit(number).collect()
            early = reduce(lambda a, b: a | b, ((F.col("part") == r["part"]) & (F.col("range") == r["range"]) for r in first), F.lit(False))
            best = self._scored(list(times), blocks.where(early), weights, allowed, digits).orderBy("score").limit(k).agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
            # scores are negative and rounded: a range at the k-th score itself may hold rows that tie
            least = -best["worst"] - 10.0**-digits if best["n"] == k else None
            reach = bounds if least is None else bounds.where(F.col("bound") >= least)
            if len(first) < number or reach.limit(number + 1).count() <= number:
                break
        chosen = blocks.join(reach.select(*place), place, "left_semi")
        cheap = [] if least is None else self._cheap(shares, least)
        if not cheap:
            return weights, chosen, early
        dear = ~F.col("token").isin(*cheap)
        rows = self._scored(list(times), chosen.where(dear), weights, allowed, digits, where=True).select(*place, "score")
        rest = shares.where(~dear).groupBy(*place).agg(F.sum("bound").alias("rest"))
        alive = rows.join(rest, place).where(F.col("rest") - F.col("score") >= least - 10.0**-digits).select(*place)
        return weights, chosen.where(dear).unionByName(chosen.where(~dear).join(alive, place, "left_semi")), early

    @staticmethod
    def _cheap(shares: DataFrame, least: float) -> list[str]:
        """Of the tokens with the least bounds, as many as together stay below ``least``, so that no row of theirs alone reaches it."""
        found, total = [], 0.0
        for r in shares.groupBy("token").agg(F.max("bound").alias("bound")).orderBy("bound", "token").collect():  # one row a token
            total += r["bound"]
            if total >= least:
                break
            found.append(r["token"])
        return found

    def search(self, query: str, k: int, *, allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
        """keys, score (lower is better), fields that matched, rk: as keyword.search of the rows that are there.

        ``allowed`` (keys) holds before the limit, and not for the statistics. A phrase of several tokens counts only where
        its positions follow each other, so that all blocks of its tokens are read.
        """
        phrases = query_phrases(query)
        if any(len(p) > 1 for p in phrases):
            scored = self._phrases(phrases, allowed, digits)
        else:
            weights, blocks, _ = self._chosen(query, k, allowed, digits)
            scored = self._scored(list(weights), blocks, weights, allowed, digits)
        return ranked(scored.orderBy("score", *self.keys).limit(k), [F.col("score"), *map(F.col, self.keys)])

    def _phrases(self, phrases: list[list[str]], allowed: DataFrame | None, digits: int) -> DataFrame:
        counted = self.phrase_counts(phrases)
        found = counted.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases)))).first()
        counted = counted if allowed is None else counted.join(allowed.select(*self.keys), self.keys, "left_semi")
        total = reduce(add, (self._part(self._idf(found[f"n{i}"]), F.col(f"f{i}"), F.col("length")) for i in range(len(phrases))))
        return counted.select(*self.keys, F.round(-total, digits).alias("score"), "fields")

    def phrase_counts(self, phrases: list[list[str]]) -> DataFrame:
        """keys, length, f0, f1, ... and fields for each row that has a phrase."""
        wanted = sorted({t for p in phrases for t in p})
        rows = self._entries(self._stored_blocks(wanted), places=True)
        at = rows.groupBy(*self.keys, "length").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("at"))
        none = F.array().cast("array<int>")

        def places(phrase: list[str]) -> Column:
            each = [F.coalesce(F.element_at("at", F.lit(t)), none) for t in phrase]
            here = lambda p: reduce(and_, [F.array_contains(x, p + k * MOST_FIELDS) for k, x in enumerate(each[1:], 1)], F.lit(True))
            return F.filter(each[0], here)

        with_places = at.select(*self.keys, "length", *(places(p).alias(f"p{k}") for k, p in enumerate(phrases)))
        fields = F.array_distinct(F.flatten(F.array(*(F.transform(f"p{k}", lambda p: p % MOST_FIELDS) for k in range(len(phrases))))))
        some = " OR ".join(f"size(p{k}) > 0" for k in range(len(phrases)))
        names = F.array_sort(F.transform(fields, lambda i: F.element_at(F.array(*map(F.lit, self.fields)), i + 1)))
        return with_places.where(some).select(*self.keys, "length", *(F.size(f"p{k}").alias(f"f{k}") for k in range(len(phrases))), names.alias("fields"))

    def reading(self, query: str, k: int) -> DataFrame:
        """(token, blocks, read): how many blocks each token has, and of how many a search reads the postings."""
        weights, chosen, early = self._chosen(query, k, None, 6)
        all_ = self._blocks(list(weights)).select("part", "range", "token")
        read = chosen.select("part", "range", "token").union(all_.where(early)).distinct()
        count = lambda df, name: df.groupBy("token").agg(F.count("*").alias(name))
        return count(all_, "blocks").join(count(read, "read"), "token", "left").fillna(0, ["read"])
