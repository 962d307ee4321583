"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of 3/4 or more, as components.

1. Each text becomes a set of 64-bit shingle hashes. Sets with equal 128-bit numbers are one node from here on.
2. Nodes meet under BANDS keys of ROWS minimum hashes each. A pair of similarity 3/4 has no key in common
   with a chance of (1 - 0.75 ** ROWS) ** BANDS, 3e-10, and more similar pairs with less. Keys are
   range-partitioned together with nodes, so that a key of very many nodes is cut in chunks of CHUNK.
3. In each chunk, and later in each pair of chunks of one key, an R-tree over count vectors names the pairs
   that can link. Pairs within a component that is already known are not searched.
4. In rounds, each node's candidates (the one that shares most keys with it, then the first 8, then 64 ...) are verified on whole sets, and
   verified links merge components. A large group of near copies thus takes about one verified pair for
   each node, not all pairs; the rounds end only when no untested candidate joins two components.

Only nodes that share a key have their sets written; a set travels with its pair, never with its group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.staging import Staging
from .batch import constants, lower_ascii, mix, pieces, span_hash, spaced_words, utf8
from .count_tree import LINK, CountTree, count_vectors

SHINGLE = 5
BANDS, ROWS = 40, 3
CHUNK = 2048

#: Stands for a null id: above any other.
_NULL_ID = (1 << 63) - 1
_DONE = 1 << 62

_FACTORS = constants(SHINGLE, 31)
_SHIFTS, _SCALES = constants(BANDS * ROWS, 32), constants(BANDS * ROWS, 33)
_BANDS = constants(BANDS, 34)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Fewer than SHINGLE words, but not none, are one shingle.
    """
    data = lower_ascii(data)
    starts, ends, texts = spaced_words(data, offsets)
    words = span_hash(41)(data, starts, ends)
    n = max(0, len(words) - SHINGLE + 1)
    windows = mix(sum((words[k : k + n] * f for k, f in enumerate(_FACTORS)), np.zeros(n, np.uint64)))
    sets, sizes = [], []
    for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.unique(windows[a : b - SHINGLE + 1])
        elif b > a:
            own = mix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            own = words[:0]
        sets.append(own)
        sizes.append(len(own))
    return (np.concatenate(sets) if sets else words[:0]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def set_numbers(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set that is not empty, whatever the order: equal sets have equal ones."""

    def number(k: int) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ _FACTORS[k]), dtype=np.uint64)])
        return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)

    return number(0), number(1)


def band_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS keys for each set; none of the sets is empty."""
    n = len(offsets) - 1
    keys = np.zeros((n, BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(values * _SCALES[k] + _SHIFTS[k], offsets[:-1])
        keys[:, k // ROWS] += mix(least + np.uint64(k % ROWS + 1)) * _FACTORS[k % ROWS]
    return mix(keys + _BANDS).view(np.int64)


def _lists(flat: np.ndarray, width: int, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(flat.ravel()))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "high", "low", "bands"]
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for lo, hi in pieces(offsets):
            values, sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sizes = np.diff(sets)
            full = np.flatnonzero(sizes)
            own = np.concatenate([sets[:-1][full], sets[-1:]])
            keys = band_keys(values, own) if len(full) else np.zeros((0, BANDS), np.int64)
            rows = np.full(hi - lo, -1)
            rows[full] = np.arange(len(full))
            take = pa.array(rows, mask=rows < 0)
            columns = [*(pa.array(x, pa.int64()) for x in set_numbers(values, own)), _lists(keys, BANDS, len(full))]
            yield pa.record_batch([batch.column(1).slice(lo, hi - lo), pa.array(sizes), *(c.take(take) for c in columns)], names=names)


def _chunks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, node): lists of two nodes or more with a key, of ``size`` or a few more. ``chunk`` is -1 for a
    key that is whole here, else a number of the list's own: for parts of a long list, and for keys at the
    partition's ends, of one node or more."""
    task, numbers = TaskContext.get().partitionId(), count()

    def rows(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["key", "chunk", "nodes"])

    number = lambda: task << 32 | next(numbers)
    held_key, held, edge = None, np.zeros(0, np.int64), True
    for batch in batches:
        keys, nodes = (batch.column(k).to_numpy() for k in range(2))
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.append(cuts, len(keys))
        found = []
        if keys[0] != held_key and held_key is not None:
            if edge or len(held) > 1:
                found.append((held_key, number() if edge else -1, held))
            held_key, held, edge = int(keys[0]), nodes[:0], False
        elif held_key is None:
            held_key = int(keys[0])
        held = np.concatenate([held, nodes[: ends[0]]])
        for a, b in zip(starts[1:][ends[1:] - starts[1:] > 1].tolist(), ends[1:][ends[1:] - starts[1:] > 1].tolist(), strict=True):
            if b < len(keys):
                for i in range(a, b, size):
                    found.append((int(keys[a]), -1 if b - a <= size else number(), nodes[i : min(i + size, b)]))
        if len(starts) > 1:  # the first run has ended; the last may go on
            first_key, first = held_key, held
            if edge or len(first) > 1:
                found += [(first_key, number() if edge or len(first) > size else -1, first[i : i + size]) for i in range(0, len(first), size)]
            held_key, held, edge = int(keys[-1]), nodes[starts[-1] :], False
        while len(held) >= 2 * size:
            found.append((held_key, number(), held[:size]))
            held, edge = held[size:], True
        yield rows(found)
    if held_key is not None:
        yield rows([(held_key, number(), held)])


_SEARCHED = ("u", "label_u", "rank", "n", "v", "label", "more", "key", "i", "j", "side")


def _candidates(limit: int):
    """Of rows sorted by block: each node's first ``limit`` candidates in its block, and whether there are more; of a limit
    of 1, not the first one but the one with most common keys (rank is their number below zero). Then, with the block's
    key, the nodes that have untested candidates in it, and those candidates: the rest of the block is never looked at again.

    Nodes that share several keys meet in several blocks; the pair is taken in that of their least common key.
    """

    def of(block: dict[str, np.ndarray], vectors: np.ndarray, bands: np.ndarray) -> list[tuple]:
        order = np.lexsort((block["node"], block["n"]))
        node, n, over, label, side, bar_n, bar = (block[c][order] for c in ("node", "n", "over", "label", "side", "upto_n", "upto"))
        if (label == label[0]).all():
            return []
        tree, bands, across, out = CountTree(vectors[order], over, n, label), bands[order], block["i"][0] != block["j"][0], []
        needed = np.zeros(len(node), bool)
        for at in np.flatnonzero(bar_n < _DONE).tolist():
            near = tree.before(at)
            if len(near) and across:
                near = near[side[near] != side[at]]
            if len(near):
                same = bands[near] == bands[at]
                own = np.where(same, bands[at], _NULL_ID).min(1) == block["key"][0]
                near, shared = near[own], same[own].sum(1)
            if limit == 1 and len(near):
                v = int(near[shared.argmax()])
                out.append((int(node[at]), int(label[at]), -int(shared.max()), int(n[v]), int(node[v]), int(label[v]), len(near) > 1, None, None, None, None))
                needed[at] = needed[near] = True
                continue
            if len(near):
                near = near[(n[near] > bar_n[at]) | (n[near] == bar_n[at]) & (node[near] > bar[at])]
            if len(near):
                needed[at] = needed[near] = True
            out += [(int(node[at]), int(label[at]), 0, int(n[v]), int(node[v]), int(label[v]), len(near) > limit, None, None, None, None) for v in near[:limit].tolist()]
        place = tuple(int(block[c][0]) for c in ("key", "i", "j"))
        return out + [(int(node[k]), None, None, None, None, None, None, *place, int(side[k])) for k in np.flatnonzero(needed).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def blocks(table: pa.Table, last: bool) -> tuple[list[tuple], pa.Table | None]:
            columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("vector", "bands")}
            vector = utf8(table.column("vector"))[0].reshape(table.num_rows, -1)
            bands = pc.list_flatten(table.column("bands")).to_numpy().reshape(table.num_rows, -1)
            change = np.zeros(table.num_rows, bool)
            for c in ("key", "i", "j"):
                change[1:] |= np.diff(columns[c]) != 0
            starts = np.concatenate([[0], np.flatnonzero(change)])
            ends = np.append(starts[1:], table.num_rows)
            out, stop = [], len(starts) if last else len(starts) - 1
            for a, b in zip(starts[:stop].tolist(), ends[:stop].tolist(), strict=True):
                if b - a > 1:
                    out += of({c: x[a:b] for c, x in columns.items()}, vector[a:b], bands[a:b])
            return out, None if last else table.slice(starts[-1])

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * len(_SEARCHED)
            return pa.record_batch([pa.array(x, pa.bool_() if c == "more" else pa.int64()) for c, x in zip(_SEARCHED, columns, strict=True)], names=list(_SEARCHED))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            out, held = blocks(pa.concat_tables([held, table]).combine_chunks() if held is not None else table, False)
            yield rows(out)
        if held is not None:
            yield rows(blocks(held, True)[0])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for lo, hi in pieces(offsets):
            values, sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            full = np.flatnonzero(np.diff(sets))
            own = np.concatenate([sets[:-1][full], sets[-1:]])
            parts = [values[a:b].tobytes() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            vectors, over = count_vectors(values, own)
            columns = [*map(pa.array, set_numbers(values, own)), pa.array(np.diff(own)), pa.array(parts, pa.binary()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(over, pa.int64())]
            yield pa.record_batch(columns, names=["high", "low", "n", "set", "vector", "over"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    share, whole = LINK
    for batch in batches:
        linked = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            linked.append(whole * both >= share * (len(a) + len(b)))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


class _Join:
    """The tables of one run. State: each node's label (component so far) and how far its candidates are tested."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, chunk: int):
        self.spark, self.chunk = docs.sparkSession, chunk
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.staged = Staging(self.spark, "jaccard")
        self.source = docs.select(docs[text_column].alias("text"), F.coalesce(docs[id_column].cast("bigint"), F.lit(_NULL_ID)).alias("id"))
        self.jobs, self.written = count(), []
        self.signatures = self.write(self.source.mapInArrow(_signatures, "id bigint, n bigint, high bigint, low bigint, bands array<bigint>"), "signatures")
        grouped = self.signatures.where("high IS NOT NULL").groupBy("high", "low").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
        self.nodes = self.write(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(f"{next(self.jobs)}-{name}")
        return self.staged.write(df, self.written[-1])

    def clear(self, *kept: str) -> None:
        """Deletes what has been written, but for tables of these names."""
        self.staged.drop(*(w for w in self.written if w.partition("-")[2] not in kept))

    def blocks(self) -> tuple[DataFrame, DataFrame]:
        """(key, i, j, node, side): lists of nodes that meet whole, and parts of lists, which also meet in pairs."""
        keys = self.nodes.select(F.explode("bands").alias("key"), "node")
        dealt = keys.repartitionByRange(self.parts, "key", "node").sortWithinPartitions("key", "node")
        chunks = self.write(dealt.mapInArrow(partial(_chunks, self.chunk), "key bigint, chunk bigint, nodes array<bigint>"), "chunks")
        whole = chunks.where("chunk < 0").groupBy("nodes").agg(F.min("key").alias("key"))
        same = whole.select("key", F.lit(-1).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("j"), F.explode("nodes").alias("node"))
        parts = self.write(chunks.where("chunk >= 0"), "parts")
        own = parts.select("key", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.explode("nodes").alias("node"))
        return self.write(same.union(own).withColumn("side", F.lit(0).cast("bigint")), "blocks"), parts

    def features(self, blocks: DataFrame) -> DataFrame:
        """(node, rep, n, set, vector, over, bands) of the nodes in blocks, from the texts of their representatives."""
        wanted = self.write(blocks.select("node").distinct().join(self.nodes.select("node", "high", "low", F.col("rep").alias("id"), "bands"), "node"), "wanted")
        texts = self.source.join(wanted.select("id").distinct(), "id", "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "high bigint, low bigint, n bigint, set binary, vector binary, over bigint")
        one = sets.groupBy("high", "low").agg(*(F.first(c).alias(c) for c in ("n", "set", "vector", "over")))  # copies by one id
        return self.write(one.join(wanted.withColumnRenamed("id", "rep"), ["high", "low"]).drop("high", "low"), "features")

    def cross(self, parts: DataFrame, state: DataFrame) -> DataFrame:
        """Pairs of parts of one key whose nodes are of two components or more. Parts that add no other component drop out."""
        rows = parts.select("key", "chunk", F.explode("nodes").alias("node")).join(state.select("node", "label"), "node")
        of_part = rows.groupBy("key", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        p, q = (of_part.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("chunk", "low", "high"))) for k in "ij")
        pairs = p.join(q, "key").where("chunk_i < chunk_j AND NOT (low_i = high_i AND low_j = high_j AND low_i = low_j)")
        pairs = self.write(pairs.select("key", F.col("chunk_i").alias("i"), F.col("chunk_j").alias("j")), "pairs")
        side = lambda c, k: pairs.join(rows.select("key", F.col("chunk").alias(c), "node"), ["key", c]).select("key", "i", "j", "node", F.lit(k).cast("bigint").alias("side"))
        return self.write(side("i", 0).union(side("j", 1)), "cross")

    def live(self, blocks: DataFrame, state: DataFrame) -> DataFrame:
        """The blocks that have two labels or more and a node that is not done.

        Where all nodes that are not done have one label, the others of that label drop out: they are no candidates of
        those, now or later, as labels only merge and what is done stays so.
        """
        rows = self.write(blocks.join(state, "node"), "rows")
        open_ = F.when(F.col("upto_n") < _DONE, F.col("label"))
        sums = rows.groupBy("key", "i", "j").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(open_).alias("first"), F.max(open_).alias("last"))
        alive = sums.where("low <> high AND first IS NOT NULL").select("key", "i", "j", "first", "last")
        kept = rows.join(alive, ["key", "i", "j"]).where(f"upto_n < {_DONE} OR label <> first OR first <> last")
        return self.write(kept.select("key", "i", "j", "node", "side"), "live")

    def search(self, blocks: DataFrame, state: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """(u, label_u, first, more): first candidates of nodes that are not done; and what is left of the blocks."""
        rows = blocks.join(state.join(self.known.select("node", "n", "vector", "over", "bands"), "node"), "node")
        dealt = rows.repartition(self.parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        searched = self.write(dealt.mapInArrow(_candidates(limit), ", ".join(f"{c} {'boolean' if c == 'more' else 'bigint'}" for c in _SEARCHED)), "searched")
        every = searched.where("v IS NOT NULL").groupBy("u", "label_u").agg(F.array_sort(F.collect_set(F.struct("rank", "n", "v", "label"))).alias("all"), F.max("more").alias("more"))
        cut = every.select("u", "label_u", F.slice("all", 1, limit).alias("first"), (F.col("more") | (F.size("all") > limit)).alias("more"))
        return self.write(cut, "found"), searched.where("key IS NOT NULL").select("key", "i", "j", F.col("u").alias("node"), "side")

    def verify(self, found: DataFrame) -> DataFrame:
        """The labels (a, b) of pairs that link."""
        pairs = found.select("u", "label_u", F.explode("first").alias("f")).select("u", "label_u", F.col("f.v").alias("v"), F.col("f.label").alias("label_v"))
        first, second = (self.known.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "uv")
        joined = pairs.join(first, "u").join(second, "v").select("label_u", "label_v", "set_u", "set_v")
        return self.write(joined.mapInArrow(_verified, "a bigint, b bigint"), "links")

    def rounds(self, blocks: DataFrame, state: DataFrame) -> DataFrame:
        """The state when no untested candidate of the blocks joins two components."""
        limit = 1
        while True:
            if limit > 1:  # by now most blocks have one label
                blocks = self.live(blocks, state)
            found, blocks = self.search(blocks, state, limit)
            if found.isEmpty():
                return state
            merged = components(self.verify(found), self.staged, f"{next(self.jobs)}-stars")
            last = F.element_at("first", -1)
            reached = (last["n"], last["v"]) if limit > 1 else (F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))  # others come before the nearest
            tested = found.where("more").select(F.col("u").alias("node"), reached[0].alias("next_n"), reached[1].alias("next"))
            moved = state.join(merged.withColumnsRenamed({"a": "label", "b": "into"}), "label", "left").join(tested, "node", "left")
            state = self.write(
                moved.select("node", F.coalesce("into", "label").alias("label"), F.coalesce("next_n", F.lit(_DONE)).alias("upto_n"), F.coalesce("next", F.lit(0)).alias("upto")), "state"
            )
            limit *= 8

    def run(self) -> DataFrame:
        """(node, component) for the nodes whose component has a smaller id than their own copies."""
        blocks, parts = self.blocks()
        self.known = self.features(blocks)
        fresh = lambda rows, label: rows.select("node", label.alias("label"), F.lit(-1).cast("bigint").alias("upto_n"), F.lit(0).cast("bigint").alias("upto"))
        state = self.rounds(blocks, self.write(fresh(blocks.select("node").distinct(), F.col("node")), "state"))
        cross = self.cross(parts, state)
        if not cross.isEmpty():
            state = self.rounds(cross, self.write(fresh(state, F.col("label")), "state"))
        named = state.select("node", "label").join(self.known.select("node", "rep"), "node")
        least = named.groupBy("label").agg(F.min("rep").alias("component"))
        found = self.write(named.join(least, "label").where("component <> rep").select("node", "component"), "components")
        self.clear("signatures", "nodes", "components")
        return found


def _id(c: Column) -> Column:
    return F.when(c != _NULL_ID, c)


def link(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: the id, n_shingles (size of its set) and component_id.

    component_id is the smallest id that links reach, the document's own included. A null, empty or blank
    text has an empty set and links with nothing, also not with its like. Null ids come after all others:
    a component of null ids only has a null one. Repeated rows give a row each. An empty table gives no
    rows; other columns of ``docs`` are not read, whatever their names. ``docs`` is read more than once.
    Ids are whole numbers of 64 bits, or strings of their digits; other strings end the run with CAST_INVALID_INPUT.
    chunk: nodes that are searched together; a bound on a task's memory, and no cap.
    Shingles are 64-bit hashes and sets have 128-bit numbers: of n distinct sets, n * n / 2 ** 129 pairs are expected to
    have the same number.
    """
    join = _Join(docs, id_column, text_column, chunk)
    other = join.run()
    own = join.signatures.select("id", "n", "high", "low").join(join.nodes.select("high", "low", "node", "rep").join(other, "node", "left"), ["high", "low"], "left")
    return own.select(_id(F.col("id")).alias(id_column), F.col("n").alias("n_shingles"), _id(F.coalesce("component", "rep", "id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose id is their component's: one document of each stays.

    Rows without an id stay, as no join can name them; rows that repeat an id stay or go together. Ids are as in ``link``.
    """
    others = link(docs, id_column=id_column, text_column=text_column).where(f"{id_column} <> component_id").select(id_column).distinct()
    return docs.join(Staging(docs.sparkSession, "copies").write(others, "copies"), id_column, "left_anti").select(*docs.columns)
