"""The Merkle manifest, the runs of words and the pivot search against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seshat.llm import merkle_manifest, period_runs, pivot_search, queries

from . import plain
from .conftest import got, want

DOC = "doc_id bigint, source string, lang string, n_chars bigint, text string"
CLASH = ("tree", "key", "leaf", "now", "idx", "width", "run", "members", "hash", "part", "place", "cell", "id", "runs", "block", "rank", "score")


def _leaves() -> list[tuple]:
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(300)]
    rows += [(1000 + i, "seventeen", None, None, None) for i in range(17)]
    rows += [(2000, "alone", "de", 0, ""), (2001, "ä", "de", 5, "Ä B"), (2002, "", "x", 1, "Y"), (3000, None, None, None, "No Source"), (None, "hot", None, 3, "No Id")]
    rows += [(7, "hot", "en", 7, "Text 7"), (7, "hot", "en", 7, "other Text"), (7, "hot", "en", 7, "Text 7")]
    return rows + [(4000 + i, f"s{i}", "en", 2, "AB") for i in range(20)]


@pytest.mark.parametrize("rows", [_leaves(), _leaves()[:300], _leaves()[:1], _leaves()[2:19], []])
def test_merkle_manifest(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOC).select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert got(queries.op11_merkle_manifest(spark, str(tmp_path))) == want(plain.merkle(rows))


def test_merkle_siblings_are_returned(spark):
    docs = spark.createDataFrame(_leaves()[:20], DOC)
    manifest = merkle_manifest.build(docs, now={"text": F.when(docs["doc_id"] == 3, "changed").otherwise(docs["text"])})
    proved = {r["key"]: r for r in merkle_manifest.proofs(manifest).collect()}
    assert not proved[3]["verified"] and all(r["verified"] for k, r in proved.items() if k != 3)
    assert {len(r["siblings"]) for r in proved.values()} == {32 * (15 + 1), 32 * (3 + 1)}  # 16 and 4 leaves below one root


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=25), st.integers(1, 6)), max_size=12), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 2)), max_size=3))
def test_runs_against_every_period(parts, changes):
    words = [w for part, times in parts for w in part * times][:400]
    for at, w in changes:
        if at < len(words):
            words[at] = w
    assert list(map(tuple, period_runs.runs(np.array(words, np.int64)).tolist())) == plain.period_runs(words)


def test_runs_in_few_steps():
    for words in (np.zeros(300_000, np.int64), np.tile(np.r_[np.zeros(999, np.int64), 1], 300), np.random.default_rng(1).integers(0, 2, 300_000)):
        began = time.time()
        assert len(period_runs.runs(words)) > 0
        assert time.time() - began < 10
    assert len(period_runs.runs(np.tile(np.r_[np.zeros(99, np.int64), 1], 30))) == 31  # the whole, and a run in each period


def test_wavelet_tree():
    rnd = random.Random(3)
    for n in (1, 2, 7, 64, 100):
        values = list(range(n))
        rnd.shuffle(values)
        tree = period_runs.WaveletTree(np.array(values))
        for _ in range(50):
            lo, hi, x = sorted((rnd.randint(0, n), rnd.randint(0, n))) + [rnd.randint(0, 2 * n)]
            at = [np.array([v]) for v in (lo, hi, x)]
            inside = sorted(values[lo:hi])
            less = int(tree.less(*at)[0])
            assert less == sum(v < x for v in inside)
            if less < len(inside):
                assert int(tree.kth(at[0], at[1], np.array([less]))[0]) == inside[less]


def test_op12(spark, tmp_path, docs, none, rows):
    more = [(k, " ".join(random.Random(k).choice(("a", "b", "c d", "é")) for _ in range(k % 90))) for k in range(100, 400)]
    more += [(500, "a b c " * 40 + "x y " * 30), (501, "w\x0b" * 24), (502, "w " * 23), (503, "a b c d e f g h i j k l " * 3)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    every.select("*", *(F.lit("x").alias(c) for c in CLASH)).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = [plain.op12(d, t) for d, t in [*rows, *more] if not t or len(t) < 20_000]
    assert sum(r[1] > 0 for r in wanted) > 20
    found = queries.op12_period_runs(spark, str(tmp_path))
    assert found.count() == len(rows) + len(more)
    long = [d for d, t in rows if t and len(t) >= 20_000]
    assert got(found.where(~F.coalesce("doc_id", F.lit(-1)).isin(*long))) == want(wanted)
    assert period_runs.find(none).isEmpty()


def _vectors() -> list[tuple]:
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)]  # copies
    return rows + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [0.1] * 8), (1080, []), (1100, [0.25, 0.5]), (20, [0.3] * 8), (21, [0.3] * 8), (21, [0.3] * 8), (-40, [-0.7] * 8), (1120, [1e6, -1e6] * 4), (1121, [1e5] * 8)]


@pytest.mark.parametrize("block, pack, pivots", [(1024, 256, 32), (16, 4, 3), (7, 300, 1)])
def test_pivot_search(spark, block, pack, pivots):
    rows = _vectors()
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(3)
    for k in (1, 20, 1000):
        assert got(pivot_search.search(table, every=20, k=k, scale=64, block=block, pack=pack, pivots=pivots)) == want(plain.nearest(rows, 20, k, 64))
    assert pivot_search.search(table.where("false"), every=20, k=3, scale=64).isEmpty()


def test_blocks_are_ruled_out():
    """Clusters far apart: bounds leave most candidates out, and nothing is lost."""
    rng = np.random.default_rng(2)
    z = np.concatenate([rng.integers(-3, 4, (500, 6)) + c for c in ([200] * 6, [-200] * 6, [200, -200] * 3)]).astype(np.int64)
    chosen = pivot_search._pivots(z, 4)
    rows = lambda part, first: pivot_search.Rows(np.arange(first, first + len(part)), np.arange(first, first + len(part)), part, pivot_search._distances(part, chosen))
    q, v = rows(z[:20], 5000), rows(z, 0)
    exact = z[:20] @ z.T
    floor = -np.sort(-exact, 1)[:, 9].astype(float)
    limits = pivot_search.bounds(q, v)
    assert (limits >= exact).all() and (limits >= floor[:, None]).mean() < 0.5
    row, cand, score = pivot_search.best(q, v, 10, np.full(20, -np.inf))
    for i in range(20):
        order = sorted(range(len(z)), key=lambda j: (-exact[i, j], j))[:10]
        assert cand[row == i].tolist() == order and score[row == i].tolist() == [exact[i, j] for j in order]
