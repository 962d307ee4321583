from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
LINE = "This Line is long enough to be a key of forty characters"


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, copies, near copies, common lines, a very long text."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t\n"), (None, f"{LINE}\nno id"), (None, None)]
    base = text(120).split(" ")
    for k in range(12):  # near copies, about the threshold
        copy = list(base)
        for _ in range(k):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((10 + k, " ".join(copy)))
    rows += [(40, "few words"), (41, "Few WORDS"), (42, "few"), (43, " ".join(base)), (43, " ".join(base)), (44, " ".join(base).upper())]
    for k in range(7):
        rows.append((60 + k, f"{text(20)}\n  {LINE if k % 2 else LINE.upper()}\t\n{text(5)}\n{LINE}x{k // 6}"))
    rows += [(80, f"{text(30)} {PASSAGE.upper()}, {text(30)}"), (81, f"{PASSAGE} {PASSAGE}"), (82, f"tiny item {text(400)}"), (83, f"{text(2000)} {PASSAGE}"), (84, "TINY-ITEM"), (85, PASSAGE.replace(" ", "\n"))]
    rows += [(90, text(20_000)), (91, "x" * 5000), (92, "\n".join(["same line again"] * 30)), (93, "a b c d e f g h i j " * 5), (94, "日本語 テキスト  a b İ ſ K"), (95, "one, two! 'ere 's  \n\n don't we'll  ")]
    return rows


ITEMS = [(1, PASSAGE), (2, "Tiny item"), (30, "thirteen fourteen fifteen one two three four five six seven eight nine ten eleven"), (4, None), (5, "..."), (None, "few words")]


@pytest.fixture(scope="session")
def rows() -> list[tuple[int | None, str | None]]:
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows) -> DataFrame:
    """The rows with other columns whose names operators use themselves."""
    plain = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    extra = ("id", "doc", "mark", "words", "hits", "win", "n_words", "key", "node", "n", "line", "keep", "ids", "block", "label", "set", "rep")
    return plain.select("*", *(F.lit(f"x {c}").alias(c) for c in extra), F.lit(1).alias("n_chars"))


@pytest.fixture(scope="session")
def none(docs) -> DataFrame:
    return docs.where("false")


def got(df: DataFrame) -> list[str]:
    return sorted(map(repr, map(tuple, df.collect())))


def want(rows: list[tuple]) -> list[str]:
    return sorted(map(repr, rows))
