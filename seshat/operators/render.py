"""Results as JSON and Markdown, for a few rows that a query returned."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row

MAX_ROWS = 1000


def _plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a result has a number that JSON doesn't have")
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(df: DataFrame) -> list[Row]:
    """All rows of a result; an error if it is no small one."""
    found = df.limit(MAX_ROWS + 1).collect()
    if len(found) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows are no result to render")
    return found


def to_json(df: DataFrame) -> str:
    return json.dumps([_plain(r) for r in rows(df)], sort_keys=True, ensure_ascii=False, indent=1)


def to_markdown(df: DataFrame, title: str, heading: str, body: Sequence[str]) -> str:
    """A section for each row: its heading's column, and the others as a list."""
    parts = [f"# {title}"]
    for r in rows(df):
        parts += [f"## {r[heading]}", "\n".join(f"- {c}: {_plain(r[c])}" for c in body)]
    return "\n\n".join(parts) + "\n"
