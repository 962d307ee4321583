"""Secret scans: three fixed patterns, then assignment-aware lexing of source and configuration text.

The lexer reads names with their literals (``name = "literal"``, ``"name": "literal"``, ``env["NAME"] = "literal"``,
``export NAME=literal``, ``name: str = "literal"``, YAML blocks, strings side by side or in three quotes, tokens after
``Bearer`` or ``Basic``, and pairs of ``key="NAME" value="literal"``), carries literals through constants wherever they are
defined (``key = value_name``, joined with ``+``), and scores a literal by how sensitive the names are that it reaches,
and by how random it looks. It goes through a text once: no character is looked at more than a few times.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "lexed")

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

_NAME = r"[A-Za-z_$][\w$]*+(?:[.-]++[\w$]++)*+"
_LONG = r"""(?:\"{3}(?:[^"]++|"(?!""))*+"{3}|'{3}(?:[^']++|'(?!''))*+'{3})"""
_STRING = rf"""(?<![\w\\])[fFrRbBuU]?(?:{_LONG}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\\n]++|\\.)*+`)"""
_BARE = r"""(?:[^\s"'`,;{}()\[\]<>|#&\\+]|\+(?!["'`]))++"""
#: Names with their separators, one or more (``a = b = ``), then what is assigned up to the end of the statement.
_KEY = rf"""["']?+{_NAME}["']?+\]?+[ \t]*+(?::=|=>|=(?![=~])|:(?![:=]|//))[ \t]*+"""
_LEXED = re.compile(rf"""(?<![\w$.\\-])(?P<names>(?:{_KEY})++)(?:(?P<block>[|>][-+]?[ \t]*+\n)|(?P<value>\(\s*+{_STRING}(?:\s*+(?:\+\s*+)?{_STRING})*+\s*+\)|(?ai:Bearer|Basic)[ \t]++{_BARE}|(?:{_STRING}|{_BARE})(?:[ \t]*+\+[ \t]*+(?:{_STRING}|{_BARE})|(?<=["'`])[ \t]++{_STRING})*+))?+|{_STRING}""")
_NAMES = re.compile(_NAME)
_ITEM = re.compile(rf"(?P<string>{_STRING})|(?P<bare>{_BARE})")
_QUOTED = re.compile("[\"'` \t]")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*+")
_OPENING = re.compile(r"""[fFrRbBuU]?(?:(?P<long>"{3}|'{3})\s*+|["'`])(?:(?ai:Bearer|Basic)[ \t]++(?=[^\s"'`]++\s*+["'`]))?+""")
#: A literal of one of the first names is the name of what the next assignment, if it is to one of the second, has.
_KEYS, _VALUES, _BETWEEN = {"key", "name"}, {"value", "content"}, re.compile(r"[\s,]*+")

#: Parts of names and what they say about the literal.
_SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3, "auth": 2, "authorization": 2, "bearer": 2, "private": 1, "access": 1, "api": 1, "client": 1, "key": 1, "signing": 1, "encryption": 1, "session": 1, "salt": 1, "pass": 2}
#: A text without any of these has no sensitive name.
_SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "private", "access", "api", "client", "sign", "encrypt", "session", "salt")
_HARMLESS = {"public", "length", "size", "count", "limit", "name", "type", "url", "uri", "path", "file", "id", "expires", "ttl", "header", "field", "policy", "hint", "label"}
#: Parts of names whose literals may have several words, and texts that ask for or speak of such a literal.
_PHRASED = {"password", "passwd", "passphrase", "pwd", "secret", "credential", "credentials"}
_PROMPTS = re.compile(r"(?i)^(?:please|enter|type|choose|confirm|repeat|forgot|invalid|wrong|incorrect|missing|the|a|new|no)\b.*\b(?:pass|password|passwd|passphrase|pwd|secret|credentials?)\b")
_DUMMIES = re.compile(r"(?i)^(?:x+|\*+|none|null|true|false|example|changeme|password|secret|token|your[-_ ].*|<.*>|\$\{.*\}|\$\w+|%\w+%|\{\{.*\}\})$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
THRESHOLD = 4.0
MIN_LITERAL = 8


def sensitivity(name: str) -> int:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if parts and parts[-1] in _HARMLESS:
        return 0
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return sum(_SENSITIVE.get(p, 0) for p in (*parts, *joined))


def phrased(name: str) -> bool:
    return sensitivity(name) > 0 and any(p.lower() in _PHRASED for p in _PARTS.findall(name))


def randomness(literal: str, phrase: bool = False) -> float:
    """0 for a word; more for many kinds of characters and high entropy; -4 for placeholders, and for several words unless they may be a ``phrase``."""
    if len(literal) < MIN_LITERAL or _DUMMIES.match(literal):
        return -4.0
    if any(c.isspace() for c in literal.strip()):
        return 1.0 if phrase and not _PROMPTS.match(literal.strip()) else -4.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    digits = any(c.isdigit() for c in literal)
    letters = any(c.isalpha() for c in literal)
    return (1.5 if digits and letters else 0.0) + max(0.0, entropy - 2.5)


def _block(text: str, at: int, line: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the lines from ``at`` that are further in than the line that starts at ``line``, and where they end."""
    margin = lambda k: len(own := text[k : end(k)]) - len(own.lstrip(" \t"))
    end = lambda k: e if (e := text.find("\n", k)) >= 0 else len(text)
    least, spans = margin(line), []
    while at < len(text):
        a, b = at + margin(at), end(at)
        if a < b:
            if a - at <= least:
                break
            spans.append((a, a + len(text[a:b].rstrip())))
        at = b + 1
    return spans, at


def named_literals(text: str) -> list[tuple[list[str], list[tuple[int, int]], list[str]]]:
    """(names, spans of their literals, names that those are built from) for each assignment, in order."""
    found, at, known, key = [], 0, {}, ("", -1)
    while m := _LEXED.search(text, at):
        at = m.end()
        if m["names"] is None:  # a string that is assigned to nothing
            continue
        spans, uses = [], []
        if m["block"] is not None:
            spans, at = _block(text, at, text.rfind("\n", 0, m.start()) + 1)
        elif (value := m["value"]) is not None:
            plain = not _QUOTED.search(value)
            for item in (m,) if plain else _ITEM.finditer(text, *m.span("value")):
                a, b = m.span("value") if plain else item.span()
                if not plain and item["string"]:
                    opening = _OPENING.match(text, a, b)
                    a, b = opening.end(), b - (3 if opening["long"] else 1)
                    spans.append((a, a + len(text[a:b].rstrip()) if opening["long"] else b))
                else:
                    spans.append((a, b))
                    if _IDENTIFIER.fullmatch(text, a, b):
                        uses.append(text[a:b])
        if (names := known.get(m["names"])) is None:
            names = known[m["names"]] = list(dict.fromkeys(_NAMES.findall(m["names"])))
        if _VALUES.issuperset(names) and key[0] and _BETWEEN.fullmatch(text, key[1], m.start()):
            names = [*names, key[0]]
        one = text[slice(*spans[0])] if len(spans) == 1 and _KEYS.issuperset(names) else ""
        key = (one if _NAMES.fullmatch(one) else "", at)
        found.append((names, spans, uses))
    return found


def _reached(uses: dict[str, set[str]], start: dict[str, int]) -> dict[str, int]:
    """The largest start value of the names that each name is used for, through any number of others, its own included."""
    out: dict[str, int] = {}
    for name in sorted(start, key=lambda n: -start[n]):
        wave = [name] if name not in out else []
        while wave:
            n = wave.pop()
            if n not in out:
                out[n] = start[name]
                wave += uses.get(n, ())
    return out


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name and look random enough."""
    folded = text.lower()
    if ("=" not in text and ":" not in text) or not any(p in folded for p in _SENSITIVE_PARTS):
        return []
    assigned = named_literals(text)
    uses: dict[str, set[str]] = {}
    for names, _, used in assigned:
        for name in names:
            uses.setdefault(name, set()).update(used)
    reach = _reached(uses, {n: s for n in uses if (s := sensitivity(n)) > 0})
    phrases = _reached(uses, {n: 1 for n in uses if phrased(n)})
    out = set()
    for names, spans, _ in assigned:
        score, phrase = max(reach.get(n, 0) for n in names), any(n in phrases for n in names)
        if score >= 2:
            out.update((a, b) for a, b in spans if score + randomness(text[a:b], phrase) >= THRESHOLD)
    return sorted(out)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive. Literals inside base spans add none."""
    if not text:
        return []
    folded = text.lower()
    spans = []
    if any(k in folded for k in _KEYWORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in spans)
    reach = list(accumulate((e for _, e in base), max))  # how far the base spans up to each one go
    inside = lambda a, b: (k := bisect_right(base, (a, math.inf))) > 0 and reach[k - 1] >= b
    spans += [("lexed", a, b) for a, b in lexed(text) if not inside(a, b)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t)] for t in batch.column(0).to_pylist()]
        yield pa.record_batch([batch.column(1), pa.array(rows, kind)], names=["id", "spans"])


def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id and spans, an array of (kind, start, end).

    A null or empty text has none. Repeated rows and ids give a row each; an empty table gives none; other
    columns of ``docs`` are not read. No shuffle.
    """
    texts = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id"))
    schema = f"id {dict(texts.dtypes)['id']}, spans array<struct<kind:string,start:int,end:int>>"
    return texts.mapInArrow(_scanned, schema).withColumnRenamed("id", id_column)
