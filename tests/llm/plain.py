"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def decontamination(docs, items) -> list[tuple]:
    windows: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = WORD.findall((text or "").translate(AZ))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[n][tuple(w[i : i + n])].update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(AZ))
        hit, found = set(), set()
        for n, of in windows.items():
            for i in range(len(w) - n + 1):
                if (names := of.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def components(docs) -> list[tuple]:
    sets = []
    for _, text in docs:
        w = SPACED.findall((text or "").translate(AZ))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(docs)]


def line_dedup(docs) -> list[tuple]:
    where = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            where[key(line)].add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text in docs:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            k = key(line)
            if not (len(k) >= 40 and len(where[k]) >= 5 and max(where[k]) != (-(1 << 63) if doc is None else doc)):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(SPACED.search(line)) and line in seen
        seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def secrets(text: str) -> list[tuple[str, int, int]]:
    """The three base patterns, character by character."""
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    lower = text.translate(AZ)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at: int, allowed) -> int:
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assign(at: int) -> int | None:
        """Where the match at ``at`` ends, the longest way, or None."""
        name = next((n for n in names if lower.startswith(n, at)), None)
        if name is None:
            return None
        k = at + len(name)
        k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
        k = run(k, " ")
        if text[k : k + 1] not in (":", "=") or k >= len(text):
            return None
        k = run(k + 1, " ")
        k += k < len(text) and text[k] in "'\""
        end = run(k, value)
        return (end, end - k) if end > k else None

    out, at = [], 0
    while at < len(text):
        if hit := assign(at):
            if hit[1] >= 6:
                out.append(("assign", at, hit[0]))
            at = hit[0]
        else:
            at += 1
    for kind, head, allowed, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = run(at + len(head), allowed) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    out.append((kind, at, end))
                at = end
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def merkle(rows: list[tuple]) -> list[tuple]:
    """rows: (doc_id, source, lang, n_chars, text). As op11's contract, with lists."""
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(spell, r)))
    later = lambda r: r[:4] + (r[4].translate(AZ),) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r

    def levels(hashes: list[str]) -> list[list[str]]:
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def climb(tree: list[list[str]], i: int, folded: str) -> tuple[str, str]:
        passed = ""
        for level in tree[:-1]:
            own = level[i - i % 16 : i - i % 16 + 16]
            left, right = "".join(own[: i % 16]), "".join(own[i % 16 + 1 :])
            passed, folded, i = passed + left + right, sha(left + folded + right), i // 16
        return passed, folded

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            a, folded = climb(trees[s], i, leaf(later(r)))
            b, folded = climb(top, k, folded)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(a + b), folded, folded == top[-1][0]))
    return out


def period_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every period."""
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(24, 3 * q):
                out.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def op12(doc_id: int | None, text: str | None) -> tuple:
    w = SPACED.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = period_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def nearest(rows: list[tuple], every: int, k: int, scale: int) -> list[tuple]:
    """(query_id, rank, vec_id, score) of rows (vec_id, components)."""
    z = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in z:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in z if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out
