"""Dart files as symbols and references, by a tolerant reader: tokens, matched brackets, members, calls in their bodies.

What it doesn't know it steps over up to the next member, and names in a diagnostic.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_TOKEN = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<string>r?(?:'{3}.*?(?:'{3}|\Z)|"{3}.*?(?:"{3}|\Z))|r'[^'\n]*'?|r"[^"\n]*"?|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.|\.\.|\[\]=|\[\]|==|<=|>=|[^\s])""",
    re.DOTALL,
)
_OPEN, _CLOSE = "([{", ")]}"
_MODIFIERS = {"abstract", "sealed", "base", "final", "interface"}
_NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "await", "in", "is", "as", "throw", "yield", "super", "when", "case"}
_KINDS = {"class": "class", "mixin": "mixin", "extension": "interface"}
SIGNATURE = 512


class Source:
    """Tokens of a text, and for each bracket its other end; brackets that never close end with the text."""

    def __init__(self, text: str):
        found = [m for m in _TOKEN.finditer(text) if m.lastgroup]
        self.text, self.tokens, self.kinds = text, [m.group() for m in found], [m.lastgroup for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.close, self.open, self.odd = {}, {}, None
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if self.kinds[i] != "op" or len(t) > 1:
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                if stack and self.tokens[stack[-1]] == _OPEN[_CLOSE.index(t)]:
                    self.close[stack[-1]], self.open[i] = i, stack[-1]
                    stack.pop()
                elif self.odd is None:
                    self.odd = i
        for i in stack:
            self.close[i] = len(self.tokens) - 1
            self.odd = i if self.odd is None else self.odd

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.starts[min(i, len(self.starts) - 1)] - 1) + 1 if self.starts else 1

    def written(self, a: int, b: int) -> str:
        """The text of tokens a to b, b not included."""
        return self.text[self.starts[a] : self.ends[b - 1]] if a < b else ""

    def past(self, i: int) -> int:
        """The token after i, or after the bracket that opens at i."""
        return self.close.get(i, i) + 1

    def until(self, i: int, stop: int, *marks: str) -> int:
        """The first of the marks from i on that is in no bracket."""
        while i < stop and self.tokens[i] not in marks:
            i = self.past(i)
        return min(i, stop)

    def generics(self, i: int) -> int:
        """The token after ``<...>`` that starts at i, or i."""
        if i >= len(self.tokens) or self.tokens[i] != "<":
            return i
        depth = 0
        while i < len(self.tokens) and self.tokens[i] not in ("{", ";"):
            depth += (self.tokens[i] == "<") - (self.tokens[i] == ">")
            i = self.past(i)
            if not depth:
                return i
        return i


class _Reader:
    def __init__(self, path: str, text: str, is_test: bool):
        self.s, self.is_test = Source(text), is_test
        self.symbols: list[tuple] = []
        self.references: list[tuple] = []
        self.messages: list[str] = []
        t = self.s.tokens
        name = "".join(t[1 : self.s.until(1, len(t), ";")]) if t[:1] == ["library"] and len(t) > 1 and self.s.kinds[1] == "name" else path.rsplit("/", 1)[-1].removesuffix(".dart") or "module"
        self.symbols.append(("module", name.rsplit(".", 1)[-1], name, None, 1, max(1, text.count("\n") + 1)))
        if self.s.odd is not None:
            self.messages.append(f"syntax_error:{self.s.line(self.s.odd)}:unbalanced {t[self.s.odd]}")
        self.members(0, len(t), name, None)

    def add(self, kind: str, name: str, owner: str, first: int, head: int, last: int, within: str | None) -> str:
        qualified = f"{owner}.{name}"
        self.symbols.append((kind, name, qualified, " ".join(self.s.written(first, head).split())[:SIGNATURE], self.s.line(first), self.s.line(last)))
        self.references.append((owner, "CONTAINS" if within else "DEFINES", qualified))
        return qualified

    def unknown(self, i: int, what: str) -> None:
        self.messages.append(f"unsupported_construct:{self.s.line(i)}:{what}")

    def members(self, i: int, stop: int, owner: str, within: str | None) -> None:
        """Declarations from i to stop; ``within`` is the name of the class that they are in."""
        s, t = self.s, self.s.tokens
        while i < stop:
            if t[i] == "@":
                i = s.until(i + 1, stop, *_MODIFIERS, "class") if i + 1 >= stop else self.annotation(i + 1)
            elif t[i] in (";", "}", ")", "]"):
                i += 1
            else:
                i = self.member(i, stop, owner, within)

    def annotation(self, i: int) -> int:
        i += 1
        while i + 1 < len(self.s.tokens) and self.s.tokens[i] == ".":
            i += 2
        return self.s.past(i) if i < len(self.s.tokens) and self.s.tokens[i] == "(" else i

    def member(self, i: int, stop: int, owner: str, within: str | None) -> int:
        s, t = self.s, self.s.tokens
        if not within and t[i] in ("library", "import", "export", "part"):
            end = s.until(i, stop, ";")
            if t[i] == "import":
                self.references += [(owner, "IMPORTS", t[k].strip("r\"'")) for k in range(i, end) if s.kinds[k] == "string"][:1]
            return end + 1
        key = i
        while key < stop and t[key] in _MODIFIERS and t[key + 1 : key + 2] and s.kinds[min(key + 1, stop - 1)] == "name":
            key += 1
        key += t[key : key + 2] == ["mixin", "class"]
        if not within and key < stop and t[key] in _KINDS and key + 1 < stop and (s.kinds[key + 1] == "name"):
            return self.type(i, key, stop, owner)
        if not within and t[i] in ("enum", "typedef"):
            self.unknown(i, t[i])
            end = s.until(i, stop, "{", ";")
            return s.past(end)
        return self.value(i, stop, owner, within)

    def type(self, first: int, key: int, stop: int, owner: str) -> int:
        s, t = self.s, self.s.tokens
        body = s.until(key, stop, "{", ";", "=")
        named = t[key + 1] if t[key + 1] != "on" else "extension"
        end = s.past(body) - 1 if body < stop and t[body] == "{" else s.until(body, stop, ";")
        qualified = self.add(_KINDS[t[key]], named, owner, first, body, min(end, len(t) - 1), None)
        k, relation = (s.generics(key + 2) if t[key + 1] != "on" else key + 1), None
        fresh = False
        while k < body:
            if t[k] in ("extends", "with", "implements", "on"):
                relation, fresh, k = "EXTENDS" if t[k] == "extends" else "IMPLEMENTS", True, k + 1
            elif t[k] == ",":
                fresh, k = True, k + 1
            elif fresh and relation and s.kinds[k] == "name":
                parts = [t[k]]
                while t[k + 1 : k + 2] == ["."] and k + 2 < body:
                    k += 2
                    parts.append(t[k])
                self.references.append((qualified, relation, ".".join(parts)))
                fresh, k = False, s.generics(k + 1)
            else:
                k += 1
        if body < stop and t[body] == "{":
            self.members(body + 1, end, qualified, named)
        return end + 1

    def value(self, first: int, stop: int, owner: str, within: str | None) -> int:
        """A function, method, constructor, accessor, operator or variables."""
        s, t = self.s, self.s.tokens
        head = s.until(first, stop, "{", ";", "=>", "=")
        operator = next((k for k in range(first, min(head + 2, stop)) if t[k] == "operator"), None)
        if operator is not None:
            head = next((k for k in range(operator + 2, stop) if t[k] == "("), stop)
            return self.callable("method", "operator " + "".join(t[operator + 1 : head]), first, head, stop, owner, within)
        accessor = next((k for k in range(first, min(head, stop - 1)) if t[k] in ("get", "set") and s.kinds[k + 1] == "name"), None)
        if accessor is not None:
            return self.callable("property", t[accessor + 1], first, accessor + 2, stop, owner, within)
        k = first
        while k < head:
            if t[k] == "(" and k > first:
                back = k - 1
                if t[back] == ">":
                    depth = 0
                    while back > first:
                        depth += (t[back] == ">") - (t[back] == "<")
                        back -= 1
                        if not depth:
                            break
                if s.kinds[back] == "name" and t[back] != "Function":
                    kind = "method" if within else "test" if self.is_test or t[back].startswith("test") else "function"
                    return self.callable(kind, t[back], first, k, stop, owner, within)
            k = s.past(k)
        end = s.until(first, stop, ";")
        if not within:
            self.unknown(first, "record" if t[first] == "(" else "variable")
            self.calls(first, end, owner, False)
            return end + 1
        a = first
        while a < end:
            b = s.until(a, end, ",")
            name_end = s.until(a, b, "=")
            if name_end > a and s.kinds[name_end - 1] == "name" and (name_end - 1 > first or b < end):
                qualified = self.add("property", t[name_end - 1], owner, first if a == first else a, name_end, b - 1, within)
                self.calls(name_end, b, qualified, False)
            a = b + 1
        return end + 1

    def callable(self, kind: str, name: str, first: int, params: int, stop: int, owner: str, within: str | None) -> int:
        s, t = self.s, self.s.tokens
        after = s.past(params) if params < stop and t[params] == "(" else params
        initial = after < stop and t[after] == ":"
        body = s.until(after, stop, "{", ";") if initial else s.until(after, stop, "{", ";", "=>", "=")
        end = s.past(body) - 1 if body < stop and t[body] == "{" else s.until(body, stop, ";")
        qualified = self.add(kind, name, owner, first, after, min(end, len(t) - 1), within)
        self.calls(after, end, qualified, kind == "test")
        return end + 1

    def calls(self, a: int, b: int, owner: str, test: bool) -> None:
        s, t = self.s, self.s.tokens
        for p in range(a + 1, min(b, len(t))):
            if t[p] != "(" or s.kinds[p - 1] != "name" or t[p - 1] in _NO_CALLS:
                continue
            made = s.past(p)
            start = self.receiver(p - 1, a)
            if start == p - 1 and made < len(t) and t[made] in ("{", "=>", "async", "sync"):
                continue  # a function that is declared here
            parts = [x for x in t[start:p] if x not in (".", "?.", "..")]
            simple = all(s.kinds[k] == "name" or t[k] == "." for k in range(start, p))
            created = start > 0 and t[start - 1] in ("new", "const")
            if start == p - 1 or simple and (created or any(x[:1].isupper() for x in parts[-2:])):
                target = ".".join(parts)
            else:
                target = f"dynamic:{s.written(start, p - 2)}.{t[p - 1]}"
            self.references.append((owner, "CALLS", target))
            if test:
                self.references.append((owner, "TESTS", target))

    def receiver(self, i: int, least: int) -> int:
        """Where the expression starts whose member is named at i."""
        s, t = self.s, self.s.tokens
        while i - 2 >= least and t[i - 1] in (".", "?."):
            i -= 2
            while t[i] in (")", "]") and i in s.open:
                i = s.open[i]
                if i - 1 >= least and (s.kinds[i - 1] == "name" and t[i - 1] not in _NO_CALLS or t[i - 1] in (")", "]")):
                    i -= 1
                else:
                    break
        return i


def parse(path: str, text: str, is_test: bool = False) -> tuple[list[tuple], list[tuple], list[str]]:
    """Symbols (kind, name, qualified name, signature, line, end line), references (from, relation, name), diagnostics."""
    read = _Reader(path, text, is_test)
    return read.symbols, read.references, read.messages
