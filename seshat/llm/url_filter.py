"""URL filters: host and path rules before a logistic regression on hashed character n-grams.

Scoring uses built-in expressions only. The model comes from LABELLED_URLS, a table of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lower_ascii
from .logistic import fit_logistic

WIDTH = 4096
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

#: Words of hosts that are sold for clicks, and of ordinary ones; hosts of both kinds are built from them in the same way.
BLOCKED_WORDS = "casino poker slots roulette jackpot bets betting lottery pills meds viagra pharmacy loans payday ads adserver banner tracker clicks popup cams adult xxx escort warez crack keygen torrent".split()
ALLOWED_WORDS = "news docs wiki recipes university library history weather museum forum books travel maps science garden music school events winter cheese health sports games video photo blog bank market mail status".split()
DOMAINS = ("example.com", "example.org", "site.net", "portal.io", "web.de", "pages.fr", "shop.co.uk")


def built(words: list[str]) -> list[str]:
    """Two hosts a word, alone and with the next one, under all domains and with ordinary paths by turns."""
    paths = ("/", "/en/1201", "/index.html", "/de/33.html", "/a/b?", "/fr/7424", "/page/2", "/es/9/")
    pairs = [(f"www.{w}", f"{w}-{words[(i + 1) % len(words)]}") for i, w in enumerate(words)]
    return [f"{host}.{DOMAINS[(2 * i + j) % len(DOMAINS)]}{paths[(3 * i + j) % len(paths)]}" for i, hosts in enumerate(pairs) for j, host in enumerate(hosts)]


#: Hosts and paths judged by hand, and built ones.
BLOCKED_URLS = built(BLOCKED_WORDS) + """
casino-win.example.com/en/1201 m.casino-win.example.com/de/33.html online-casino.test.net/play www.casino-royal.test.org/bonus/
best-casino.test.com/slots free-bets.example.com/en/5462 www.free-bets.example.net/fr/12 freebets.test.com/odds sports-bets.test.net/tips/
bet-win.test.org/es/9 cheap-pills.example.com/de/6652.html m.cheap-pills.example.org/en/1 cheap-meds.test.net/order pills-online.test.com/buy/
buy-pills.test.org/cheap ads-track.example.com/en/9823 www.ads-track.example.net/es/4 track-ads.test.com/click ad-tracker.test.net/pixel
ads.test.org/banner/ clicktrack.test.com/ads win-big.test.net/jackpot jackpot-slots.test.com/en/ poker-win.test.org/free
free-pills.test.net/ cheap-casino.test.com/win adult-cams.test.com/live xxx-cams.test.net/ payday-loans.test.org/fast cheap-loans.test.com/
""".split()  # fmt: skip
ALLOWED_URLS = built(ALLOWED_WORDS) + """
www.example.com/en/1291/ blog.example.com/fr/7424.html m.example.net/de/8511 example.org/es/2547/ news.test.com/world/2024/ docs.test.org/guide
www.thering.example.org/en/1291/ therst.example.net/fr/4163 ththan.example.com/en/7944 tionble.example.org/en/482/ m.theron.example.net/de/5989
blog.tionsh.example.com/en/1524/ ththble.example.com/fr/7376 www.ththtion.example.com/es/4200/ thther.example.net/es/6964/ edher.example.com/de/10
erand.example.org/fr/77 inging.example.net/en/8.html andre.example.com/es/311 wiki.test.net/page/physics recipes.test.com/bread university.test.org/research
library.test.net/catalog/ history.test.org/article/12 weather.test.com/forecast museum.test.org/visit forum.test.net/thread/99 shop.test.com/books/
travel.test.org/maps/ m.stand.example.net/fr/5 www.heater.example.com/en/32 www.onion.example.org/de/1 m.reader.example.com/es/16.html code.test.net/repo
science.test.org/journal garden.test.com/plants music.test.net/album school.test.org/lessons/ local.test.com/events/ blog.winter.example.com/en/4
www.between.example.net/de/7 window.test.org/ trackfield.test.com/club cheese.test.net/ better.test.org/life address.test.com/ loading.test.net/
""".split()  # fmt: skip


def grams(host: str, path: str) -> list[int]:
    """Buckets of the character n-grams of ``^host$`` and ``/path`` with its digits as 0."""
    where = path.translate(str.maketrans("123456789", "0" * 9))
    return [zlib.crc32(f"{kind}{s[i : i + k]}".encode()) % WIDTH for kind, s in (("h", f"^{host}$"), ("p", where)) for k in SIZES for i in range(len(s) - k + 1)]


@lru_cache
def model() -> tuple[tuple[float, ...], float]:
    """Weights and intercept for the log odds of block; sums are over n-grams divided by the root of their number."""
    urls = [u.partition("/") for u in (*BLOCKED_URLS, *ALLOWED_URLS)]
    labels = [1] * len(BLOCKED_URLS) + [0] * len(ALLOWED_URLS)
    weights, bias = fit_logistic([grams(h, s + p) for h, s, p in urls], np.array(labels), WIDTH, 2)
    return tuple(round(float(x), 6) for x in weights[:, 1] - weights[:, 0]), round(float(bias[1] - bias[0]), 6)


def host_path(url: Column) -> tuple[Column, Column]:
    parts = "://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _log_odds(host: Column, path: Column) -> Column:
    """Each string is cut into characters once, and n-grams are put together from these: one step for each n-gram."""
    weights, bias = model()
    table = F.array(*map(F.lit, weights))

    def n_grams(kind: str, letters: Column, k: int) -> Column:
        starts = F.when(F.size(letters) >= k, F.sequence(F.lit(0), F.size(letters) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.crc32(F.encode(F.concat(F.lit(kind), *(F.get(letters, i + j) for j in range(k))), "UTF-8")))

    cut = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), 0)
    of = lambda kind, s: _let(cut(s), lambda letters: F.concat(*(n_grams(kind, letters, k) for k in SIZES)))
    found = F.concat(of("h", F.concat(F.lit("^"), host, F.lit("$"))), of("p", F.translate(path, "123456789", "0" * 9)))
    total = F.aggregate(found, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, g: F.struct((a["s"] + F.element_at(table, (g % WIDTH + 1).cast("int"))).alias("s"), (a["n"] + 1).alias("n")))
    return _let(total, lambda t: F.lit(bias) + t["s"] / F.sqrt(F.greatest(t["n"], F.lit(1)).cast("double")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: the id, host, path, rule, verdict and score (log odds of block by the model).

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up
    to ``?``, ``#`` or the end. The longest rule (host and path together, first of equals) decides; else
    the model blocks where its log odds are positive.

    A null url, an empty one and one without ``://`` have an empty host and path and no rule; the model
    judges them by its intercept and allows them. Repeated rows and ids give a row each; an empty table
    gives none; other columns of ``pages`` are not read, whatever their names. No shuffle.
    """
    host, path = host_path(pages[url_column])
    parts = pages.select(pages[id_column].alias(id_column), host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    rule = decided = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        decided = F.when(fits, r.verdict) if decided is None else decided.when(fits, r.verdict)
    rule, decided = (F.lit(None).cast("string") if c is None else c for c in (rule, decided))
    scored = parts.select("*", rule.alias("rule"), decided.alias("decided"), _log_odds(host, path).alias("score"))
    return scored.select(id_column, "host", "path", "rule", F.coalesce("decided", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
