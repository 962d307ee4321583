"""Column expressions over text: ids, names, slugs, tokens, excerpts, link targets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[\\p{L}\\p{N}]+"


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by ``:``; a null part counts as empty."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts)), 256)


def anchor(heading: Column) -> Column:
    """Lower case, runs of other characters than a-z, 0-9 and Hangul as ``-``; ``section`` if nothing is left."""
    slug = F.regexp_replace(F.lower(F.trim(heading)), "[^a-z0-9가-힣]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("section"))


def entity_name(name: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.regexp_replace(F.trim(F.lower(name)), "(?U)\\s+", " ")


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; of null, none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != ""))


def excerpt(text: Column, limit: int = 240) -> Column:
    """White space collapsed; cut with ``...`` beyond the limit."""
    flat = F.trim(F.regexp_replace(text, "(?U)\\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


def hard_excerpt(text: Column, limit: int = 240) -> Column:
    """White space collapsed; the first ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, "(?U)\\s+", " ")), 1, limit)


def first_words(text: Column, limit: int) -> Column:
    """The first ``limit`` words between white space, joined by blanks."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != ""), 1, limit), " ")


def result_id(vault_id: Column, chunk_id: Column, rank: Column) -> Column:
    return F.concat(vault_id, F.lit(":"), chunk_id, F.lit(":rank-"), rank.cast("string"))


def result_title(title: Column, section: Column, path: Column) -> Column:
    """The title, else the section, else the file's name without its suffix."""
    given = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(given(title), given(section), F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.md$", ""))


def occurrences(found: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand in a row in an array of tokens.

    ``found`` is looked at many times: it has to be a column of a table or of a lambda, not the expression that splits a text.
    """
    if len(phrase) == 1:
        return F.size(F.filter(found, lambda t: t == phrase[0]))
    starts = F.when(F.size(found) >= len(phrase), F.sequence(F.lit(1), F.size(found) - (len(phrase) - 1))).otherwise(F.array().cast("array<int>"))
    here = lambda i: reduce(and_, [F.element_at(found, i + k) == t for k, t in enumerate(phrase)])
    return F.size(F.filter(starts, here))


def _folded(parts: Column) -> Column:
    """A path's parts with ``.`` and empty ones dropped and ``..`` resolved; null if it leaves the root."""
    step = lambda a, p: (
        F.when(a.isNull(), a)
        .when(p.isin("", "."), a)
        .when(p != "..", F.concat(a, F.array(p)))
        .when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        .otherwise(F.lit(None).cast("array<string>"))
    )
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def link_target(source_path: Column, raw: Column) -> Column:
    """A link's target as a path from the root; null for external links, bare anchors and escapes.

    The part after ``#`` or ``|`` is dropped and ``.md`` is added. A leading ``/`` is the root; ``./`` and
    ``../`` start at the source's folder; other targets with a folder start at the root, and bare names stay.
    """
    target = F.trim(F.regexp_replace(F.trim(raw), "[#|].*$", ""))
    folder = F.regexp_replace(source_path, "[^/]*$", "")
    joined = F.when(target.startswith("/"), F.substring(target, 2, 1 << 20)).when(target.startswith("./") | target.startswith("../"), F.concat(folder, target)).otherwise(target)
    path = F.array_join(_folded(F.split(joined, "/")), "/")
    named = F.when(path.endswith(".md"), path).otherwise(F.concat(path, F.lit(".md")))
    return F.when(raw.isNotNull() & (target != "") & ~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & path.isNotNull() & (path != ""), named)


#: Folders that stand for themselves below wiki/.
WIKI_FOLDERS = ("concepts/", "decisions/", "entities/", "maps/", "sources/", "systems/", "timelines/", "workflows/")


def provenance_path(raw: Column) -> Column:
    """A frontmatter reference as a path: ``[[target|alias]]`` unwrapped, ``#`` parts dropped, ``wiki/`` and ``.md`` added."""
    value = F.trim(raw)
    value = F.when(value.startswith("[[") & value.endswith("]]"), F.trim(F.regexp_extract(value, "^\\[\\[([^|\\]]*)", 1))).otherwise(value)
    value = F.replace(F.trim(F.regexp_replace(value, "#.*$", "")), F.lit("\\"), F.lit("/"))
    in_wiki = F.lit(False)
    for folder in WIKI_FOLDERS:
        in_wiki = in_wiki | value.startswith(folder)
    full = F.when(in_wiki, F.concat(F.lit("wiki/"), value)).otherwise(value)
    bare = ~F.element_at(F.split(full, "/"), -1).contains(".") & full.rlike("^(raw|wiki|docs|scratch)/")
    bad = (value == "") | value.startswith("/") | value.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | value.rlike("(^|/)\\.{1,2}(/|$)")
    return F.when(~bad, F.when(bare, F.concat(full, F.lit(".md"))).otherwise(full))
