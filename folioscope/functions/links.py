"""Links, tags and fields inside page text."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import WHITE_SPACE, trim_space

# fixed values: the syntax of links, tags, fields and outside addresses
WIKILINK = r"!?\[\[[^\]\n]+\]\]"
INLINE_TAG = r"(?:^|[\t\n\f\r ])#([a-zA-Z\p{L}][\w\p{L}/\-]*)"
FIELD = r"(?md)^(\w+)::[\t\n\f\r ]*(.+)$"
MD_LINK = r"!?\[[^\]]*\]\([^)]+\)"
OUTSIDE = r"\A(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|/|#)"

_TICKS = re.compile("`+")
_FENCE_LINE = re.compile("^[" + re.escape(WHITE_SPACE.replace("\n", "")) + "]*(?:```|~~~).*$", re.M)
_BRACKETS = re.compile(r"\[\[[^\]\n]+\]\]")


def code_ranges(body: str) -> list[tuple[int, int]]:
    """Sorted half-open ranges of fenced blocks and inline code."""
    marks = [m.span() for m in _FENCE_LINE.finditer(body)]
    # odd marker lines open a block and even ones close it; the last may stay open
    fences = list(zip([start for start, _ in marks[::2]], [*(end for _, end in marks[1::2]), len(body)]))

    inline: list[tuple[int, int]] = []
    at = body.find("`")
    while at >= 0:
        fence = _range_at(fences, at)
        if fence is not None:
            at = body.find("`", fence[1])
            continue
        run = _TICKS.match(body, at).group()
        close = body.find(run, at + len(run))
        if close < 0:
            break
        inline.append((at, close + len(run)))
        at = body.find("`", close + len(run))

    merged: list[tuple[int, int]] = []
    for start, end in sorted(fences + inline):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _range_at(ranges: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    i = bisect_right(ranges, (at, float("inf"))) - 1
    return ranges[i] if i >= 0 and at < ranges[i][1] else None


def links_outside_code(body: str) -> list[str]:
    """Wikilinks as written, but for those that start inside code."""
    ranges = code_ranges(body)
    kept = []
    for m in _BRACKETS.finditer(body):
        if _range_at(ranges, m.start()) is None:
            embed = m.start() > 0 and body[m.start() - 1] == "!"
            kept.append(("!" if embed else "") + m.group())
    return kept


@F.pandas_udf(T.ArrayType(T.StringType()))
def _links_outside_code(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else links_outside_code(b))


def _targets(links: Column, embedded: bool) -> Column:
    """Trimmed, distinct targets in order of first use."""
    kind = F.filter(links, lambda m: m.startswith("!") if embedded else ~m.startswith("!"))
    inner = F.transform(kind, lambda m: F.regexp_replace(m, r"\A!?\[\[|\]\]\z", ""))
    target = F.transform(
        inner, lambda t: trim_space(F.substring_index(F.substring_index(t, "|", 1), "#", 1)))
    return F.array_distinct(F.filter(target, lambda t: t != ""))


def wikilinks(body: Column) -> tuple[Column, Column]:
    """``(links, attachments)``; Python sees only texts that mix links and code."""
    has_code = body.contains("[[") & (body.contains("`") | body.contains("~~~"))
    found = F.when(has_code, _links_outside_code(F.when(has_code, body))).otherwise(
        F.regexp_extract_all(body, F.lit(WIKILINK), 0))
    return _targets(found, False), _targets(found, True)


def markdown_links(body: Column) -> tuple[Column, Column]:
    """``(links, attachments)`` of inline Markdown links to pages of the corpus."""
    found = F.regexp_extract_all(body, F.lit(MD_LINK), 0)

    def targets(embedded: bool) -> Column:
        kind = F.filter(found, lambda m: m.startswith("!") if embedded else ~m.startswith("!"))
        href = F.transform(kind, lambda m: trim_space(
            F.regexp_replace(m, r"\A!?\[[^\]]*\]\(|\)\z", "")))
        inside = F.filter(href, lambda h: ~h.rlike(OUTSIDE))
        bare = F.transform(inside, lambda h: trim_space(F.substring_index(h, "#", 1)))
        return F.array_distinct(F.filter(bare, lambda h: h != ""))

    return targets(False), targets(True)


def inline_tags(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(INLINE_TAG), 1)


def fields(body: Column) -> Column:
    """``key:: value`` lines as a map; the last value of a key wins."""
    keys = F.regexp_extract_all(body, F.lit(FIELD), 1)
    values = F.transform(F.regexp_extract_all(body, F.lit(FIELD), 2), trim_space)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    names = F.array_distinct(keys)
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    return F.map_from_arrays(names, last)
