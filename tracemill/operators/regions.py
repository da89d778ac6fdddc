"""Places of tokens in texts, and which of them lie in regions and spans of the text.

A text is one row, and its tokens are an array beside it: all here is a column function of that row, so nothing is
shuffled and a text's tokens never become rows unless a caller wants them.  Places are counted in code points.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from tracemill.functions.text import once

#: A word between spaces, tabs and line ends, and the heading of an answer.
WORD = r"[^ \t\n\r]+"
HEADING = r"(?im)^\s*(?:final\s+)?answer\s*:"
PLACES = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _lists(sizes: list[int | None], values: pa.Array) -> pa.Array:
    """A list array of the given sizes; a null size is a null list."""
    offsets = np.concatenate(([0], np.cumsum([n or 0 for n in sizes]))).astype(np.int32)
    gone = pa.array([n is None for n in sizes] + [False])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=gone.to_numpy(zero_copy_only=False)), values) if None in sizes else pa.ListArray.from_arrays(pa.array(offsets), values)


def places(text: Column, pattern: str = WORD) -> Column:
    """array of struct(start, end): where a pattern matches, from left to right; null for a null text."""
    found = re.compile(pattern)

    @F.arrow_udf(PLACES)
    def run(texts: pa.Array) -> pa.Array:
        sizes, parts = [], [np.zeros((0, 2), np.int32)]
        for t in texts:
            if (said := t.as_py()) is None:
                sizes.append(None)
                continue
            spans = [m.span() for m in found.finditer(said)]
            sizes.append(len(spans))
            parts.append(np.array(spans, np.int32).reshape(-1, 2))
        flat = np.concatenate(parts)
        return _lists(sizes, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))

    return run(text)


def words(text: Column) -> Column:
    """The words themselves, in the order of ``places``."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def first_span(text: Column, pattern: str, lead: str = "") -> Column:
    """struct(start, end) of the first match of ``pattern`` behind a match of ``lead``; null without any.

    ``pattern`` may begin with flags such as (?im).
    """
    flags = pattern[: pattern.index(")") + 1] if pattern.startswith("(?") and pattern[2:3].isalpha() else ""
    whole = rf"{flags}\A((?s:.*?){lead})({pattern[len(flags):]})"
    start = F.char_length(F.regexp_extract(text, whole, 1))
    return F.when(text.rlike(whole), F.struct(start.alias("start"), (start + F.char_length(F.regexp_extract(text, whole, 2))).alias("end")))


def regions(tokens: Column, span: Column) -> Column:
    """For each token 0 before the span, 1 from its start on, 2 behind it; all 0 without a span.

    A token across a border belongs to the later region.
    """
    of = lambda t, s: F.when(s.isNull() | (t["end"] <= s["start"]), 0).when(t["start"] < s["end"], 1).otherwise(2)
    return once(F.struct(tokens.alias("t"), span.alias("s")), lambda b: F.transform(b["t"], lambda t: of(t, b["s"])))


@F.arrow_udf(ArrayType(BooleanType()))
def covered(tokens: pa.Array, spans: pa.Array) -> pa.Array:
    """For each token whether it overlaps any of the spans, of which there may be many, nested and in any order.

    One sweep: the spans by their starts, with the furthest end so far; a token looks at those that start before its end.
    """
    sizes, parts = [], [np.zeros(0, bool)]
    for t, s in zip(tokens, spans, strict=True):
        if not t.is_valid:
            sizes.append(None)
            continue
        own, over = t.values, s.values if s.is_valid else None
        sizes.append(len(own))
        if over is None or not len(over):
            parts.append(np.zeros(len(own), bool))
            continue
        start, end = over.field("start").to_numpy(), over.field("end").to_numpy()
        order = np.argsort(start, kind="stable")
        reach = np.maximum.accumulate(end[order])
        before = np.searchsorted(start[order], own.field("end").to_numpy(), side="left")
        parts.append((before > 0) & (reach[np.maximum(before - 1, 0)] > own.field("start").to_numpy()))
    return _lists(sizes, pa.array(np.concatenate(parts)))


def eligible_positions(tokens: Column, said: Column, heading: Column, excluded: list[str], tail: int, most: int | None = None, count: int | None = None, of_body: bool = False) -> Column:
    """Positions of the tokens before the heading that have a letter or digit, no backslash and no excluded word.

    ``said`` are the tokens' texts.  The last ``tail`` tokens, of the text or (``of_body``) of what lies before the heading,
    and positions from ``most`` on are not eligible; ``count`` keeps the first ones.  Without a heading the text ends it.
    """
    bad = F.array(*map(F.lit, excluded)).cast("array<string>")

    def chosen(both: Column) -> Column:
        places_, opens = both["t"], both["h"]["start"]
        before = lambda t: opens.isNull() | (t["end"] <= opens)
        last = F.size(F.filter(places_, before)) if of_body else F.size(places_)
        limit = last - tail if most is None else F.least(last - tail, F.lit(most))

        def fit(t: Column) -> Column:
            listed = F.arrays_overlap(F.regexp_extract_all(F.lower(t["w"]), F.lit("[a-z]+"), 0), bad)
            return before(t["t"]) & ~F.contains(t["w"], F.lit("\\")) & t["w"].rlike(r"[\p{L}\p{N}]") & ~listed

        placed = F.transform(F.arrays_zip(places_.alias("t"), both["w"].alias("w")), lambda t, i: F.struct(t["t"].alias("t"), t["w"].alias("w"), i.alias("i")))
        ahead = F.slice(placed, 1, F.greatest(limit, F.lit(0)))
        return F.transform(F.filter(ahead, fit), lambda t: t["i"])

    found = once(F.struct(tokens.alias("t"), said.alias("w"), heading.alias("h")), chosen)
    return found if count is None else F.slice(found, 1, F.lit(count))
