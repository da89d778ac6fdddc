"""Text keys and shingles as column expressions; Python only for Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space spelled out, so that every engine reads it alike.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Fixed value: the lexical units of a shingle.
UNITS = r"\\[a-z]+|[a-z]+|[0-9]+(?:\.[0-9]+)?|[^\p{L}\p{N}_\s]"


def text_key(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def stripped(text: Column) -> Column:
    """White space taken from both ends only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def question_key(text: Column) -> Column:
    """NFKC, case-folded, white space collapsed; null stays null."""
    return text_key(_folded(text))


def plain_question_key(text: Column) -> Column:
    """As ``question_key`` by lower-casing alone: exact for texts without compatibility or folding characters."""
    return text_key(F.lower(text))


def instruction_free(text: Column) -> Column:
    """Without one leading instruction on the answer's box."""
    return F.regexp_replace(text, rf"(?i)^{SPACE}*Return your final response within \\+boxed\{{\}}\.{SPACE}*", "")


def number_masked(text: Column) -> Column:
    """Numbers replaced by a mark, white space collapsed."""
    return text_key(F.regexp_replace(text, r"[0-9]+(?:\.[0-9]+)?", "<NUM>"))


def units(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(UNITS), 0)


def shingles(key: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` units of a normalised text; a shorter text is one run of all of them."""
    runs = lambda u: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(u) - n + 1)), lambda i: F.array_join(F.slice(u, i, F.lit(n)), " ")
    )
    return F.array_distinct(once(units(key), runs))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression is evaluated for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Number of space-separated words."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


#: Fixed value: the signs and words of operations.
OPERATIONS = r"\+|-|\*|/|=|\bplus\b|\bminus\b|\btimes\b|\bdivid(?:e|ed)\b"


def operation_count(text: Column) -> Column:
    """Arithmetic signs and operation words in a text."""
    return F.regexp_count(F.lower(text), F.lit(OPERATIONS)).cast("long")
