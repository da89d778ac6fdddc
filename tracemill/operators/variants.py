"""One text to many rows: variants of a worked reference answer, and the steps of a piece of reasoning.

Both are table functions (UDTFs) that a row is joined with laterally, so what a text yields is rows from the start.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.exact import read
from tracemill.operators.answers import reasoning_steps

#: How a calculation is annotated behind its place, and a result that is shown after it.
ANNOTATION = re.compile(r"<<([^<>]*)>>")
SHOWN = re.compile(r"[-+]?\d[\d,]*(?:\.\d+)?")
#: What stands before the answer of a reference, and in its variants (no, other or a doubled label).
DELIMITER = "####"
LABELS = {"reference": "Answer: ", "result_marker": "Result: ", "no_marker": ""}
NOTES = {"neutral_note": "The label in this note is Entry.\n", "answer_note": "The label in this note is Answer.\n"}


def _shared(a: str, b: str, most: int, same: Callable[[str, str, int], bool]) -> int:
    """The greatest number up to ``most`` for which ``same`` holds, by bisection over whole pieces."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if same(a, b, middle) else (low, middle - 1)
    return low


def matching(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """(operation, start, end in a, start, end in b) that turn a into b, along a longest common subsequence.

    What both begin and end with is equal; the texts between are compared character by character.
    """
    head = _shared(a, b, min(len(a), len(b)), lambda x, y, n: x[:n] == y[:n])
    tail = _shared(a, b, min(len(a), len(b)) - head, lambda x, y, n: not n or x[-n:] == y[-n:])
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]  # of what is left from (i, j) on
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if x[i] == y[j] else max(longest[i + 1][j], longest[i][j + 1])
    runs, i, j = [(0, 0, head)], 0, 0  # equal pieces: start in a, start in b, length
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            runs.append((head + i, head + j, 1))
            i, j = i + 1, j + 1
        elif longest[i + 1][j] >= longest[i][j + 1]:
            i += 1
        else:
            j += 1
    runs.append((len(a) - tail, len(b) - tail, tail))
    made: list[list] = []
    at, to = 0, 0
    for p, q, n in runs:
        if p > at or q > to:
            made.append(["replace" if p > at and q > to else "delete" if p > at else "insert", at, p, to, q])
        if n and made and made[-1][0] == "equal":
            made[-1][2], made[-1][4] = p + n, q + n
        elif n:
            made.append(["equal", p, p + n, q, q + n])
        at, to = p + n, q + n
    return [tuple(m) for m in made]


def wrong_calculation(body: str) -> tuple[str, str, str, int, str] | None:
    """(text, expression, original, start, replacement): the first annotated result that is exactly right, its last digit raised by one.

    An annotation counts if its calculation, its own result and the number shown right after it are one number.
    The text is without annotations, and the start is a place in it; null if no annotation counts.
    """
    plain: list[str] = []
    at = 0
    for m in ANNOTATION.finditer(body):
        plain.append(body[at : m.start()])
        at = m.end()
        shown = SHOWN.match(body, at)
        left, equals, right = m[1].partition("=")
        if not (equals and shown) or "=" in right:
            continue
        values = [read(t) for t in (left, right, shown[0])]
        if None in values or values[0].rational is None or len(set(values)) > 1:
            continue
        last = max(k for k, c in enumerate(shown[0]) if c.isdigit())
        changed = f"{shown[0][:last]}{(int(shown[0][last]) + 1) % 10}{shown[0][last + 1 :]}"
        start = sum(map(len, plain))
        rest = changed + body[shown.end() :]
        return "".join(plain) + ANNOTATION.sub("", rest), left, shown[0], start, changed
    return None


def variants(answer: str) -> Iterator[tuple]:
    """(variant, text, gold, alignment with the reference, mutation, whether the reasoning is kept)."""
    body, gold = answer.split(DELIMITER)  # exactly one, or a ValueError
    gold = gold.strip()
    plain = ANNOTATION.sub("", body).rstrip()
    base = f"{plain}\n{LABELS['reference']}{gold}"
    texts = {name: f"{plain}\n{label}{gold}" for name, label in LABELS.items()} | {name: note + base for name, note in NOTES.items()}
    for name, text in texts.items():
        yield name, text, gold, matching(base, text), None, True
    if found := wrong_calculation(body):
        text, expression, original, start, replacement = found
        text = f"{text.rstrip()}\n{LABELS['reference']}{gold}"
        yield "wrong_calculation", text, gold, matching(base, text), (expression, original, replacement, start, start + len(original)), False


@F.udtf(
    returnType="variant string, text string, gold_answer string, "
    "alignment array<struct<operation:string,base_start:int,base_end:int,variant_start:int,variant_end:int>>, "
    "mutation struct<expression:string,original:string,replacement:string,start:int,end:int>, reasoning_kept boolean"
)
class ReferenceVariants:
    """The rows of ``variants``; none for a null answer or one without exactly one delimiter."""

    def eval(self, answer: str):
        if answer is not None and answer.count(DELIMITER) == 1:
            yield from variants(answer)


@F.udtf(returnType="index int, start int, end int, token_start int, token_end int, is_answer boolean")
class ReasoningSteps:
    """The rows of ``reasoning_steps``; none for a null text and for one without an explicit answer step."""

    def eval(self, text: str, offsets: list, least: int):
        if text is not None:
            try:
                yield from reasoning_steps(text, [(o["start"], o["end"]) for o in offsets or []], least)
            except ValueError:
                return


def reference_variants(rows: DataFrame, answer: str) -> DataFrame:
    """``rows`` with a row for each variant of the worked answer: label changed, left out or announced in a note, one result made wrong.

    ``alignment`` tells which parts of the reference each variant keeps; ``mutation`` what was changed and where.  An answer
    without exactly one delimiter, or null, has no rows; a null or an empty body is an empty one.
    """
    return rows.lateralJoin(ReferenceVariants(F.col(answer).outer()))


def step_rows(rows: DataFrame, text: str, offsets: str, least: int = 8) -> DataFrame:
    """``rows`` with a row for each step of ``text``; ``offsets`` are its tokens as structs of start and end, in order."""
    return rows.lateralJoin(ReasoningSteps(F.col(text).outer(), F.col(offsets).outer(), F.lit(least)))
