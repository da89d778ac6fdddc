"""Prompt texts, and what can be seen of a response's structure, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The texts around a question, and the mark around a ratio.
STUDENT = ("Problem:\n", "\n\nSolve the problem and end with a line in the form: Answer: <final answer>.")
RATIO_MARK = "<|eot_id|>"
FINAL = ("\n\nThe final answer is: $\\boxed{", "}$")
DIFFICULTY = r"(?im)^\s*(?:\*\*)?Difficulty(?:\*\*)?\s*:\s*(easy|medium|hard)\b"
# Headings of a response's parts.
PARTS = {
    "analysis": r"(?i)\banalysis\s*(?:\*\*)?\s*:",
    "reflection": r"(?i)\breflection\s*(?:\*\*)?\s*:",
    "decomposition": r"(?i)problem decomposition",
    "solution": r"(?i)\bsolution\s*(?:\*\*)?\s*:",
}


def student_prompt(question: Column) -> Column:
    return F.concat(F.lit(STUDENT[0]), question, F.lit(STUDENT[1]))


def choice_question(kind: Column, reviewed_kind: Column | None = None) -> Column:
    """Whether an answer is one letter; the reviewed kind counts where there is one."""
    return F.coalesce(kind if reviewed_kind is None else F.coalesce(reviewed_kind, kind), F.lit("")) == "choice"


def ratio_prompt(question: Column, ratio: float, instruction: str) -> Column:
    """The instruction, the question and, below a ratio of 1, the ratio between its marks."""
    if not 0 < ratio <= 1:
        raise ValueError("a ratio is above 0 and at most 1")
    return F.concat(F.lit(instruction + "\n"), question, F.lit(f"{RATIO_MARK}{ratio:.1f}{RATIO_MARK}" if ratio < 1 else ""))


def ratio_completion(shortened: Column, answer: Column) -> Column:
    return F.concat(F.regexp_replace(shortened, r"^\s+|\s+$", ""), F.lit(FINAL[0]), answer, F.lit(FINAL[1]))


def evaluation_prompt(question: Column, is_choice: Column, choice_instruction: str, template: str, ratio: float | None = None, ratios: tuple = (), instruction: str = "") -> Column:
    """The question, with the choice instruction if letters are asked for, in a template or as a ratio prompt."""
    asked = F.when(is_choice, F.concat(question, F.lit("\n" + choice_instruction))).otherwise(question)
    if ratio is None:
        before, after = template.split("{question}")
        return F.concat(F.lit(before), asked, F.lit(after))
    if ratio not in ratios:
        raise ValueError(f"{ratio} is not a registered ratio")
    return ratio_prompt(asked, ratio, instruction)


def structure(text: Column) -> Column:
    """struct(difficulty, has_analysis, has_reflection, has_decomposition, has_solution); the last difficulty counts."""
    labels = F.regexp_extract_all(text, F.lit(DIFFICULTY), 1)
    flags = [F.coalesce(text.rlike(p), F.lit(False)).alias(f"has_{n}") for n, p in PARTS.items()]
    return F.struct(F.when(F.size(labels) > 0, F.lower(F.element_at(labels, -1))).alias("difficulty"), *flags)
