"""The whole audit of a pool of candidates: keys, identity, random streams, token accounts and rounds.

One aggregate by problem, combined before its shuffle, tells which problems have any fault: for each arm the candidates'
number and the bits of their indices, for the rest how many rows break a rule of their own.  Only the rows of those
problems are looked at again to name each fault, so a clean pool costs one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Indices that one mask holds.
BITS = 62


@dataclass(frozen=True)
class Plan:
    """What a complete pool is.

    Each problem has every arm, all with the same indices 0, 1, ...: ``initial`` of them at least, whole rounds of
    ``round_size``, ``most`` at most.  ``seed`` starts the random streams; ``end`` and ``cap`` are the end mark and the
    longest output, null if token accounts are not kept; ``norm`` is the tolerance of the norm bound, null without one.
    """

    arms: tuple[str, ...]
    initial: int
    round_size: int
    most: int
    seed: int
    end: int | None = None
    cap: int | None = None
    norm: float | None = None


def expected_stream(seed: int, index: Column, problem: Column) -> Column:
    """The seed of a candidate: the first four bytes, little-endian, of the digest of ``seed + index:problem``."""
    digest = F.sha2(F.concat_ws(":", (F.lit(seed) + index).cast("string"), problem.cast("string")), 256)
    return F.conv(F.concat(*(F.substring(digest, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")


def row_rules(plan: Plan) -> dict[str, Column]:
    """Conditions of a candidate's row by the name of the rule; null breaks a rule."""
    rules = {"random_stream": F.col("seed") == expected_stream(plan.seed, F.col("candidate_index"), F.col("problem_id"))}
    if plan.end is not None:
        tokens, n = F.col("token_ids"), F.size("token_ids")
        ended = F.coalesce(F.try_element_at(tokens, F.lit(-1)) == plan.end, F.lit(False))
        rules |= {
            "token_boundary": (n > 0) & (n <= plan.cap) & ~F.array_contains(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), plan.end),
            "unfinished": ended | (n == plan.cap),
            "token_accounts": (F.col("output_token_count") == n) & (F.col("generated_tokens") == n - ended.cast("int")) & (F.col("hit_max_new_tokens") != ended),
        }
    if plan.norm is not None:
        norm = F.col("norm")
        rules["norm_bound"] = ~F.isnan(norm) & (norm >= 0) & (norm <= F.col("rho") + plan.norm)
    return rules


def _known(plan: Plan) -> Column:
    inside = F.col("condition").isin(*plan.arms) & F.col("candidate_index").between(0, plan.most - 1)
    return F.coalesce(inside, F.lit(False))


def suspects(rows: DataFrame, questions: DataFrame, plan: Plan) -> DataFrame:
    """(problem_id) of the problems with any fault, of which there may be several; one aggregate."""
    identity = F.xxhash64("question", "gold_answer")
    broken = reduce(lambda a, b: a | b, (~F.coalesce(ok, F.lit(False)) for ok in row_rules(plan).values()))
    own = rows.select(
        "problem_id", "condition", "candidate_index", identity.alias("same"), F.lit(0).alias("source"), (broken | ~_known(plan)).cast("int").alias("broken")
    )
    asked = questions.select("problem_id", F.lit(None).cast("string").alias("condition"), F.lit(None).cast("int").alias("candidate_index"), F.xxhash64("question", "answer").alias("same"), F.lit(1).alias("source"), F.lit(0).alias("broken"))
    words = range(-(-plan.most // BITS))
    place = F.col("candidate_index")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(BITS)).cast("int"))
    of = lambda a: F.col("condition") == a
    masks = [F.coalesce(F.bit_or(F.when(of(a) & (F.floor(place / BITS) == w), bit)), F.lit(0)).alias(f"m{i}_{w}") for i, a in enumerate(plan.arms) for w in words]
    counts = [F.count_if(of(a)).alias(f"n{i}") for i, a in enumerate(plan.arms)]
    found = own.unionByName(asked.select(*(F.col(c).cast(t) for c, t in own.dtypes))).groupBy("problem_id").agg(
        F.sum("source").alias("sources"), F.sum("broken").alias("broken"), F.min("same").alias("low"), F.max("same").alias("high"), *masks, *counts
    )
    held = lambda i: reduce(lambda a, b: a + b, (F.bit_count(f"m{i}_{w}") for w in words))
    full = reduce(lambda a, b: a & b, (F.col(f"m{i}_{w}") == F.col(f"m0_{w}") for i in range(len(plan.arms)) for w in words))
    once = reduce(lambda a, b: a & b, (held(i) == F.col(f"n{i}") for i in range(len(plan.arms))))
    # indices 0, 1, ...: full masks, then one of ones from the right, then empty ones
    ones = [F.least(F.greatest(F.col("n0") - w * BITS, F.lit(0)), F.lit(BITS)).cast("int") for w in words]
    dense = reduce(lambda a, b: a & b, (F.col(f"m0_{w}") == F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1 for w, k in zip(words, ones, strict=True)))
    rounds = (F.col("n0") >= plan.initial) & (F.col("n0") % plan.round_size == 0)
    good = (F.col("sources") == 1) & (F.col("broken") == 0) & (F.col("low") == F.col("high")) & full & once & dense & rounds
    return found.where(~F.coalesce(good, F.lit(False))).select("problem_id")


def candidate_faults(rows: DataFrame, questions: DataFrame, plan: Plan) -> DataFrame:
    """(rule, problem_id, condition, candidate_index) of every fault; no rows: the pool is complete and sound.

    ``rows`` have problem_id, condition, candidate_index, question, gold_answer, seed and, as the plan asks, token_ids,
    output_token_count, generated_tokens, hit_max_new_tokens, norm, rho; ``questions`` problem_id, question, answer.
    Rules: unknown_problem, repeated_question (no arm), unexpected (arm or index), duplicate (key), missing (an index
    that another arm or a greater index of the same arm shows to be due, or one of the first ``initial``), incomplete_round
    (no arm: its number of indices), identity and those of ``row_rules``.
    """
    bad = suspects(rows, questions, plan)
    mine = rows.join(bad, "problem_id", "left_semi")
    asked = questions.join(bad, "problem_id", "left_semi")
    key = ["problem_id", "condition", "candidate_index"]
    none = [F.lit(None).cast("string").alias("condition"), F.lit(None).cast("int").alias("candidate_index")]
    tag = lambda df, rule, *columns: df.select(F.lit(rule).alias("rule"), *(columns or ("problem_id", F.col("condition").cast("string").alias("condition"), F.col("candidate_index").cast("int").alias("candidate_index"))))
    rules = row_rules(plan)
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()), F.when(~_known(plan), F.lit("unexpected"))))
    each = mine.select(F.explode(broken).alias("rule"), "problem_id", F.col("condition").cast("string").alias("condition"), F.col("candidate_index").cast("int").alias("candidate_index"))
    twice = tag(mine.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "duplicate")
    unknown = tag(mine.select("problem_id").distinct().join(asked, "problem_id", "left_anti"), "unknown_problem", "problem_id", *none)
    repeated = tag(asked.groupBy("problem_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated_question", "problem_id", *none)
    source = asked.dropDuplicates(["problem_id"]).select("problem_id", F.col("question").alias("__q"), F.col("answer").alias("__a"))
    other = mine.join(source, "problem_id").where(~(F.col("question").eqNullSafe(F.col("__q")) & F.col("gold_answer").eqNullSafe(F.col("__a"))))
    known = mine.where(_known(plan)).select(*key).distinct()
    due = asked.select("problem_id").distinct().join(known.groupBy("problem_id").agg((F.max("candidate_index") + 1).alias("n")), "problem_id", "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(plan.initial)))
    every = due.select("problem_id", F.explode(F.array(*map(F.lit, plan.arms))).alias("condition"), "n").select("problem_id", "condition", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("candidate_index"))
    missing = tag(every.join(known, key, "left_anti"), "missing")
    odd = tag(due.where((F.col("n") % plan.round_size) != 0), "incomplete_round", "problem_id", F.lit(None).cast("string").alias("condition"), F.col("n").cast("int").alias("candidate_index"))
    return reduce(lambda a, b: a.unionByName(b), (each, twice, unknown, repeated, tag(other, "identity"), missing, odd))
