"""Selection within groups: bands, labels, roles, policies, ranks, operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.functions.text import stripped, text_key
from tracemill.operators.ordering import digest

ORDER = ("solution_token_count", "candidate_index")


def _order(*more):
    return [*ORDER, F.col("trace_id").cast("string"), *more]


def unique_correct(traces: DataFrame) -> DataFrame:
    """Correct traces with a text, the first by (candidate_index, trace_id) of each collapsed text of a problem."""
    keyed = traces.where("is_correct").withColumn("__k", text_key(F.col("solution"))).where("__k != ''")
    w = Window.partitionBy("problem_id", "__k").orderBy("candidate_index", F.col("trace_id").cast("string"))
    return keyed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__k", "__r")


def unique_correct_uncapped(traces: DataFrame) -> DataFrame:
    """The other reading: capped traces go, texts are only stripped; ordered by (tokens, candidate_index)."""
    keyed = traces.where("is_correct and not hit_max_new_tokens").withColumn("__k", stripped(F.col("solution"))).where("__k != ''")
    w = Window.partitionBy("problem_id", "__k").orderBy("candidate_index")
    kept = keyed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__k", "__r")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("problem_id").orderBy(*_order())) - 1)


def quantile_bands(traces: DataFrame, minimum: int = 4, tail: float = 0.2) -> DataFrame:
    """One short, medium and long trace for every problem with ``minimum`` unique correct traces.

    Short and long are the members of the outer bands nearest to the band's median length (ties:
    the longer of short ones, the shorter of long ones), medium the one nearest to the median of all.
    """
    own = Window.partitionBy("problem_id")
    ranked = unique_correct(traces).withColumns(
        {"n": F.count("*").over(own), "r": F.row_number().over(own.orderBy(*_order())), "middle": F.percentile("solution_token_count", F.lit(0.5)).over(own)}
    ).where(F.col("n") >= minimum)
    band = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(tail)))
    part = F.when(F.col("r") <= band, "short").when(F.col("r") > F.col("n") - band, "long")
    banded = ranked.withColumns({"band": band, "part": part})
    banded = banded.withColumn("goal", F.percentile("solution_token_count", F.lit(0.5)).over(Window.partitionBy("problem_id", "part")))
    roles = F.array(
        F.struct(F.lit("medium").alias("length_rank"), F.abs(F.col("solution_token_count") - F.col("middle")).alias("gap"), F.lit(0).alias("turn")),
        F.struct(
            F.col("part").alias("length_rank"),
            F.abs(F.col("solution_token_count") - F.col("goal")).alias("gap"),
            F.when(F.col("part") == "short", -F.col("solution_token_count")).otherwise(F.col("solution_token_count")).cast("int").alias("turn"),
        ),
    )
    each = banded.withColumn("role", F.explode(roles)).where("role.length_rank is not null")
    w = Window.partitionBy("problem_id", "role.length_rank").orderBy("role.gap", "role.turn", *_order())
    best = each.withColumn("k", F.row_number().over(w)).where("k = 1")
    return best.select(
        "problem_id", "trace_id", "solution_token_count", F.col("role.length_rank").alias("length_rank"), (F.col("r") - 1).cast("long").alias("rank"),
        F.col("n").alias("eligible"), ((F.col("r") == 1) | (F.col("r") == F.col("n"))).alias("absolute_extreme"),
    )


def dropped_problems(traces: DataFrame, selected: DataFrame) -> DataFrame:
    return traces.select("problem_id").distinct().join(selected.select("problem_id").distinct(), "problem_id", "left_anti")


def length_labels(traces: DataFrame, minimum: int = 4) -> DataFrame:
    """short, medium, long, other_correct or incorrect for all traces of problems with ``minimum`` correct ones.

    Medium is the one nearest to the median rank outside both tails.
    """
    own = Window.partitionBy("problem_id", "is_correct")
    ranked = traces.withColumns({"n": F.count("*").over(own), "r": F.row_number().over(own.orderBy(*_order())) - 1})
    enough = F.max(F.when(F.col("is_correct"), F.col("n")).otherwise(0)).over(Window.partitionBy("problem_id"))
    ranked = ranked.withColumn("correct", enough).where(F.col("correct") >= minimum)
    tail = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.2)))
    part = (
        F.when(~F.col("is_correct"), "incorrect").when(F.col("r") < tail, "short").when(F.col("r") >= F.col("n") - tail, "long").otherwise("other_correct")
    )
    parted = ranked.withColumn("part", part)
    near = F.row_number().over(Window.partitionBy("problem_id", "part").orderBy(F.abs(F.col("r") - (F.col("n") - 1) / 2), *_order()))
    label = F.when((F.col("part") == "other_correct") & (F.col("k") == 1), "medium").otherwise(F.col("part"))
    return parted.withColumn("k", near).select("problem_id", "trace_id", label.alias("label"))


def four_roles(traces: DataFrame, seed: int, minimum: int = 4) -> DataFrame:
    """quantile_short, quantile_long, median and deterministic_random of each problem, all distinct."""
    own, ident = Window.partitionBy("problem_id"), F.col("trace_id").cast("string")
    ranked = traces.withColumns(
        {
            "n": F.count("*").over(own),
            "r": F.row_number().over(own.orderBy("solution_token_count", ident)) - 1,
            "middle": F.percentile("solution_token_count", F.lit(0.5)).over(own),
            "d": digest(seed, ident, "pipe"),
        }
    ).where(F.col("n") >= minimum)
    tail = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.2)))
    role = F.when(F.col("r") == F.floor(tail / 2), "quantile_short").when(F.col("r") == F.col("n") - tail + F.floor((tail - 1) / 2), "quantile_long")
    first = ranked.withColumn("role", role)
    free = Window.partitionBy("problem_id", F.col("role").isNull())
    mid = F.row_number().over(free.orderBy(F.abs(F.col("solution_token_count") - F.col("middle")), ident))
    second = first.withColumn("k", mid).withColumn("role", F.when(F.col("role").isNull() & (F.col("k") == 1), "median").otherwise(F.col("role")))
    last = second.withColumn("k", F.row_number().over(free.orderBy("d", ident)))
    done = last.withColumn("role", F.when(F.col("role").isNull() & (F.col("k") == 1), "deterministic_random").otherwise(F.col("role")))
    return done.where("role is not null").select("problem_id", "trace_id", "role")


def policies(scored: DataFrame, least: dict[str, str], most: dict[str, str]) -> DataFrame:
    """Per problem and policy the trace of least (tie: smaller id) or largest score (tie: larger id)."""
    parts = [F.struct(F.lit(p).alias("policy"), (-F.col(c)).cast("double").alias("s"), F.lit(-1).alias("sign")) for p, c in least.items()]
    parts += [F.struct(F.lit(p).alias("policy"), F.col(c).cast("double").alias("s"), F.lit(1).alias("sign")) for p, c in most.items()]
    each = scored.select("problem_id", "trace_id", F.explode(F.array(*parts)).alias("x"))
    best = each.groupBy("problem_id", "x.policy", "x.sign").agg(F.max(F.struct("x.s", (F.col("trace_id") * F.col("x.sign")).alias("t"))).alias("b"))
    return best.select("problem_id", "policy", (F.col("b.t") * F.col("sign")).alias("trace_id"), (F.col("b.s") * F.col("sign")).alias("score"))


def shortest_correct(traces: DataFrame, *group: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*_order())
    return traces.where("is_correct").withColumn("k", F.row_number().over(w)).where("k = 1").select(*group, "trace_id", "solution_token_count")


def coverage(chosen: DataFrame, everything: DataFrame, group: str) -> DataFrame:
    """How many groups have how many chosen rows, groups without any included."""
    n = everything.select(group).distinct().join(chosen.groupBy(group).agg(F.count("*").alias("n")), group, "left")
    return n.groupBy(F.coalesce("n", F.lit(0)).alias("chosen")).agg(F.count("*").alias("groups"))


def rank_with_ties(df: DataFrame, group: str, value: str, descending: bool = False, clip: float | None = None) -> DataFrame:
    """Average ranks of ties, clipped from above."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    first = F.rank().over(Window.partitionBy(group).orderBy(order))
    rank = first + (F.count("*").over(Window.partitionBy(group, value)) - 1) / 2
    return df.withColumn("rank", F.least(rank, F.lit(clip)) if clip is not None else rank)


def top_contexts(events: DataFrame, group: list[str], value: str, n: int, *ties: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(value), *ties)
    return events.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def context_slice(tokens: Column, position: Column, around: int) -> Column:
    """``around`` tokens on either side of a 0-based position."""
    start = F.greatest(position - around, F.lit(0))
    return F.slice(tokens, (start + 1).cast("int"), (position + around + 1 - start).cast("int"))


def top_shares(events: DataFrame, group: list[str], token: str, mass: str, n: int) -> DataFrame:
    """The n tokens of largest mass of each group and their shares."""
    sums = events.groupBy(*group, token).agg(F.sum(mass).alias("mass"))
    total = F.sum("mass").over(Window.partitionBy(*group))
    w = Window.partitionBy(*group).orderBy(F.desc("mass"), token)
    return sums.withColumns({"k": F.row_number().over(w), "share": F.col("mass") / F.greatest(total, F.lit(1e-12))}).where(F.col("k") <= n)


def occurrences(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    return df.withColumn("occurrence_index", (F.row_number().over(Window.partitionBy(group).orderBy(ordinal)) - 1).cast("long"))


def first_distinct_and_repeats(unique: DataFrame, sizes: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Nested sets of the first k distinct traces of a problem, and the first one repeated k times."""
    r = F.row_number().over(Window.partitionBy("problem_id").orderBy(*_order()))
    ranked = unique.withColumn("r", r)
    k = ranked.withColumn("k", F.explode(F.array(*map(F.lit, sizes))))
    distinct = k.where("r <= k").select("problem_id", "trace_id", "k", F.lit("distinct").alias("kind"), F.col("r").cast("long").alias("copy"))
    repeat = k.where("r = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k"))))
    return distinct.unionByName(repeat.select("problem_id", "trace_id", "k", F.lit("repeat").alias("kind"), F.col("copy").cast("long").alias("copy")))


def operating_point(points: DataFrame, family: str, admissible: Column, *order) -> DataFrame:
    """The first admissible point of each family; families without one have none."""
    w = Window.partitionBy(family).orderBy(*order)
    return points.where(admissible).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def strength_with_fallback(points: DataFrame, family: str, eligible: Column, *order) -> DataFrame:
    """The first eligible point of each family, or the first of all if none is."""
    w = Window.partitionBy(family).orderBy(F.desc("eligible"), *order)
    return points.withColumn("eligible", eligible).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def common_cap(cells: DataFrame, cap: str, cell: str, ok: Column, expected: int) -> DataFrame:
    """The least cap that all expected cells pass (no row if there is none)."""
    passed = cells.groupBy(cap).agg(F.countDistinct(F.when(ok, F.col(cell))).alias("n"), F.bool_and(ok).alias("all_ok"))
    return passed.where((F.col("n") == expected) & F.col("all_ok")).agg(F.min(cap).alias(cap))


def largest_passing(steps: DataFrame, step: str, ok: Column) -> DataFrame:
    return steps.where(ok).agg(F.max(step).alias(step))


def discovery(features: DataFrame, per_direction: int, passes: Column, score: str) -> DataFrame:
    """Up to so many features a direction: passing ones first, then others, each by score, then id."""
    w = Window.partitionBy("direction").orderBy(F.desc("passes"), F.desc(score), "feature_id")
    return features.withColumn("passes", passes).withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_direction)


def paired_only(df: DataFrame, group: str, label: str, both: tuple[str, str]) -> DataFrame:
    """Rows of groups that have both labels."""
    has = [F.max((F.col(label) == b).cast("int")).over(Window.partitionBy(group)) for b in both]
    return df.withColumn("__h", has[0] * has[1]).where("__h = 1").drop("__h")


def pool_shortfalls(unique: DataFrame, problems: DataFrame, required: int) -> DataFrame:
    """Problems with fewer than ``required`` unique traces, and the first candidate index that is missing."""
    have = unique.groupBy("problem_id").agg(F.count("*").alias("n"))
    joined = problems.select("problem_id").distinct().join(have, "problem_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.where(F.col("n") < required).select("problem_id", "n", (F.lit(required) - F.col("n")).alias("missing"))
