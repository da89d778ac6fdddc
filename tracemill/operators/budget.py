"""Token budgets: schedules, greedy passes, step choice, weights, cap views, run matrices."""

from __future__ import annotations

import hashlib
import random
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shuffled(rows: list[dict], seed: int, salt: str) -> list[dict]:
    """Rows by digest of seed, salt, problem and trace, then shuffled by a generator seeded from seed and salt."""
    key = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = sorted(rows, key=lambda r: key(f"{seed}:{salt}:{r['problem_id']}:{r['trace_id']}"))
    random.Random(int(key(f"{seed}:{salt}")[:16], 16)).shuffle(out)
    return out


def greedy_subset(rows: list[dict], target: int, tokens: str) -> list[dict]:
    """Rows in order that still fit; one that does not fit is passed over, later ones may fit."""
    left, out = target, []
    for r in rows:
        if r[tokens] <= left:
            out.append(r)
            left -= r[tokens]
    return out


def repeated_schedule(rows: list[dict], target: int, tokens: str, seed: int, salt: str) -> list[dict]:
    """Greedy passes over ever new orders until a pass adds nothing."""
    out, left, turn = [], target, 0
    while got := greedy_subset(shuffled(rows, seed, f"{salt}:pass{turn}"), left, tokens):
        out += [{**r, "pass_index": turn} for r in got]
        left -= sum(r[tokens] for r in got)
        turn += 1
        if any(r[tokens] <= 0 for r in got):
            break
    return out


def schedules(selected: DataFrame, seed: int, tokens: str = "solution_token_count") -> DataFrame:
    """(regime, length_rank, position, problem_id, trace_id, tokens) of three fair schedules.

    equal_rows takes every row once; token_subset fits the smallest arm's total; token_repeat fills
    up to the largest arm's total.  Arms are few; each is one task, of (problem, trace, tokens) rows.
    """
    totals = {r["length_rank"]: r["t"] for r in selected.groupBy("length_rank").agg(F.sum(tokens).alias("t")).collect()}
    least, most = (min(totals.values()), max(totals.values())) if totals else (0, 0)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, arm = pdf[["problem_id", "trace_id", tokens]].to_dict("records"), key[0]
        parts = {
            "equal_rows": shuffled(rows, seed, f"equal_rows:{arm}"),
            "token_subset": greedy_subset(shuffled(rows, seed, f"token_subset:{arm}"), least, tokens),
            "token_repeat": repeated_schedule(rows, most, tokens, seed, f"token_repeat:{arm}"),
        }
        out = [(name, arm, i, r["problem_id"], r["trace_id"], r[tokens]) for name, part in parts.items() for i, r in enumerate(part)]
        return pd.DataFrame(out, columns=["regime", "length_rank", "position", "problem_id", "trace_id", "tokens"])

    schema = "regime string, length_rank string, position long, problem_id string, trace_id long, tokens long"
    return selected.groupBy("length_rank").applyInPandas(run, schema)


def fitting_fold(rows: Column, target: Column, tokens: str) -> Column:
    """The greedy subset of an ordered array as a fold: for groups that fit a row."""
    start = F.struct(target.cast("long").alias("left"), F.array().cast("array<long>").alias("kept"), F.lit(0).cast("long").alias("i"))

    def take(acc, r):
        fits = r[tokens].cast("long") <= acc.left
        return F.struct(
            F.when(fits, acc.left - r[tokens].cast("long")).otherwise(acc.left).alias("left"),
            F.when(fits, F.concat(acc.kept, F.array(acc.i))).otherwise(acc.kept).alias("kept"),
            (acc.i + 1).alias("i"),
        )

    return F.aggregate(rows, start, take, lambda acc: acc.kept)


def best_steps(tokens: list[int], scores: list[float], target: int, gap: float) -> list[int] | None:
    """Indices of the steps of largest score whose tokens lie within ``gap`` of the target, null if there are none.

    Of equal scores the one with more tokens counts, and of those the smaller list.
    """
    low, high = target * (1 - gap), target * (1 + gap)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, (n, s) in enumerate(zip(tokens, scores, strict=True)):
        for total, (score, chosen) in list(best.items()):
            new = (score + s, [*chosen, i])
            at = total + n
            if at <= high and (at not in best or (-new[0], new[1]) < (-best[at][0], best[at][1])):
                best[at] = new
    ok = [(-score, -total, chosen) for total, (score, chosen) in best.items() if low <= total <= high]
    return min(ok)[2] if ok else None


def step_choice(steps: DataFrame, gap: float) -> DataFrame:
    """Per trace the chosen step indices; ``steps`` has trace_id, index, tokens, score and the trace's target.

    Rows with a true ``is_answer``, where there is one, are not chosen from; a target that no choice meets is an error.
    """
    if "is_answer" in steps.columns:
        steps = steps.where(~F.coalesce("is_answer", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        got = best_steps(pdf["tokens"].tolist(), pdf["score"].tolist(), int(pdf["target"].iloc[0]), gap)
        if got is None:
            raise ValueError("no whole steps meet the target")
        return pd.DataFrame({"trace_id": [pdf["trace_id"].iloc[0]], "chosen": [pdf["index"].iloc[got].tolist()]})

    return steps.groupBy("trace_id").applyInPandas(run, f"trace_id {dict(steps.dtypes)['trace_id']}, chosen array<long>")


def supervision(n: Column, spans: Column) -> Column:
    """0/1 weights of n tokens: 1 inside one of the spans struct(start, end)."""
    inside = lambda i: F.exists(spans, lambda s: (s.start <= i) & (i < s.end))
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: inside(i).cast("double")))


def step_weights(n: Column, steps: Column, total: float) -> Column:
    """Weights of n tokens: ``total`` shared equally by the steps struct(start, end, is_answer) and in each by its tokens; answers weigh 1."""
    share = F.lit(float(total)) / F.size(F.filter(steps, lambda s: ~s.is_answer))
    weight = lambda i: F.aggregate(steps, F.lit(0.0), lambda a, s: F.when((s.start <= i) & (i < s.end), F.when(s.is_answer, 1.0).otherwise(share / (s.end - s.start))).otherwise(a))
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), weight))


def relative_gap(actual: Column, target: Column) -> Column:
    return F.abs(actual - target) / F.greatest(target, F.lit(1))


def run_matrix(spark: SparkSession, factors: dict[str, list]) -> DataFrame:
    """One row for every combination of the factors."""
    return spark.createDataFrame([tuple(str(v) for v in row) for row in product(*factors.values())], ", ".join(f"{k} string" for k in factors))


def cap_view(ids: Column, cap: int, eos: int) -> Column:
    """struct(ids, tokens, hit): ids up to the cap and before the end mark; hit if the cap comes before the mark."""
    cut = F.slice(ids, 1, cap)
    ended = F.array_position(cut, eos) > 0
    body = F.when(ended, F.slice(cut, F.lit(1), (F.array_position(cut, eos) - 1).cast("int"))).otherwise(cut)
    return F.struct(body.alias("ids"), F.size(body).alias("tokens"), ((F.size(cut) >= cap) & ~ended).alias("hit"))


def saved_prefix(attempts: DataFrame, pool: str, index: str, ok: str, pairs: int) -> DataFrame:
    """First successful attempt of each pool row, in pool order up to ``pairs`` successes; ``complete`` is false if an earlier attempt is missing."""
    first = attempts.groupBy(pool).agg(F.min(F.when(F.col(ok), F.col(index))).alias("first"))
    seen = attempts.join(first, pool).where(F.col(index) <= F.col("first")).groupBy(pool, "first").agg(F.countDistinct(index).alias("n"))
    run = F.row_number().over(Window.orderBy(pool))
    return seen.withColumn("success", run).where(F.col("success") <= pairs).select(pool, "first", (F.col("n") == F.col("first") + 1).alias("complete"))
