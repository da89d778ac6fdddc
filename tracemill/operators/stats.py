"""Inference over grouped data: adjustments, rank correlations, exact tests, bootstraps, regression."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from tracemill.operators.scan import adjusted
from tracemill.operators.select import rank_with_ties
from tracemill.operators.store import stored


def holm(df: DataFrame, p: str, *family: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjustment within a family; null and NaN p-values do not count and get 1.  Written at once, see ``scan``."""
    return adjusted(df, p, family, name, lambda size, rank, x: (size - rank + 1) * x, greatest=True)


def benjamini_hochberg(df: DataFrame, p: str, *family: str, name: str = "q_value") -> DataFrame:
    """Step-up adjustment within a family; null and NaN p-values do not count and get 1.  Written at once, see ``scan``."""
    return adjusted(df, p, family, name, lambda size, rank, x: size * x / rank, greatest=False)


def spearman(df: DataFrame, group: str, x: str, y: str, minimum: int = 3) -> DataFrame:
    """(group, n, rho) of groups of ``minimum`` rows whose ranks vary."""
    ranked = rank_with_ties(rank_with_ties(df, group, x).withColumnRenamed("rank", "__x"), group, y).withColumnRenamed("rank", "__y")
    out = ranked.groupBy(group).agg(F.count("*").alias("n"), F.stddev_pop("__x").alias("sx"), F.stddev_pop("__y").alias("sy"), F.covar_pop("__x", "__y").alias("c"))
    return out.where((F.col("n") >= minimum) & (F.col("sx") > 0) & (F.col("sy") > 0)).select(group, "n", (F.col("c") / (F.col("sx") * F.col("sy"))).alias("rho"))


def safe_correlation(x: str, y: str) -> Column:
    """Pearson's correlation, 0 where one side is constant."""
    c = F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), c).otherwise(0.0)


def seed_interval(df: DataFrame, *by: str, effect: str = "effect") -> DataFrame:
    """Mean over three seeds with a t interval of fixed critical value."""
    critical = 4.3026527299  # Fixed value: 97.5 % of t with two degrees of freedom.
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(effect).alias("mean"), F.stddev_samp(effect).alias("sd"))
    half = critical * F.col("sd") / F.sqrt("n")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front / _tail(a, b, x)


def _tail(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated from its tail."""
    value = 1.0
    for i in range(300 + int(4 * math.sqrt(a + b)), 0, -1):
        m = i // 2
        top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + top / value
    return value


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def mcnemar(wins: int, losses: int) -> float:
    """Exact two-sided probability of a split at least so uneven: twice a binomial tail, by the incomplete beta function."""
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * incomplete_beta(n - k, k + 1, 0.5)) if n else 1.0


@F.pandas_udf(DoubleType())
def mcnemar_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    return pd.Series([mcnemar(int(w), int(x)) for w, x in zip(wins, losses, strict=True)], dtype=float)


def mcnemar_table(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, wins, losses, p) of boolean left_value and right_value."""
    table = pairs.groupBy(*by).agg(
        F.count_if(F.col("left_value") & ~F.col("right_value")).alias("wins"), F.count_if(~F.col("left_value") & F.col("right_value")).alias("losses")
    )
    return table.withColumn("p", mcnemar_p("wins", "losses"))


def sign_test(differences: list[float], samples: int, seed: int) -> float:
    """Two-sided sign randomisation of the mean: exact up to 16 nonzero differences, else by draws with one added."""
    nonzero = [d for d in differences if d]
    if any(math.isnan(d) for d in differences):
        raise ValueError("a difference is not a number")
    if not nonzero:
        return 1.0
    observed = abs(sum(nonzero)) - 1e-12
    if len(nonzero) <= 16:
        sums = np.zeros(1)
        for d in nonzero:
            sums = np.concatenate((sums + d, sums - d))
        return float((np.abs(sums) >= observed).mean())
    draw = random.Random(seed)
    hits = sum(abs(sum(d if draw.getrandbits(1) else -d for d in nonzero)) >= observed for _ in range(samples))
    return (hits + 1) / (samples + 1)


def _picked(seed: int, side: str, draw: Column, place: Column, n: Column) -> Column:
    """What a draw takes at a place: a digest modulo the number of choices, so that any engine takes the same."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(side), draw.cast("string"), place.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def _resampled(effects: DataFrame, group: list[str], column: str, side: str, samples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The numbered values of a column in each group, and how often each draw takes each: (group, place, n), (group, draw, place, times)."""
    w = Window.partitionBy(*group)
    numbered = effects.select(*group, column).distinct().withColumns({f"__{side}": F.row_number().over(w.orderBy(column)) - 1, f"__n{side}": F.count("*").over(w)})
    places = numbered.select(*group, F.col(f"__{side}").alias("__at"), F.col(f"__n{side}").alias("__n"))
    dealt = places.repartition(int(effects.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "__at")  # else one task draws for a whole group
    asked = dealt.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    taken = asked.withColumn(f"__{side}", _picked(seed, side, F.col("draw"), F.col("__at"), F.col("__n")).cast("int"))
    return numbered, taken.groupBy(*group, "draw", f"__{side}").agg(F.count("*").alias(f"__x{side}"))


def crossed_draws(effects: DataFrame, group: list[str], seed_column: str, problem: str, effect: str, samples: int, seed: int) -> DataFrame:
    """(group, draw, mean, problems, seeds): means of resamples that draw seeds and problems apart and cross them.

    A draw's mean is the sum of its cells, each times how often its seed and its problem were drawn.  The problems'
    multiples are summed up to (group, draw, seed) before anything meets the seeds', so a contrast is spread over its
    problems and draws.  All seeds of a group must have the same problems, one row a cell.

    All joins merge: Spark takes rows by draw for as few as those they were exploded from, and cells for as small as
    they are packed, and would send either through the driver to all tasks.
    """
    problems, of_problem = _resampled(effects, group, problem, "p", samples, seed)
    seeds, of_seed = _resampled(effects, group, seed_column, "s", samples, seed)
    cells = effects.select(*group, seed_column, problem, F.col(effect).cast("double").alias("__v")).join(problems.hint("merge"), [*group, problem])
    each = cells.groupBy(*group, seed_column).agg(F.count("*").alias("n"), F.count_distinct(problem).alias("d"), F.max("__np").alias("problems"))
    odd = F.col(seed_column).isNull() | (F.col("n") != F.col("problems")) | (F.col("d") != F.col("problems"))
    whole = each.groupBy(*group).agg(F.max(odd).alias("odd"), F.max("problems").alias("problems"), F.count("*").alias("seeds"))
    checked = whole.select(*group, F.when(F.col("odd"), F.raise_error(F.lit("seeds differ in their problems"))).otherwise(F.col("problems")).cast("long").alias("problems"), "seeds")
    rows = cells.join(of_problem.hint("merge"), [*group, "__p"]).groupBy(*group, "draw", seed_column).agg(F.sum(F.col("__v") * F.col("__xp")).alias("__v"))
    named = of_seed.join(seeds.hint("merge"), [*group, "__s"]).select(*group, "draw", seed_column, "__xs")
    sums = rows.join(named.hint("merge"), [*group, "draw", seed_column]).groupBy(*group, "draw").agg(F.sum(F.col("__v") * F.col("__xs")).alias("__v"))
    return sums.hint("merge").join(checked, group).select(*group, "draw", (F.col("__v") / (F.col("problems") * F.col("seeds"))).alias("mean"), "problems", "seeds")


def draw_summary(draws: DataFrame, group: list[str], samples: int, interpolated: bool = False) -> DataFrame:
    """(group, low, high, p): the 95 % interval of the means, by order statistics or interpolated, and twice the smaller share on either side of zero."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("mean")) - 1
    low, high = max(0, int(0.025 * samples) - 1), min(samples - 1, int(0.975 * samples))
    end = lambda k, q: F.percentile("mean", F.lit(q)) if interpolated else F.max(F.when(F.col("__k") == k, F.col("mean")))
    share = lambda ok: F.avg(ok.cast("int"))
    return draws.withColumn("__k", place).groupBy(*group).agg(
        end(low, 0.025).alias("low"), end(high, 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("mean") <= 0), share(F.col("mean") >= 0))).alias("p")
    )


def crossed_bootstrap(effects: DataFrame, group: list[str], seed_column: str, problem: str, effect: str, samples: int, seed: int, interpolated: bool = False) -> DataFrame:
    """(group, estimate, low, high, p, problems, seeds): ``crossed_draws`` in summary.  Effects and the draws' means are written at once, as they are read several times."""
    effects = stored(effects.select(*group, seed_column, problem, effect))
    draws = stored(crossed_draws(effects, group, seed_column, problem, effect, samples, seed))
    sizes = draws.groupBy(*group).agg(F.first("problems").alias("problems"), F.first("seeds").alias("seeds"))
    means = effects.groupBy(*group).agg(F.avg(effect).alias("estimate"))
    return means.join(draw_summary(draws, group, samples, interpolated), group).join(sizes, group).select(*group, "estimate", "low", "high", "p", "problems", "seeds")


def hash_bootstrap(effects: DataFrame, group: list[str], problem: str, effect: str, samples: int, seed: int) -> DataFrame:
    """Means of resamples whose draws come from digests, so that any engine gets the same: (group, draw, mean)."""
    w = Window.partitionBy(*group)
    numbered = effects.withColumns({"__i": F.row_number().over(w.orderBy(problem)) - 1, "__n": F.count("*").over(w)})
    asked = numbered.select(*group, "__i", "__n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    first = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "draw", "__i"), 256), 1, 15), 16, 10).cast("long")
    picked = asked.withColumn("__i", (first % F.col("__n")).cast("int")).drop("__n")
    return picked.join(numbered.drop("__n"), [*group, "__i"]).groupBy(*group, "draw").agg(F.avg(effect).alias("mean"))


def paired_features(values: DataFrame) -> DataFrame:
    """Per feature: mean over questions of (mean short - mean long), sd, d, t, p and interval.

    ``values`` has feature_id, problem_id, label (short or long) and value; questions need both.
    Without spread p is 0 for a nonzero mean, d and t are 0.
    """
    mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("value")))
    per = values.groupBy("feature_id", "problem_id").agg((mean("short") - mean("long")).alias("x")).where("x is not null")
    out = per.groupBy("feature_id").agg(F.count("*").alias("questions"), F.avg("x").alias("effect"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))
    d = F.when(F.col("sd") > 0, F.col("effect") / F.col("sd")).otherwise(0.0)
    with_t = out.withColumn("d", d).withColumn("t", F.col("d") * F.sqrt("questions"))

    @F.pandas_udf("p double, half double")
    def tail(t: pd.Series, n: pd.Series, sd: pd.Series, effect: pd.Series) -> pd.DataFrame:
        rows = []
        for a, k, s, e in zip(t, n, sd, effect, strict=True):
            p = t_two_sided(a, k - 1) if k > 1 and s > 0 else float(e == 0)
            rows.append((p, t_quantile(0.975, k - 1) * s / math.sqrt(k) if k > 1 else math.nan))
        return pd.DataFrame(rows, columns=["p", "half"])

    x = with_t.withColumn("__x", tail("t", "questions", "sd", "effect"))
    return x.select("feature_id", "questions", "effect", "sd", "d", "t", F.col("__x.p").alias("p"), (F.col("effect") - F.col("__x.half")).alias("low"), (F.col("effect") + F.col("__x.half")).alias("high"))


FIT = "beta array<double>, inverse array<double>, rank int"
ERRORS = "clustered array<double>, naive array<double>"


def fixed_effect_table(df: DataFrame, families: list[str], group: str, outcome: str, predictors: list[str]) -> DataFrame:
    """Within-group least squares for every family: a row for each family and predictor.

    (families, predictor, beta, se_clustered, se_naive, observations, questions, clusters, rank): coefficients of least norm,
    errors clustered by group (CR1) and plain ones.  Groups of one row do not enter the fit but count as questions; rows
    with a null in a column that is used are left out; a family without degrees of freedom or with fewer than two clusters
    has null errors.  One aggregate gives the centred products of each (family, group), combined before its shuffle, and
    all else follows from those: no rows are read again, and a group or family of any size is no single task's.
    """
    cols, k = [outcome, *predictors], len(predictors)
    at = {(i, j): f"__c{min(i, j)}_{max(i, j)}" for i in range(k + 1) for j in range(k + 1)}
    products = [(F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")) * F.count("*")).alias(at[i, j]) for i in range(k + 1) for j in range(i, k + 1)]
    whole = df.dropna(subset=cols)
    groups = whole.groupBy(*families, group).agg(F.count("*").alias("__n"), *products)
    inside = F.col("__n") > 1
    total = lambda c: F.sum(F.when(inside, F.col(c))).alias(c)
    sums = groups.groupBy(*families).agg(F.sum(F.when(inside, F.col("__n"))).alias("observations"), F.count_if(inside).alias("clusters"), F.count("*").alias("questions"), *(total(c) for c in dict.fromkeys(at.values())))

    @F.pandas_udf(FIT)
    def solved(gram: pd.Series, moments: pd.Series) -> pd.DataFrame:
        made = []
        for g, m in zip(gram, moments, strict=True):
            x = np.array(g, float).reshape(k, k)
            inverse = np.linalg.pinv(x, rcond=1e-10, hermitian=True)
            made.append(((inverse @ np.array(m, float)).tolist(), inverse.reshape(-1).tolist(), int(np.linalg.matrix_rank(x, tol=1e-10 * max(np.abs(x).max(), 1e-300), hermitian=True))))
        return pd.DataFrame(made, columns=["beta", "inverse", "rank"])

    @F.pandas_udf(ERRORS)
    def errors(inverse: pd.Series, meat: pd.Series, rest: pd.Series, n: pd.Series, clusters: pd.Series, rank: pd.Series) -> pd.DataFrame:
        made = []
        for i, m, r, o, c, q in zip(inverse, meat, rest, n, clusters, rank, strict=True):
            if o <= q or c < 2:
                made.append((None, None))
                continue
            bread, scores = np.array(i, float).reshape(k, k), np.array(m, float).reshape(k, k)
            scale = c / (c - 1) * (o - 1) / max(1, o - q)
            made.append(tuple(np.sqrt(np.maximum(0, np.diag(x))).tolist() for x in (bread @ scores @ bread * scale, bread * max(r, 0.0) / (o - q))))
        return pd.DataFrame(made, columns=["clustered", "naive"])

    gram = F.array(*(F.coalesce(at[i, j], F.lit(0.0)) for i in range(1, k + 1) for j in range(1, k + 1)))
    fitted = sums.withColumn("__fit", solved(gram, F.array(*(F.coalesce(at[i, 0], F.lit(0.0)) for i in range(1, k + 1)))))
    beta = [F.col("__fit.beta")[i] for i in range(k)]
    named = fitted.select(*(F.col(f).alias(f"__k{i}") for i, f in enumerate(families)), "__fit")
    joined = groups.where(inside).join(named, [F.col(f).eqNullSafe(F.col(f"__k{i}")) for i, f in enumerate(families)])
    # a group's score for predictor i: its products with the outcome less those with what is fitted
    score = [F.col(at[i, 0]) - sum((b * F.col(at[i, j + 1]) for j, b in enumerate(beta)), F.lit(0.0)) for i in range(1, k + 1)]
    rest = F.col(at[0, 0]) - sum((b * (F.col(at[j + 1, 0]) + score[j]) for j, b in enumerate(beta)), F.lit(0.0))
    scored = joined.select(*families, *(s.alias(f"__u{i}") for i, s in enumerate(score)), rest.alias("__r"))
    meat = scored.groupBy(*families).agg(F.array(*(F.sum(F.col(f"__u{i}") * F.col(f"__u{j}")) for i in range(k) for j in range(k))).alias("__meat"), F.sum("__r").alias("__rest"))
    meat = meat.select(*(F.col(f).alias(f"__m{i}") for i, f in enumerate(families)), "__meat", "__rest")
    both = fitted.join(meat, [F.col(f).eqNullSafe(F.col(f"__m{i}")) for i, f in enumerate(families)], "left")
    done = both.withColumn("__e", errors("__fit.inverse", F.coalesce("__meat", F.array(*[F.lit(0.0)] * (k * k))), F.coalesce("__rest", F.lit(0.0)), F.coalesce("observations", F.lit(0)), "clusters", "__fit.rank"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("predictor"), F.col("__fit.beta")[i].alias("beta"), F.col("__e.clustered")[i].alias("se_clustered"), F.col("__e.naive")[i].alias("se_naive")) for i, p in enumerate(predictors)))).alias("__x")
    rows = done.select(*families, each, F.coalesce("observations", F.lit(0)).alias("observations"), "questions", "clusters", F.col("__fit.rank").alias("rank"))
    return rows.select(*families, "__x.*", "observations", "questions", "clusters", "rank")


def fixed_effects(df: DataFrame, group: str, outcome: str, predictors: list[str]) -> dict:
    """The one family of all rows of ``fixed_effect_table``, as a report: a row for each predictor comes to the driver."""
    rows = fixed_effect_table(df.withColumn("__all", F.lit(1)), ["__all"], group, outcome, predictors).collect()
    first = rows[0]
    return {"beta": {r["predictor"]: r["beta"] for r in rows}, "se": {r["predictor"]: r["se_clustered"] for r in rows}, "rows": first["observations"], "clusters": first["clusters"], "questions": first["questions"]}


def contrasts(cells: DataFrame, coefficients: dict[str, float], cell: str, on: list[str], value: str) -> DataFrame:
    """Weighted sums over cells by key; keys that lack a cell have none."""
    c = F.create_map(*(x for k, v in coefficients.items() for x in (F.lit(k), F.lit(float(v)))))
    used = cells.where(F.col(cell).isin(*coefficients)).groupBy(*on).agg(F.sum(F.col(value) * c[F.col(cell)]).alias("effect"), F.countDistinct(cell).alias("__n"))
    return used.where(F.col("__n") == len(coefficients)).drop("__n")


def gate(cells: DataFrame, required: list[str], cell: str, estimate: str, low: str, least: float) -> DataFrame:
    """(present, passed): all required cells once, estimate and lower bound both above the least."""
    own = cells.where(F.col(cell).isin(*required))
    ok = (F.col(estimate) > least) & (F.col(low) > least)
    return own.agg((F.countDistinct(cell) == len(required)).alias("present"), ((F.count("*") == len(required)) & F.coalesce(F.bool_and(ok), F.lit(False))).alias("passed"))


def sign_agreement(df: DataFrame, group: list[str], actual: str, predicted: str, epsilon: float = 1e-12) -> DataFrame:
    same = (F.col(actual) >= 0) == (F.col(predicted) >= 0)
    error = F.abs(F.col(actual) - F.col(predicted)) / F.greatest(F.abs(F.col(actual)), F.lit(epsilon))
    return df.groupBy(*group).agg(F.avg(same.cast("int")).alias("sign_agreement"), F.percentile(error, F.lit(0.5)).alias("median_error"))


def sparse_change(before: DataFrame, after: DataFrame, key: str, feature: str, value: str, targets: list) -> DataFrame:
    """Active counts, entered, left, Jaccard and absolute change in and outside the targets."""
    a, b = (x.select(key, feature, F.col(value).alias(n)) for x, n in ((before, "a"), (after, "b")))
    both = a.join(b, [key, feature], "full_outer").withColumns({"a": F.coalesce("a", F.lit(0.0)), "b": F.coalesce("b", F.lit(0.0))})
    on, off, move = F.col("a") > 0, F.col("b") > 0, F.abs(F.col("a") - F.col("b"))
    target = F.col(feature).isin(*targets)
    return both.groupBy(key).agg(
        F.count_if(on).alias("before"), F.count_if(off).alias("after"), F.count_if(~on & off).alias("entered"), F.count_if(on & ~off).alias("left"),
        F.coalesce(F.count_if(on & off) / F.nullif(F.count_if(on | off), F.lit(0)), F.lit(1.0)).alias("jaccard"),
        F.sum(F.when(target, move).otherwise(0.0)).alias("target_change"), F.sum(F.when(target, 0.0).otherwise(move)).alias("other_change"),
    )
