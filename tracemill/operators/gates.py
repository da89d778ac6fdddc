"""Tables of inference and the gates over them: rank metrics, residuals, features, cells, confirmations, engagement."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.operators.stats import crossed_bootstrap, draw_summary, hash_bootstrap, holm, mcnemar_p, sign_agreement, sign_test, spearman


def rank_metrics(rows: DataFrame, group: str, outcome: str, metrics: dict[str, str]) -> DataFrame:
    """(metric, group, rho): each metric's rank correlation with the outcome in each group."""
    parts = [spearman(rows, group, outcome, field).select(F.lit(name).alias("metric"), group, "rho") for name, field in metrics.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def rank_summary(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("metric").agg(F.avg("rho").alias("mean_rho"), F.count("*").alias("questions"))


def rank_contrasts(correlations: DataFrame, group: str, primary: str, baselines: list[str], samples: int, seed: int) -> DataFrame:
    """(left, right, estimate, low, high, p, p_holm, passed): paired differences of the primary metric, resampled by question.

    Resamples come from digests, so any engine gets the same; the interval is that of order statistics.
    """
    own = correlations.where(F.col("metric") == primary).select(group, F.col("rho").alias("__p"))
    pairs = correlations.where(F.col("metric").isin(baselines)).join(own, group).select(F.col("metric").alias("right"), group, (F.col("__p") - F.col("rho")).alias("effect"))
    draws = hash_bootstrap(pairs, ["right"], group, "effect", samples, seed)
    ends = draw_summary(draws, ["right"], samples)
    out = holm(pairs.groupBy("right").agg(F.avg("effect").alias("estimate"), F.count("*").alias("questions")).join(ends, "right"), "p")
    return out.select(F.lit(primary).alias("left"), "right", "estimate", "questions", "low", "high", "p", "p_holm", ((F.col("low") > 0) & (F.col("p_holm") < 0.05)).alias("passed"))


def residualised(rows: DataFrame, values: list[str], nuisance: list[str], discovery: str) -> DataFrame:
    """``rows`` with the values less their least-squares fit on the nuisance columns, which is made on discovery rows alone.

    Only sums of products, as many as columns, come to the driver.
    """
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in nuisance)]
    k = len(x)
    sums = rows.where(discovery).agg(
        *(F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)), *(F.sum(a * F.col(v)).alias(f"y{i}_{j}") for i, a in enumerate(x) for j, v in enumerate(values))
    ).first()
    if sums["x0_0"] is None:
        raise ValueError("no discovery rows")
    gram = np.array([[sums[f"x{i}_{j}"] for j in range(k)] for i in range(k)], float)
    beta = np.linalg.pinv(gram) @ np.array([[sums[f"y{i}_{j}"] for j in range(len(values))] for i in range(k)], float)
    fit = lambda j: sum((F.lit(float(beta[i, j])) * a for i, a in enumerate(x)), F.lit(0.0))
    return rows.withColumns({v: F.col(v) - fit(j) for j, v in enumerate(values)})


def feature_gate(
    dev: DataFrame, test: DataFrame, shares: DataFrame, per_direction: int, q: float = 0.05, effect: float = 0.2, early_p: float = 0.05, prevalence: float = 0.01,
    holm_p: float = 0.05, confirmed: float = 0.1, share: float = 0.5,
) -> DataFrame:
    """(feature_id, direction, score, p_holm, share, reasons, passed) of the features that discovery proposes.

    ``dev`` and ``test`` have feature_id, clean_d, adjusted_d, early_d, clean_p, adjusted_p, early_p, and ``dev``
    clean_q, adjusted_q, prevalence as well; ``shares`` has the largest share of one token in a feature's mass.
    """
    d = dev.withColumn("score", F.least(F.abs("clean_d"), F.abs("adjusted_d"))).withColumn("direction", F.when(F.col("clean_d") > 0, "short").otherwise("long"))
    ok = (F.greatest("clean_q", "adjusted_q") <= q) & (F.col("score") >= effect) & (F.col("clean_d") * F.col("adjusted_d") > 0) & (F.col("clean_d") * F.col("early_d") > 0)
    ok &= (F.col("early_p") <= early_p) & (F.col("prevalence") >= prevalence) & (F.col("clean_d") != 0)
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("score"), "feature_id"))
    proposed = d.where(ok).withColumn("k", rank).where(F.col("k") <= per_direction).select("feature_id", "direction", "score")
    t = test.select("feature_id", *(F.col(c).alias(f"t_{c}") for c in ("clean_d", "adjusted_d", "early_d", "early_p")), F.greatest("clean_p", "adjusted_p").alias("t_p"))
    rows = holm(proposed.join(t, "feature_id").join(shares.select("feature_id", "share"), "feature_id", "left"), "t_p")
    sign = F.when(F.col("direction") == "short", 1).otherwise(-1)
    rules = {
        "confirmation_holm": F.col("p_holm") > holm_p,
        "confirmation_direction_or_effect": F.least(sign * F.col("t_clean_d"), sign * F.col("t_adjusted_d")) < confirmed,
        "early_replication": (sign * F.col("t_early_d") <= 0) | (F.col("t_early_p") > early_p),
        "single_token_concentration": F.coalesce("share", F.lit(0.0)) > share,
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return rows.withColumn("reasons", reasons).select("feature_id", "direction", "score", "p_holm", "share", "reasons", (F.size("reasons") == 0).alias("passed"))


def cell_contrasts(effects: DataFrame, family: list[str], contrast: str, seed_column: str, problem: str, effect: str, samples: int, seed: int) -> DataFrame:
    """(family, contrast, estimate, low, high, p, problems, seeds, p_holm): crossed bootstraps, adjusted within a family."""
    return holm(crossed_bootstrap(effects, [*family, contrast], seed_column, problem, effect, samples, seed), "p", *family)


def cell_arms(rows: DataFrame, family: list[str], arm: str, seed_column: str, value: str) -> DataFrame:
    """(family, arm, seeds, mean, sd): an arm's mean over seeds of its means."""
    per = rows.groupBy(*family, arm, seed_column).agg(F.avg(value).alias("m"))
    return per.groupBy(*family, arm).agg(F.count("*").alias("seeds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def confirmation_tests(pairs: DataFrame, metric: str, binary: list[str], samples: int = 10_000, seed: int = 0) -> DataFrame:
    """(metric, n, mean_difference, p, p_holm) of rows (metric, left_value, right_value): exact McNemar for the binary metrics, else signs at random; one family.

    A metric's sign test is one task over its differences; McNemar needs two counts.
    """
    both = pairs.where("left_value is not null and right_value is not null").withColumn("x", F.col("left_value").cast("double") - F.col("right_value").cast("double"))
    counts = both.groupBy(metric).agg(F.count("*").alias("n"), F.avg("x").alias("mean_difference"), F.count_if(F.col("x") > 0).alias("wins"), F.count_if(F.col("x") < 0).alias("losses"))
    exact = counts.where(F.col(metric).isin(binary)).select(metric, mcnemar_p("wins", "losses").alias("p"))

    def run(pdf):
        return pdf.iloc[:1][[metric]].assign(p=sign_test(pdf["x"].tolist(), samples, seed))

    drawn = both.where(~F.col(metric).isin(binary)).groupBy(metric).applyInPandas(run, f"{metric} {dict(pairs.dtypes)[metric]}, p double")
    return holm(counts.drop("wins", "losses").join(exact.unionByName(drawn), metric), "p").select(metric, "n", "mean_difference", "p", "p_holm")


def step_calibration(rows: DataFrame, reduction: str, step: str, key: str, actual: str, predicted: str, epsilon: float = 1e-12) -> DataFrame:
    """(reduction, step, sign_agreement, median_error, adjacent_rho): the last is the rank correlation with the step before, null where there is none."""
    base = sign_agreement(rows, [reduction, step], actual, predicted, epsilon)
    order = rows.select(reduction, step).distinct().withColumn("before", F.lag(step).over(Window.partitionBy(reduction).orderBy(step)))
    now = rows.select(reduction, step, key, F.col(actual).alias("__a")).join(order, [reduction, step])
    then = rows.select(reduction, F.col(step).alias("before"), key, F.col(actual).alias("__b"))
    both = now.join(then, [reduction, "before", key]).withColumn("__g", F.struct(reduction, step))
    rho = spearman(both, "__g", "__a", "__b").select(F.col(f"__g.{reduction}").alias(reduction), F.col(f"__g.{step}").alias(step), F.col("rho").alias("adjacent_rho"))
    return base.join(rho, [reduction, step], "left")


def engagement_gate(rows: DataFrame, reported: DataFrame, by: str, value: str, limit: float, tolerance: float = 1e-9) -> DataFrame:
    """(by, mean, reproduced, fold, passed): means recomputed, compared with the reported ones, and within ``limit`` times the least."""
    own = rows.groupBy(by).agg(F.avg(value).alias("mean"))
    both = own.join(reported.select(by, F.col("mean").alias("__said")), by, "full_outer")
    close = F.abs(F.col("mean") - F.col("__said")) <= tolerance * F.greatest(F.abs("mean"), F.abs("__said"))
    least = own.agg(F.min("mean").alias("__least"))  # one row
    out = both.crossJoin(F.broadcast(least)).withColumns({"reproduced": F.coalesce(close, F.lit(False)), "fold": F.when(F.col("__least") > 0, F.col("mean") / F.col("__least"))})
    return out.select(by, "mean", "reproduced", "fold", (F.col("reproduced") & F.coalesce(F.col("fold") <= limit, F.lit(False))).alias("passed"))
