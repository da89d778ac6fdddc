"""Summaries of predictions, caps, sparse feature events and surface scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def prediction_summary(df: DataFrame, *by: str, correct: str = "is_correct", tokens: str = "output_token_count") -> DataFrame:
    ok = F.col(correct).cast("int")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(ok).cast("long").alias("correct"), F.avg(ok).alias("accuracy"), F.avg(tokens).alias("mean_tokens")
    )


def arm_summary(df: DataFrame, arm: str, seed: str, correct: str = "is_correct", tokens: str = "output_token_count") -> DataFrame:
    """Mean over seeds of the means of each seed, and their sample deviation."""
    one = df.groupBy(arm, seed).agg(F.avg(F.col(correct).cast("int")).alias("a"), F.avg(tokens).alias("t"))
    return one.groupBy(arm).agg(F.count("*").alias("seeds"), F.avg("a").alias("accuracy"), F.stddev_samp("a").alias("accuracy_sd"), F.avg("t").alias("mean_tokens"))


def condition_summary(df: DataFrame, condition: str, correct: str, tokens: str, ratio: Column, infinite: bool = True) -> DataFrame:
    """Correct answers per million tokens, mean tokens of correct rows (infinite or null without any), mean and largest ratio."""
    ok = F.col(correct)
    of_correct = F.avg(F.when(ok, F.col(tokens)))
    return df.groupBy(condition).agg(
        F.count("*").alias("n"),
        (1e6 * F.sum(ok.cast("int")) / F.sum(tokens)).alias("correct_per_million"),
        (F.coalesce(of_correct, F.lit(float("inf"))) if infinite else of_correct).alias("tokens_when_correct"),
        F.avg(ratio).alias("mean_ratio"),
        F.max(ratio).alias("max_ratio"),
    )


def cap_summary(df: DataFrame, ratio: str, cap: str, correct: str, tokens: str, hit: str) -> DataFrame:
    return df.groupBy(ratio, cap).agg(
        F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"), F.avg(F.col(hit).cast("int")).alias("cap_rate"), F.avg(tokens).alias("mean_tokens")
    )


def constant_attached(rows: DataFrame, runs: DataFrame, key: str, value: str) -> DataFrame:
    """rows with a value of runs that must be the same in all runs of the key; ``constant`` tells."""
    one = runs.groupBy(key).agg(F.min(value).alias(value), (F.min(value) == F.max(value)).alias("constant"))
    return rows.join(one, key, "left")


def selected_summary(df: DataFrame, by: str, tokens: str, extreme: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(tokens).alias("mean_tokens"), F.percentile(tokens, F.lit(0.5)).alias("median_tokens"), F.count_if(F.col(extreme)).alias("extremes")
    )


def counters(df: DataFrame, *columns: str) -> DataFrame:
    """(counter, value, n) for several columns; array columns count their members."""
    out = None
    for c in columns:
        values = F.explode(c) if df.schema[c].dataType.typeName() == "array" else F.col(c)
        one = df.select(values.cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(c).alias("counter"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def feature_sums(events: DataFrame, lengths: DataFrame, first: int) -> DataFrame:
    """Per (trace, feature): mass, count and mass of the first positions, each also by the trace's length."""
    sums = events.groupBy("trace_id", "feature_id").agg(
        F.sum("activation").alias("mass"), F.count("*").alias("count"), F.sum(F.when(F.col("position") < first, F.col("activation")).otherwise(0.0)).alias("early_mass")
    )
    n = F.col("length")
    return sums.join(lengths, "trace_id").select(
        "trace_id", "feature_id", "mass", "count", "early_mass", (F.col("mass") / n).alias("mean_activation"), (F.col("count") / n).alias("frequency"),
        (F.col("early_mass") / F.least(n, F.lit(first))).alias("early_mean"),
    )


def masses(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("token_mass"), F.sum("activation").alias("activation_mass"))


def relative_bin(position: Column, length: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(position * bins / length)).cast("long")


def bin_means(events: DataFrame, lengths: DataFrame, bins: int) -> DataFrame:
    """Mean activation of each feature in each relative bin, over all tokens of the bin; empty bins included."""
    placed = events.join(lengths, "trace_id").withColumn("bin", relative_bin(F.col("position"), F.col("length"), bins))
    sums = placed.groupBy("feature_id", "bin").agg(F.sum("activation").alias("mass"))
    spots = lengths.where("length > 0").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    tokens = spots.groupBy(relative_bin(F.col("p"), F.col("length"), bins).alias("bin")).agg(F.count("*").alias("tokens"))
    grid = events.select("feature_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = grid.join(tokens, "bin", "left").join(sums, ["feature_id", "bin"], "left")
    return full.select("feature_id", "bin", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("mass") / F.greatest("tokens", F.lit(1)), F.lit(0.0)).alias("mean"))


def region_shares(events: DataFrame, region: str, regions: list[str]) -> DataFrame:
    """Mass of each region of each feature and its share of the whole."""
    p = events.groupBy("feature_id").pivot(region, regions).agg(F.sum("activation"))
    filled = p.select("feature_id", *(F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(r) for r in regions))
    total = sum((F.col(r) for r in regions), F.lit(0.0))
    return filled.select("*", *((F.col(r) / F.greatest(total, F.lit(1e-12))).alias(f"{r}_share") for r in regions))


def lexical_association(events: DataFrame, tokens: DataFrame, minimum: int) -> DataFrame:
    """Mean activation of a feature given a token, for tokens of ``minimum`` occurrences."""
    n = tokens.groupBy("token_id").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    mass = events.groupBy("feature_id", "token_id").agg(F.sum("activation").alias("mass"))
    return mass.join(n, "token_id").select("feature_id", "token_id", "n", (F.col("mass") / F.col("n")).alias("mean"))


def batch_costs(rows: DataFrame, batch: str, condition: str, seconds: str) -> DataFrame:
    """Seconds of each condition, every batch once."""
    once = rows.groupBy(condition, batch).agg(F.max(seconds).alias("s"), F.count("*").alias("rows"))
    return once.groupBy(condition).agg(F.count("*").alias("batches"), F.sum("s").alias("seconds"), (F.sum("s") / F.sum("rows")).alias("seconds_per_row"))


def _exploded(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.posexplode(vector).alias("d", "x")).withColumn("x", F.col("x").cast("double"))


def normalisation(df: DataFrame, vector: str) -> DataFrame:
    """(mean array, scale): sqrt(d over the mean squared distance from the mean)."""
    per = _exploded(df, vector).groupBy("d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = per.agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("m"), F.sum("v").alias("v"), F.count("*").alias("dim"))
    return whole.select(F.transform("m", lambda s: s.m).alias("mean"), F.sqrt(F.col("dim") / F.greatest("v", F.lit(1e-12))).alias("scale"))


def reconstruction(pairs: DataFrame, actual: str, rebuilt: str) -> DataFrame:
    """Mean squared error, and the variance explained over the centred energy."""
    both = pairs.select(F.posexplode(F.zip_with(actual, rebuilt, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))).alias("d", "p"))
    per = both.groupBy("d").agg(F.sum((F.col("p.a") - F.col("p.b")) ** 2).alias("e"), F.var_pop("p.a").alias("v"), F.count("*").alias("n"))
    return per.agg((F.sum("e") / F.sum("n")).alias("mse"), (1 - F.sum("e") / F.greatest(F.sum(F.col("v") * F.col("n")), F.lit(1e-12))).alias("explained"))


def contribution(traces: DataFrame, sampled: DataFrame, *by: str) -> DataFrame:
    """How much of each trace was sampled: least, largest and mean fraction by label; traces without samples count."""
    n = sampled.groupBy("trace_id").agg(F.count("*").alias("n"))
    f = traces.join(n, "trace_id", "left").withColumn("f", F.coalesce("n", F.lit(0)) / F.col("length"))
    return f.groupBy(*by).agg(F.count("*").alias("traces"), F.min("f").alias("least"), F.max("f").alias("largest"), F.avg("f").alias("mean"))


def rank_surprisal(logprobs: Column, ranks: Column, clip: float) -> Column:
    """Mean clipped rank over the mean negative log probability."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return mean(F.transform(ranks, lambda r: F.least(r.cast("double"), F.lit(clip)))) / F.greatest(-mean(logprobs), F.lit(1e-12))


def blend(answer: Column, question: Column, weight: float) -> Column:
    return weight * answer + (1 - weight) * question


def surface_record(df: DataFrame) -> DataFrame:
    return df.withColumns({"log_length": F.log(F.greatest(F.lit(1), F.col("completion_tokens"))), "student_nll": F.col("student_loss_mean")})


def group_gradient(df: DataFrame, group: str, loss: str, score: str) -> DataFrame:
    """(l / L) (2 rho - sum(rho l) / L) within a group, L the sum of losses; NaN where L vanishes."""
    w = Window.partitionBy(group)
    total, mixed = F.sum(loss).over(w), F.sum(F.col(loss) * F.col(score)).over(w)
    value = F.col(loss) / total * (2 * F.col(score) - mixed / total)
    return df.withColumn("g_hat", F.when(total <= 1e-30, F.lit(float("nan"))).otherwise(value))


def weighted_loss(tokens: DataFrame, sequence: str, loss: str, weight: str) -> DataFrame:
    """Both normalisations: over all tokens, and as the mean over sequences."""
    one = tokens.groupBy(sequence).agg(F.sum(F.col(loss) * F.col(weight)).alias("lw"), F.sum(weight).alias("w")).where("w > 0")
    return one.agg((F.sum("lw") / F.sum("w")).alias("token_mean"), F.avg(F.col("lw") / F.col("w")).alias("sequence_mean"))
