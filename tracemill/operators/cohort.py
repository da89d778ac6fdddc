"""Cohorts: roles over components, choices, references, calibration pairs, and audits of grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.operators.ordering import exact_holdout

# What the integrity screen of references looks for.
BOX_OPENS = r"\\(?:boxed|fbox)\s*\{"
BOX_CLOSED = r"\\(?:boxed|fbox)\s*\{[^{}]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}[^{}]*)*\}"
ASKS_ALL = r"(?i)find\s+all|all\s+(?:possible\s+)?(?:values|solutions|roots)|(?:separated|separate).*(?:comma|semicolon)|(?:enter|find).*angles"
PERCENT = r"(?i)percent|percentage"
RADIX = r"(?i)base\s*[- ]?\s*(?:\d+|two|three|four|five|six|seven|eight|nine|ten|twelve|sixteen)|binary|octal|hexadecimal"
TEXT_COMMAND = r"\\(?:text|mbox|mathrm)\{"
NUMBER_WORD = r"(?i)^(?:one|two|three|four|five|six|seven|eight|nine|ten)$"


def analysis_rows(corpus: DataFrame, labels: list[str], splits: list[str]) -> DataFrame:
    """Correct rows of the wanted length labels and splits, in the order of the corpus."""
    ok = F.coalesce(F.col("is_correct"), F.lit(False)) & F.col("analysis_length_label").isin(labels) & F.col("question_split").isin(splits)
    return corpus.where(ok).orderBy("corpus_index")


def nested(df: DataFrame, path: str) -> Column:
    """A nested field by its dotted path; a part that is not there is an error at once."""
    kind = df.schema
    for part in path.split("."):
        if part not in getattr(kind, "names", []):
            raise KeyError(f"no field {part} in {path}")
        kind = kind[part].dataType
    return F.col(path)


def reference_flags(question: Column, answer: Column, solution: Column, kind: Column) -> Column:
    """Integrity flags of a reference: its boxes, several answers, percentages, bases, answers in words.

    A box counts as resolved if it is closed before the next one opens and nests no more than two levels of braces.
    """
    text = F.coalesce(solution, F.lit(""))
    boxes = F.regexp_count(text, F.lit(BOX_OPENS))
    rules = {
        "multiple_reference_boxes": boxes > 1,
        "no_reference_box": boxes == 0,
        "unresolved_nested_or_unbalanced_box": F.regexp_count(text, F.lit(BOX_CLOSED)) < boxes,
        "multiple_answer_request": question.rlike(ASKS_ALL),
        "percentage_context": question.rlike(PERCENT) | F.contains(answer, F.lit("\\%")),
        "radix_context_without_typed_metadata": question.rlike(RADIX) & ~F.coalesce(kind == "radix", F.lit(False)),
        "textual_reference_answer": answer.rlike(TEXT_COMMAND) | answer.rlike(NUMBER_WORD),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def component_digest(seed: int, role: str, members: str = "members") -> Column:
    """The hash of [seed, role, sorted members] in compact JSON."""
    ids = F.array_join(F.transform(F.array_sort(members), lambda m: F.to_json(F.array(m.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(m.cast("string")))) - 2)), ",")
    return F.sha2(F.concat(F.lit(f'[{seed},"{role}",['), ids, F.lit("]]")), 256)


def take_components(components: DataFrame, target: int, seed: int, role: str) -> DataFrame:
    """Whole components (component, members) whose sizes sum to ``target``, in hash order, the first way found.

    The driver gets sizes in hash order, a few times ``target`` of them at first and more only if those have no way.
    """
    if target < 0:
        raise ValueError("a target is not negative")
    every = components.select("component", F.size("members").alias("n"), component_digest(seed, role).alias("d"))
    total, asked = components.count(), 4 * target + 1000
    while True:
        rows = every.orderBy("d", "component").limit(asked).collect()
        try:
            chosen = exact_holdout([r["n"] for r in rows], target)
            break
        except ValueError:
            if asked >= total:
                raise
            asked *= 8
    spark, kind = components.sparkSession, dict(components.dtypes)["component"]
    return spark.createDataFrame([(rows[k]["component"],) for k in chosen], f"component {kind}")


def assign_roles(rows: DataFrame, reserved: DataFrame, holdouts: dict[str, int], seed: int, reserved_role: str = "dap_development_reserved", pool: str = "student_pool") -> DataFrame:
    """(problem_id, role) of (problem_id, component): components with a reserved member, then exact holdouts, then the pool."""
    groups = rows.groupBy("component").agg(F.collect_set("problem_id").alias("members"))
    kept = rows.join(reserved.select("problem_id").distinct(), "problem_id", "left_semi").select("component").distinct()
    roles = [kept.withColumn("role", F.lit(reserved_role))]
    free = groups.join(kept, "component", "left_anti")
    for role, target in holdouts.items():
        chosen = take_components(free, target, seed, role)
        roles.append(chosen.withColumn("role", F.lit(role)))
        free = free.join(chosen, "component", "left_anti")
    named = reduce(lambda a, b: a.unionByName(b), roles)
    return rows.select("problem_id", "component").distinct().join(named, "component", "left").select("problem_id", F.coalesce("role", F.lit(pool)).alias("role"))


def seeded_choice(traces: DataFrame, seed: int) -> DataFrame:
    """One correct trace of each problem, that of the least hash of seed, problem and trace."""
    d = F.sha2(F.concat_ws("|", F.lit(seed), F.col("problem_id"), F.col("trace_id")), 256)
    w = Window.partitionBy("problem_id").orderBy(d, F.col("trace_id").cast("string"))
    return traces.where("is_correct").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def anchored(rows: DataFrame, anchors: DataFrame, key, text: str = "question", answer: str = "answer", ident: str = "problem_id") -> DataFrame:
    """(ident, anchors, status): how a row's answer stands to those of the same normalised question elsewhere.

    no_anchor, anchor_agrees (all anchors have the row's answer), anchor_conflict, or missing_answer.
    """
    known = anchors.select(key(F.col(text)).alias("__k"), F.col(answer).alias("__a")).groupBy("__k").agg(F.count("*").alias("n"), F.min("__a").alias("low"), F.max("__a").alias("high"), F.count_if(F.col("__a").isNull()).alias("void"))
    own = rows.select(ident, key(F.col(text)).alias("__k"), F.col(answer).alias("__a"))
    same = (F.col("low") == F.col("__a")) & (F.col("high") == F.col("__a")) & (F.col("void") == 0)
    status = F.when(F.col("n").isNull(), "no_anchor").when(F.col("__a").isNull(), "missing_answer").when(same, "anchor_agrees").otherwise("anchor_conflict")
    return own.join(known, "__k", "left").select(ident, F.coalesce("n", F.lit(0)).cast("long").alias("anchors"), status.alias("status"))


def self_agreement(rows: DataFrame, key, text: str = "question", answer: str = "answer") -> DataFrame:
    """(key, n, answers, agrees) of normalised questions that occur several times."""
    by = rows.groupBy(key(F.col(text)).alias("key")).agg(F.count("*").alias("n"), F.count_distinct(F.col(answer)).alias("answers"), F.count(answer).alias("__some"))
    return by.where("n > 1").select("key", "n", "answers", ((F.col("answers") == 1) & (F.col("__some") == F.col("n"))).alias("agrees"))


def calibration_bindings(pairs: DataFrame, attempts: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, attempt_id, matches): each pair with the one eligible attempt of its problem and text whose answer and token count are equal.

    Where none or several fit, ``attempt_id`` is null and ``matches`` says how many.
    """
    on = ["problem_id", "text", "answer", "token_count"]
    fits = pairs.join(attempts.where("eligible").select("attempt_id", *on), on, "left")
    n = fits.groupBy(pair).agg(F.count("attempt_id").alias("matches"), F.min("attempt_id").alias("__only"))
    return n.select(pair, F.when(F.col("matches") == 1, F.col("__only")).alias("attempt_id"), "matches")


def cells_off_grid(rows: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """(rule, axes...): cells of the product of the axes that are missing, others that are there, and repeated ones.

    ``axes`` are one-column tables of distinct values; their product is as large as a full grid.
    """
    names = list(axes)
    grid = axes[names[0]]
    for n in names[1:]:
        grid = grid.crossJoin(axes[n])
    seen = rows.groupBy(*names).agg(F.count("*").alias("n"))
    tag = lambda df, rule: df.select(F.lit(rule).alias("rule"), *names)
    return tag(grid.join(seen, names, "left_anti"), "missing").unionByName(tag(seen.join(grid, names, "left_anti"), "unexpected")).unionByName(tag(seen.where("n > 1"), "duplicate"))


def probe_violations(rows: DataFrame, axes: dict[str, DataFrame], sources: DataFrame, ident: str, text: str, pattern: str) -> DataFrame:
    """(rule, ident) of a probe grid: cells off the grid, texts that are not their source's, answers without the pattern."""
    off = cells_off_grid(rows, axes).select("rule", F.col(ident))
    own = rows.join(sources.select(ident, F.col(text).alias("__source")), ident, "left")
    wrong = own.where(~F.col(text).eqNullSafe(F.col("__source"))).select(F.lit("source").alias("rule"), ident)
    unread = rows.where(~F.coalesce(F.col("response").rlike(pattern), F.lit(False))).select(F.lit("unreadable").alias("rule"), ident)
    return off.unionByName(wrong).unionByName(unread)


def cohort_sizes(questions: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """(by, expected, found) of the datasets that do not have as many distinct questions as expected."""
    spark = questions.sparkSession
    want = spark.createDataFrame(list(expected.items()), f"{by} string, expected long")
    have = questions.groupBy(by).agg(F.countDistinct("problem_id").alias("found"))
    both = want.join(have, by, "full_outer").select(by, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))
    return both.where("expected != found")
