import hashlib

from pyspark.sql import functions as F

from tracemill.operators import candidates as cd

PLAN = cd.Plan(("a", "b", "c"), initial=4, round_size=2, most=70, seed=11, end=31, cap=6, norm=0.005)
SCHEMA = (
    "problem_id string, condition string, candidate_index int, question string, gold_answer string, seed long, token_ids array<int>, "
    "output_token_count int, generated_tokens int, hit_max_new_tokens boolean, norm double, rho double, sources int"
)


def stream(problem, index):
    return int.from_bytes(hashlib.sha256(f"{11 + index}:{problem}".encode()).digest()[:4], "little")


def pool(sizes):
    rows = {}
    for p, n in sizes.items():
        for arm in PLAN.arms:
            for i in range(n):
                tokens = [2, 3, 31] if i % 2 else [2, 3, 4, 5, 6, 7]
                rows[p, arm, i] = [p, arm, i, f"q {p}", f"g {p}", stream(p, i), tokens, len(tokens), len(tokens) - i % 2, not i % 2, 0.1, 0.1, 7]
    return rows


def faults(spark, rows, sizes, plan=PLAN, extra_questions=()):
    questions = spark.createDataFrame([(p, f"q {p}", f"g {p}", "x") for p in sizes] + list(extra_questions), "problem_id string, question string, answer string, condition string")
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)
    got = cd.candidate_faults(df, questions, plan).collect()
    bad = {r["problem_id"] for r in cd.suspects(df, questions, plan).collect()}
    assert bad == {r["problem_id"] for r in got}  # a suspect has a fault to name, and each fault makes one
    return sorted((r["rule"], r["problem_id"], r["condition"], r["candidate_index"]) for r in got) if not any(None in tuple(r) for r in got) else {tuple(r) for r in got}


SIZES = {"p": 4, "q": 6, "r": 4, "s": 66}


def test_a_sound_pool_has_no_faults(spark):
    assert faults(spark, pool(SIZES).values(), SIZES) == []


CORRUPTIONS = [  # what is done to the rows of a problem of six candidates an arm, and the faults to be named: (rule, arm, index)
    (lambda d, p: d.pop((p, "b", 2)), [("missing", "b", 2)]),
    (lambda d, p: d.pop((p, "c", 5)), [("missing", "c", 5)]),
    (lambda d, p: d.update({(p, "again", 0): d[p, "a", 1]}), [("duplicate", "a", 1)]),
    (lambda d, p: d[p, "c", 3].__setitem__(5, 1), [("random_stream", "c", 3)]),
    (lambda d, p: d[p, "c", 3].__setitem__(3, "other"), [("identity", "c", 3)]),
    (lambda d, p: d[p, "b", 0].__setitem__(4, None), [("identity", "b", 0)]),
    (lambda d, p: d[p, "a", 0].__setitem__(6, [2, 31, 4, 5, 6, 7]), [("token_boundary", "a", 0)]),
    (lambda d, p: d[p, "a", 1].__setitem__(6, [2, 3, 4]), [("token_accounts", "a", 1), ("unfinished", "a", 1)]),
    (lambda d, p: d[p, "a", 1].__setitem__(6, []), [("token_accounts", "a", 1), ("token_boundary", "a", 1), ("unfinished", "a", 1)]),
    (lambda d, p: d[p, "a", 1].__setitem__(8, 9), [("token_accounts", "a", 1)]),
    (lambda d, p: d[p, "a", 1].__setitem__(9, None), [("token_accounts", "a", 1)]),
    (lambda d, p: d[p, "a", 5].__setitem__(10, 0.2), [("norm_bound", "a", 5)]),
    (lambda d, p: d[p, "a", 5].__setitem__(10, float("nan")), [("norm_bound", "a", 5)]),
    (lambda d, p: d[p, "a", 5].__setitem__(1, "z"), [("missing", "a", 5), ("unexpected", "z", 5)]),
]


def test_each_corruption_is_named_alone(spark):
    """One pool, a problem for each corruption and sound ones beside them."""
    sizes = {f"p{k:02d}": 6 for k in range(len(CORRUPTIONS))} | SIZES
    rows = pool(sizes)
    for k, (change, _) in enumerate(CORRUPTIONS):
        change(rows, f"p{k:02d}")
    want = sorted((rule, f"p{k:02d}", arm, i) for k, (_, named) in enumerate(CORRUPTIONS) for rule, arm, i in named)
    assert faults(spark, rows.values(), sizes) == want


def test_problems_rounds_and_indices(spark):
    rows = pool(SIZES)
    for arm in PLAN.arms:
        rows.pop(("q", arm, 5))
    assert faults(spark, rows.values(), SIZES) == {("incomplete_round", "q", None, 5)}
    rows = pool(SIZES) | {k: v for k, v in pool({"u": 4}).items()}
    assert faults(spark, rows.values(), SIZES) == {("unknown_problem", "u", None, None)}
    assert faults(spark, pool(SIZES).values(), SIZES, extra_questions=[("p", "q p", "g p", "x")]) == {("repeated_question", "p", None, None)}
    assert faults(spark, pool({"p": 4}).values(), {"p": 4, "v": 4}) == [("missing", "v", a, i) for a in "abc" for i in range(4)]
    rows = pool({"p": 4})
    rows["p", "a", 0][2] = 99
    rows["p", "a", 0][5] = stream("p", 99)
    assert faults(spark, rows.values(), {"p": 4}) == [("missing", "p", "a", 0), ("unexpected", "p", "a", 99)]


def test_streams_and_plans_without_tokens(spark):
    got = spark.range(3).select(cd.expected_stream(11, F.col("id").cast("int"), F.lit("p")).alias("s"))
    assert [r["s"] for r in got.collect()] == [stream("p", i) for i in range(3)]
    bare = cd.Plan(("a", "b", "c"), 4, 2, 8, 11)
    assert faults(spark, pool({"p": 4}).values(), {"p": 4}, bare) == [] and len(cd.row_rules(bare)) == 1
    assert faults(spark, pool({"p": 4}).values(), {}, bare) == {("unknown_problem", "p", None, None)}
