"""Tiers, chances, requests and thresholds on stated cases."""

import pytest
from pyspark.sql import functions as F

from pkgscope.functions import decision
from pkgscope.functions import text as T
from pkgscope.operators import metrics, splits

CAL = {
    "base_rate": 0.265, "sim_flag": 0.6, "classifier_threshold": 0.85,
    "both": {"coef": [1.0, 4.0], "intercept": -2.0}, "classifier_only": {"coef": [1.0], "intercept": -1.0},
}


def assessed(spark, rows, cal):
    table = spark.createDataFrame(rows, "prob double, share double, capable boolean")
    return [r.asDict() for r in table.select(*[c.alias(n) for n, c in decision.assess(F.col("prob"), F.col("share"), F.col("capable"), cal).items()]).collect()]


@pytest.mark.parametrize("cal, cases", [
    (CAL, [(.99, .95, "malicious"), (.99, .10, "suspicious"), (.20, .90, "suspicious"), (.20, .10, "clean"), (.99, None, "malicious"), (.80, .55, "suspicious")]),
    (CAL | {"review_threshold": .3, "strict_threshold": .98}, [(.99, .10, "malicious"), (.90, .10, "suspicious"), (.40, .10, "suspicious"), (.10, .10, "clean")]),
])
def test_tiers(spark, cal, cases):
    assert [r["tier"] for r in assessed(spark, [(p, s, None) for p, s, _ in cases], cal)] == [t for _, _, t in cases]


def test_capability_gate(spark):
    got = assessed(spark, [(.9, .9, False), (.9, None, True), (.99, 0.0, False)], CAL | {"capability_gate": True, "strict_threshold": .98})
    assert [r["tier"] for r in got] == ["suspicious", "malicious", "malicious"]


def test_chance_follows_the_prior(spark):
    r = assessed(spark, [(.9, .7, True)], CAL)[0]
    assert 0 < r["chance_low"] < r["chance_high"] < 100


def test_requests_and_specs(spark):
    said = ["flask", "please check flask==3.0", "pip install Flask 2.1", "is flask safe?", "why", "is it safe?", "how about django?", "and numpy?", "what is a webhook", "thanks!", None, ""]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select(T.requested(F.col("t")), T.route(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["flask", "flask==3.0", "Flask 2.1", "flask", None, None, "django", "numpy", None, None, None, None]
    assert [r[1] for r in rows] == ["analyze" if r[0] else "question" for r in rows]
    specs = spark.createDataFrame([(t,) for t in ("flask", " flask==3.0 ", "flask@v1.2", "flask 2", "not a spec", "-x")], "t string")
    assert [tuple(r) for r in specs.select(*T.parse_spec(F.col("t"))).collect()] == [("flask", None), ("flask", "3.0"), ("flask", "1.2"), ("flask", "2"), (None, None), (None, None)]


def test_f_threshold_compares_with_the_grid_itself(spark):
    import random

    rng, step = random.Random(4), (0.95 - 0.05) / 90
    grid = [0.95 if i == 90 else i * step + 0.05 for i in range(91)]
    rows = [(rng.choice(grid + [0.29, 0.57, 0.58, 0.0, 1.0]), rng.randrange(2)) for _ in range(3000)]
    got = metrics.f_threshold(spark.createDataFrame(rows, "score double, label int")).first()

    def f(t):
        tp, fp = sum(y for s, y in rows if s >= t), sum(1 - y for s, y in rows if s >= t)
        fn = sum(y for _, y in rows) - tp
        return round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 9) if tp else 0.0

    best = max(f(t) for t in grid)
    assert (got["threshold"], got["f"]) == (next(t for t in grid if f(t) == best), best)


def test_running_total_and_future_rows(spark):
    rows = spark.createDataFrame([(i, i % 3, i + 1) for i in range(50)], "k long, g long, size long")
    got = {r["k"]: r["used"] for r in splits.running_total(rows, "g", "k", "size", 7).collect()}
    assert got == {i: sum(j + 1 for j in range(i) if j % 3 == i % 3) for i in range(50)}
    family = spark.createDataFrame([(1, "a", "2024-02"), (1, "b", "2024-02"), (0, "b", "2024-01"), (1, "c", ""), (1, "d", None), (1, "e", "2023")], "label int, g string, day string")
    assert [r["g"] for r in splits.split_future(family, "g", "day", "2024-01").collect()] == ["a"]


def test_entropy_and_signals(spark):
    rows = spark.createDataFrame([("aabb",), ("",), (None,), ("aaaa",), ("1234.5.6.7 8.8.8.8 10.1.1.1",)], "t string")
    got = rows.select(F.round(T.entropy(F.col("t")), 6), F.size(T.public_ips(F.col("t")))).collect()
    assert [r[0] for r in got[:4]] == [1.0, None, None, 0.0] and got[4][1] == 1
