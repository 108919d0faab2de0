"""Hard negatives against all pairs, on random, clustered, tied and odd vectors."""

import math
import random

import numpy as np
import pytest

from pkgscope.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, score string"


def brute(rows, every, k=5):
    good = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], set()
    for i, v, y in good:
        if i % every or (i, tuple(v), y) in asked:
            continue
        asked.add((i, tuple(v), y))
        near = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in good if j != i and len(w) == len(v))
        for s, p, _ in [x for x in near if x[2] == y][:k]:
            fit = [x for x in near if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fit)]
    return sorted(out)


def cases():
    rng = np.random.default_rng(3)
    random_ = [(i, rng.normal(size=8).tolist(), i * 3 % 10) for i in range(400)]
    centres = rng.normal(size=(12, 16)) * 3
    clustered = [(i, (centres[i % 12] + rng.normal(size=16) * 0.2).tolist(), i % 5) for i in range(700)]
    tied = [(i, [1.0, float(i % 3), -0.5, 0.25], i % 4) for i in range(300)] + [(301, [1.0, 0.0, -0.5, 0.25], 1)] * 90
    odd = [(i, [float(i % 5), 2.0 - i % 3], i % 3) for i in range(60)]
    odd += [(60, None, 1), (61, [1.0, None], 1), (62, [float("nan"), 1.0], 2), (63, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 1), (64, [1.0, 1.0], None), (65, [0.0, 0.0], 1)]
    odd += [(20, [4.0, 1.0], 2), (20, [4.0, 1.0], 2), (20, [3.0, 3.0], 1), (70, [1.0, 2.0, 3.0], 0), (80, [3.0, 2.0, 1.0], 0), (81, [3.0, 2.0, 0.9], 1), (90, [], 1), (91, [], 1), (92, [], 2)]
    large = [(i, [1e6 * math.sin(i + d) for d in range(4)], i % 3) for i in range(80)]
    return {"random": (random_, 20), "clustered": (clustered, 50), "tied": (tied, 25), "odd": (odd, 10), "large": (large, 10), "few": ([(0, [1.0], 1), (10, [2.0], 1)], 10)}


@pytest.mark.parametrize("name", ["random", "clustered", "tied", "odd", "large", "few"])
def test_mined_rows_are_those_of_all_pairs(spark, monkeypatch, name):
    rows, every = cases()[name]
    for size, value in (("ROWS_A_CELL", 8), ("SHARD_ROWS", 40), ("SEED_ROWS", 30)):
        monkeypatch.setattr(negatives, size, value)
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(i, v, y, 1, "s") for i, v, y in rows], SCHEMA)
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.mine(table, every).collect())
    assert got == brute(rows, every)


def test_bounds_hold_and_clusters_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_A_CELL", 8)
    rows, _ = cases()["clustered"]
    prepared = negatives.prepare(spark.createDataFrame([(i, v, y, 1, "s") for i, v, y in rows], SCHEMA))
    index, facts = negatives.build(prepared, 16, len(rows))
    held = [(np.frombuffer(r["vec"], "<i8"), r["cell"]) for r in index.collect()]
    few = 0
    for q, _ in held[:40]:
        order = list(negatives.visits(q, facts, -math.inf, math.inf))
        assert sorted(order) == sorted(facts["counts"])
        best = max(int(q @ v) for v, _ in held)
        seen = set(negatives.visits(q, facts, float(best), math.inf))
        assert {c for v, c in held if int(q @ v) == best} <= seen
        few += len(seen)
    assert few < 40 * len(facts["counts"]) / 3


def test_empty_table(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
