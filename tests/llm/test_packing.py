"""The configuration program decides the packing."""

import random

import pytest

from pkgscope.llm import packing


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    histogram: dict[int, int] = {}
    for _ in range(8000):
        w = min(4095, max(1, int(rng.lognormvariate(6.2, 1.0))))
        histogram[w] = histogram.get(w, 0) + 1
    return histogram


def test_the_program_carries_the_packing(skewed, monkeypatch):
    made = []
    solve = packing.solve_configurations
    monkeypatch.setattr(packing, "solve_configurations", lambda *a: made.append(solve(*a)) or made[-1])
    plan = packing.plan_configurations(dict(skewed))
    n = sum(times for _, times in plan)
    assert made and n <= sum(times for _, times in packing._best_fit(dict(skewed), 4096)) + max(1, n // 1000)
    assert any(sum(times * sum(c.values()) for c, times in x) >= 0.85 * sum(skewed.values()) for x in made)
    one_each = [({w: 1}, n) for w, n in skewed.items()]
    monkeypatch.setattr(packing, "solve_configurations", lambda *a: one_each)
    assert packing.plan_configurations(dict(skewed)) != plan


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {5: 0}, {1: 1}, {4096: 1, 7: 2}, {2048: 5}, {2049: 3, 2047: 1}])
def test_small_histograms(histogram):
    plan = packing.plan_configurations(dict(histogram))
    held: dict[int, int] = {}
    for config, times in plan:
        assert times > 0 and sum(w * k for w, k in config.items()) <= 4096
        for w, k in config.items():
            held[w] = held.get(w, 0) + k * times
    assert held == {w: n for w, n in histogram.items() if n}
