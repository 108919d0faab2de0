"""The mix of sources against a queue told in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import product

import pytest

from pkgscope.llm import mixing

SCHEMA = "doc_id long, text string, source string, row string, place int, size int, target double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3.0) for i, t, s in rows], SCHEMA)


def by_hand(rows):
    """(doc_id, source, size, source_size, target, taken) of each row."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, free, left = {}, set(order), sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * total[s]}
        for s in over or free:
            goal[s] = 3.0 * total[s] if over else weight[s] * level
        left -= sum(3 * total[s] for s in over)
        free = free - over if over else set()
    queue = defaultdict(list)
    for k, (i, t, s) in enumerate(rows):
        queue[s].append((hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), k))
    items = []
    for s, docs in queue.items():
        upto = 0
        for at, (_, k) in product(range(3), sorted(docs)):
            upto += size[k]
            if size[k]:
                items.append((upto / goal[s], order.index(s), upto, k))
    taken, left = Counter(), sum(size)
    for _, _, _, k in sorted(items):
        taken[k] += min(size[k], left)
        left -= min(size[k], left)
    return [(i, s, size[k], total[s], goal[s], taken[k]) for k, (i, _, s) in enumerate(rows)]


CASES = {
    "mixed": [(i, f"w{i} " * (1 + i * 7 % 23), f"s{i % 4}") for i in range(120)] + [(i, "alone", "é") for i in range(3)] + [(None, "no id here", None), (5, None, None), (6, "", "s1")],
    "one source": [(i, "a b " * i, "only") for i in range(9)],
    "hot": [(i, f"word{i} " * 3, "hot" if i % 3 else f"t{i}") for i in range(300)],
    "one row repeated": [(1, "x y z", "a")] * 400 + [(2, "p q", "b"), (3, "r", "c")],
    "very long beside short": [(1, "long " * 50000, "a")] + [(i, "s t u v", "b") for i in range(2, 800)],
    "no words": [(1, " ", "a"), (2, None, "b"), (3, "\n\t", None)],
}


@pytest.mark.parametrize("name", CASES)
def test_mix_against_a_queue_by_hand(spark, name):
    rows = CASES[name]
    got = [tuple(r) for r in mixing.taken(table(spark, rows).repartition(5)).collect()]
    want = by_hand(rows)
    short = lambda x: [r[:4] + (round(r[4], 6), r[5]) for r in x]
    assert Counter(short(got)) == Counter(short(want))
    assert sum(r[5] for r in got) == sum(r[2] for r in rows_of(want)) and all(r[5] <= 3 * r[2] for r in got)


def rows_of(want):
    return [r for r in want if r[2]]


def test_empty_table(spark):
    assert mixing.taken(table(spark, []).limit(0)).count() == 0


def test_reruns_agree_whatever_the_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.taken(docs.repartition(n)).collect())) for n in (2, 7))
    assert one == two


def test_mix_is_a_stream_in_order(spark):
    rows, _ = mixing.shuffled(table(spark, CASES["mixed"]))
    items = sorted(mixing.mix(rows).collect(), key=lambda r: r["start"])
    assert [r["finish"] for r in items] == sorted(r["finish"] for r in items)
    at = 0
    for r in items:
        assert r["start"] == at
        at += r["taken"]
    assert at == sum(n[2] for n in by_hand(CASES["mixed"]))
