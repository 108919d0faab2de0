"""Operator 11: periodic runs of words, as maximal pairs of bounded distance.

A run is a stretch of words with smallest period q and at least max(12, 2 q) words that no neighbour
extends keeping that period. For such a run the places s and s + q of a text are a maximal pair: the
words from both on agree for length - q words and then differ, and the words before them differ. In turn
each maximal pair whose distance is at most the length of its common part spans a stretch that cannot be
extended, and the least distance among the pairs of a stretch is its period. So runs are found as
maximal pairs, without extension: the suffixes of a text are sorted, their common prefixes give a tree of LCP
intervals, and going up it each node pairs the places of different children whose distance is at most
the node's LCP and whose left words differ; places are kept by left word in sorted lists, the smaller
child's places look up the larger's. Nodes with LCP under 6 hold no run of 12 words, so only stretches of the
suffix array with LCP of 6 or more are walked, and a text in which no six words come twice has none.

Rows are independent: whole texts stay where they are and nothing is shuffled. Words are runs of characters other
than the space and \\x09-\\x0D; a null or empty text has none, no run and the hash of no words. Ids pass unchanged,
repeated rows are rows of their own, an empty table gives an empty result; columns besides doc_id and
text are ignored. Ties for the longest run: smallest start, then period. One text is the unit of work, and takes memory in
proportion to its words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12
HALF = LEAST // 2
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def _ranks(codes) -> list:
    """The rank of each place's first 2^k words, for k = 0, 1, ..., until all ranks differ. What is cut by the end comes first, so no two such are equal."""
    import numpy as np

    n, step = len(codes), 1
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    while levels[-1].max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = levels[-1][step:] + 1
        levels.append(np.unique(levels[-1] * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))
        step *= 2
    return levels


def _common(order, levels):
    """The length of the common prefix of each suffix in order with the one before it; 0 for the first."""
    import numpy as np

    n = len(order)
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(i, j) < n)
        same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
        i[same] += 1 << k
        j[same] += 1 << k
    return np.concatenate([[0], i - order[:-1]])


def _repeats_six(codes) -> bool:
    """True if some six words come twice."""
    import numpy as np

    n = len(codes)
    two = np.unique(codes[:-1] * np.int64(n) + codes[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * np.int64(n) + two[2:], return_inverse=True)[1]
    six = four[:-2] * np.int64(n) + two[4:]
    return len(np.unique(six)) < len(six)


class _Places:
    """Places of a node of the tree: all of them, and by left word, both sorted."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: list[int]):
        self.all = [place]
        self.by_left = {left[place]: [place]}

    def pairs(self, small: _Places, lcp: int, left: list[int]):
        """Pairs of a place here and one of small with different left words and a distance of lcp at most."""
        for x in small.all:
            lo, hi = bisect_left(self.all, x - lcp), bisect_right(self.all, x + lcp)
            if hi - lo <= 4 * len(self.by_left):
                near = (y for y in self.all[lo:hi] if left[y] != left[x])
            else:
                near = (y for c, at in self.by_left.items() if c != left[x] for y in at[bisect_left(at, x - lcp) : bisect_right(at, x + lcp)])
            for y in near:
                yield (x, y) if x < y else (y, x)

    def add(self, small: _Places) -> None:
        if len(small.all) > 8:
            self.all = sorted(self.all + small.all)
        else:
            for x in small.all:
                insort(self.all, x)
        for c, at in small.by_left.items():
            mine = self.by_left.setdefault(c, [])
            if len(at) > 8:
                self.by_left[c] = sorted(mine + at)
            else:
                for x in at:
                    insort(mine, x)


def _join(node: list, child: _Places, left: list[int], best: dict) -> None:
    """Takes a finished child into a node (LCP, places), with the pairs between it and the children before it."""
    lcp, places = node
    large, small = (places, child) if len(places.all) >= len(child.all) else (child, places)
    for x, y in large.pairs(small, lcp, left):
        length = lcp + y - x
        if length >= LEAST:
            best[x, length] = min(y - x, best.get((x, length), y - x))
    large.add(small)
    node[1] = large


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start and period."""
    import numpy as np

    n = len(words)
    if n < LEAST:
        return []
    number: dict = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if not _repeats_six(codes):
        return []
    levels = _ranks(codes)
    order = np.argsort(levels[-1])
    common = _common(order, levels)
    deep = np.flatnonzero(common >= HALF)
    left, best = [-1, *codes[:-1].tolist()], {}
    suffixes, lcps = order.tolist(), common.tolist()
    # Neighbouring suffixes with LCP of HALF or more are the subtrees that can hold a run.
    for part in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        done, stack = _Places(suffixes[part[0] - 1], left), []
        for k in [*part.tolist(), None]:
            lcp = 0 if k is None else lcps[k]
            while stack and stack[-1][0] > lcp:
                _join(stack[-1], done, left, best)
                done = stack.pop()[1]
            if k is None:
                break
            if stack and stack[-1][0] == lcp:
                _join(stack[-1], done, left, best)
            else:
                stack.append([lcp, done])
            done = _Places(suffixes[k], left)
    return sorted((start, length, period) for (start, length), period in best.items())


def collapsed(words: list, runs: list) -> list:
    """The words that no run contains after its first period."""
    n = len(words)
    cover = [0] * (n + 1)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    kept, deep = [], 0
    for w, change in zip(words, cover):
        deep += change
        if not deep:
            kept.append(w)
    return kept


def find_runs(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, with n_words, runs (by start, then period) and kept (the words left, joined by one space)."""

    def make():
        def of(texts):
            counts, found, kept = [], [], []
            for text in texts:
                words = WORD.findall(text or "")
                runs = runs_of(words)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(" ".join(collapsed(words, runs) if runs else words))
            return counts, found, kept

        return of

    return map_texts(docs.select("doc_id", "text"), make, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256 of find_runs()."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    longest = F.element_at(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).otherwise(
        F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))).cast("int")), 1)
    best = F.when(F.size("runs") > 0, longest)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "kept")
    return rows.select(
        "doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def plant(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of a tenth of the documents, by crc32 of the id, repeat with a period from some place on.

    With h = crc32(doc_id), g = h div 10 and n words, h divisible by 10 and n > 0: each word i >= a becomes word a + (i - a) % p,
    a = g % n, p = 1 + (n - a) div (3 + g % 8). A null id or text changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("w"), F.expr("crc32(cast(doc_id as string)) div 10").alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, int(g % n), 0)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("int((n - a) div p) + 1"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), F.col("a")), again))
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
