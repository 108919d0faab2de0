"""Periodic runs against all periods of all stretches, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pkgscope.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def digest(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), s, m, q, 1000 * m // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 9), st.lists(st.integers(0, 2), max_size=30))
def test_runs_are_all_runs(head, base, times, tail):
    words = head + base * times + tail
    assert runs.runs_of(words) == brute(words)


def test_runs_that_meet_and_nest():
    for words in (["a"] * 12, ["a"] * 11, list("ab" * 6), list("abcabcabcabc" * 2 + "abcabd"), list("aab" * 4 + "aab" * 4 + "c") * 3, list("abcdef" * 2), list("abcdefg" * 2)):
        assert runs.runs_of(words) == brute(words)


@pytest.mark.parametrize("words, at_most", [(["a"] * 30000, 1), ([c for k in range(4000) for c in (f"x{k}", *"abcdefg")], 0), (list(range(50)) * 400, 1)])
def test_long_texts_of_one_word_or_one_phrase(words, at_most):
    assert len(runs.runs_of(words)) == at_most


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "x " * 40, "a\xa0b \x1cq " * 9, "Ünï cödé " * 7, " ".join(rng.choice("ab") for _ in range(300)), "same text here " * 5]
    rows = [(i, texts[i % len(texts)], "k", 1) for i in range(260)] + [(None, texts[8], "k", 1), (3, "x " * 40, "k", 1), (3, "x " * 40, "k", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((digest(i, t) for i, t, _, _ in rows), key=repr)
    empty = f"{tmp_path}/none"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert queries.op11_periodic_runs(spark, empty).count() == 0


def test_query_on_the_given_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        if len(t or "") < 20000:
            assert got[i] == digest(i, t)
