"""Nulls, ids beyond doubles, repeated rows, ties, clashing names and models, for operators and pipeline stages."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pytest

import corpus_pipeline
from pkgscope.llm import encode, jaccard, langid, neighbours, packing, queries, repeats, secrets, token_counts, toxicity

BIG = 9007199254740993
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, shard int, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """A null id beside one that a double cannot hold, repeated rows, empty and null texts, columns of names that operators use."""
    rows = [(BIG, "one two three"), (None, "one two three"), (None, None), (7, ""), (7, ""), (BIG + 2, "secret = abcdefgh1234")]
    return spark.createDataFrame([(i, t, "en" if i else None, None, None, "k", "r", 1, "s") for i, t in rows], SCHEMA).coalesce(1)


def test_ids_pass_beside_nulls(spark, odd):
    labels = spark.createDataFrame([(BIG, 1), (7, 0), (None, 1), (BIG, None)], "doc_id long, toxic int")
    want = Counter([BIG, None, None, 7, 7, BIG + 2])
    made = [
        token_counts.token_lengths(odd, queries.vocabulary()), toxicity.score(odd, toxicity.fit(odd, labels)), langid.predict(odd, langid.fit(odd)),
        secrets.scan(odd, secrets.fit(odd)), secrets.redact(odd, None), packing.pieces(odd, queries.vocabulary()), repeats.remove_repeats(odd),
        jaccard.join_classes(odd),
    ]
    for table in made:
        assert Counter(r["doc_id"] for r in table.collect()) == want


def test_stages_keep_clean_rows_and_columns(spark, odd, tmp_path):
    spark.createDataFrame([(7, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not in any text of these at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, odd.limit(0)):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
            # The near-duplicate stage drops one of two equal worded texts; no other stage finds anything but a secret to mask.
            assert out.count() == (n - 1 if n and name == "ngram_jaccard_join" else n), name
        packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
        assert packed.count() == n
    masked = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["secret_scans"](spark, odd, str(tmp_path)).collect()}
    assert masked[BIG + 2]["text"] == "[secret]" and masked[BIG + 2]["n_chars"] == 8 and masked[BIG]["text"] == "one two three"


def test_run_against_its_stages_by_hand(spark, sf):
    """Each stage of run() on the given tables, told again with plain Python where that is short."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    of, (b0, b1, b2) = toxicity._features(model["lexicon"], model["exceptions"]), model["beta"]
    chance = {d["doc_id"]: 1 / (1 + np.exp(-(b0 + b1 * np.log1p(t) + b2 * np.log1p(r)))) for d in docs for t, r in [of(d["text"])]}
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert all(abs(chance[i] - scored[i]) < 1e-9 for i in chance)
    docs = [d for d in docs if chance[d["doc_id"]] < 0.5]

    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"\w+", d["text"].lower())) else None for d in docs]
    root, holders = list(range(len(docs))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s or () for j in holders.get(x, ())).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k]["doc_id"])
                root[b] = a
        for x in s or ():
            holders.setdefault(x, []).append(i)
    docs = [d for i, d in enumerate(docs) if sets[i] is None or find(i) == i]

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        if w:
            n = min(10, len(w))
            windows.setdefault(n, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    hit = lambda w: any(tuple(w[k : k + n]) in found for n, found in windows.items() for k in range(len(w) - n + 1))
    docs = [d for d in docs if not hit(words(d["text"]))]

    tot = [secrets.transitions([s for d in docs for s in sorted(secrets.samples(d["text"])[k])]) for k in (0, 1)]
    ratio = secrets.ratios(*tot)
    texts = {d["doc_id"]: secrets.masked(d["text"], ratio, "[secret]") for d in docs}
    encoder, want = encode.encoder(queries.vocabulary()).whole, Counter()
    for i, t in texts.items():
        n = len(encoder.encode(t, add_special_tokens=False).ids) + 1
        want.update((i, p, min(4096, n - 4096 * p)) for p in range(-(-n // 4096)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == want
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


def test_letter_only_secrets_are_found_and_identifiers_are_not(spark):
    rng = random.Random(9)
    random_of = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    names = ["internationalization", "documentation_builder", "section_2023_update", "configuration_loader_12", "representation", "final_section_report_2022"]
    texts = [f"token = {random_of(32)} and then {rng.choice(names)} with {rng.choice(names)}" for _ in range(300)]
    hidden = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(28))
    texts += [f"see {hidden} there", "see section_2024_update_12_final there"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratio = secrets.fit(rows.where("doc_id < 300"))
    by_hand = secrets.ratios(*[secrets.transitions([s for t in texts[:300] for s in sorted(secrets.samples(t)[k])]) for k in (0, 1)])
    assert np.allclose(ratio, by_hand)
    found = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in secrets.scan(rows, ratio).collect()}
    assert found[300] == [("markov", 4, 32)] and found[301] == []


def test_exception_phrases_are_given_or_learned(spark):
    toxic = [f"you are a bozo number {i}" for i in range(60)]
    clean = [f"the bozo circus came to town {i}" for i in range(20)] + [f"a quiet day {i}" for i in range(200)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "bozo" in model["lexicon"] and "bozo circus" in model["exceptions"]
    of = toxicity._features({"bozo": 2.0}, ("bozo circus",))
    assert of("the bozo circus") == (0.0, 0.0) and of("b0zo!")[0] == 2.0 and of("B.o.z.o bozo")[0] == 4.0 and of(None) == of("") == (0.0, 0.0)


def test_language_by_brute_force():
    model = {"langs": ["aa", "bb"], "planes": np.zeros((1, langid.SLOTS), np.uint64), "false": [0.0, 0.0]}
    for i, text in enumerate(("abc abd", "xyz xyw abc")):
        for at in langid._slots(langid.grams(text)):
            model["planes"][0, at] |= np.uint64(1 << i)
    assert langid.language_of("ABD", model) == ("aa", 1.0)
    assert langid.language_of("XYZ xyw", model)[0] == "bb" and langid.language_of("abc", model)[0] == "aa"
    assert langid.language_of("12 !", model) == langid.language_of(None, model) == ("und", 0.0)
    assert langid.language_of("xyz " * 20000, model)[0] == "bb"


def optimum(histogram, capacity):
    """Least number of sequences, by trying all ways for the longest piece left."""
    from functools import lru_cache

    sizes = sorted(histogram, reverse=True)

    @lru_cache(None)
    def least(left):
        if not any(left):
            return 0
        first = next(i for i, n in enumerate(left) if n)
        best = sum(left)
        for k in range(capacity // min(sizes) + 1):
            for more in combinations_with_replacement(range(first, len(sizes)), k):
                own = Counter(more) + Counter([first])
                if sum(sizes[i] * n for i, n in own.items()) <= capacity and all(left[i] >= n for i, n in own.items()):
                    best = min(best, 1 + least(tuple(n - own[i] for i, n in enumerate(left))))
        return best

    return least(tuple(histogram[s] for s in sizes))


@pytest.mark.parametrize("seed", range(6))
def test_packing_against_the_optimum(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(20, 61): rng.randrange(1, 4) for _ in range(4)}
    plan = packing.plan_configurations(dict(histogram), 100)
    assert sum(n for _, n in plan) <= optimum(histogram, 100) + 1


def test_encoder_equals_the_whole_tokenizer():
    import pyarrow as pa

    texts = [None, "", " ", "It's a TÉST x<|endoftext|>y", "é a\tq", "ÀÉ×÷ß’s it'll'D Straße 12ab--", "中文 текст K", "a\n\nb" * 50]
    own = encode.encoder(queries.vocabulary())
    got = [x.tolist() for ids, ends in own.slices(pa.array(texts)) for x in np.split(ids, ends[:-1])]
    assert got == [x.ids for x in own.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_neighbours_in_double_with_repeats_ties_and_wide_vectors(spark):
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(60, 1500))
    rows = [(i, x.tolist()) for i, x in enumerate(wide)] + [(20, wide[20].tolist()), (61, wide[3].tolist()), (62, [float("inf")] * 1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(table, 5, 20).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 20, 40):
        near = sorted(((-float(np.cumsum(np.array(v) * wide[q])[-1]), i) for i, v in rows if i != q and np.isfinite(v).all()))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert got == want
    assert neighbours.nearest(table.limit(0), 5, 20).count() == 0


def test_empty_key_is_that_of_an_empty_text(odd):
    rows = jaccard.join_classes(odd).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] == 7} == {7: 7}
    assert hashlib.md5(b"").hexdigest() == odd.selectExpr("md5(coalesce(null, ''))").first()[0]
