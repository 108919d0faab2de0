"""No pair that shares a prefix is left unverified, at similarities just above the threshold."""

import random
from collections import Counter, defaultdict

from pkgscope.llm import jaccard
from pkgscope.llm.shingles import WordHashes, shingle_set


def test_every_pair_that_shares_a_prefix_is_linked(spark):
    rng, texts = random.Random(5), []
    for f in range(250):
        base = [f"w{rng.randrange(10**6)}" for _ in range(320)]
        for c in range(4):
            # Two pairs of closest copies, which have all the recall they need by themselves; the pairs are further apart.
            own, pair = list(base), c // 2
            for at in range(2):
                own[20 + 90 * at + pair * 8] = f"x{f}_{pair}_{at}"
            if c % 2:
                own[250 + pair * 8] = f"y{f}_{c}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    hashes = WordHashes()
    sets = [set(shingle_set(hashes, t, 5).tolist()) for t in texts]
    signed = {r["key"]: r["prefixes"] for r in jaccard._signatures(docs, 5, jaccard.least_prefix(0.8)).collect()}
    keys = [r["key"] for r in docs.orderBy("doc_id").select(jaccard.text_key().alias("key")).collect()]
    holders = defaultdict(set)
    for i, k in enumerate(keys):
        for t, p in enumerate(signed[k]):
            holders[t, p].add(i)
    near, want = 0, Counter()
    for i in range(len(texts)):
        for j in {j for t, p in enumerate(signed[keys[i]]) for j in holders[t, p]} - {i}:
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                want[i] += 1
                near += common < 0.86 * (len(sets[i]) + len(sets[j]) - common)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join_classes(docs).collect()}
    assert near > 500 and all(got[i] == want[i] for i in range(len(texts)))
