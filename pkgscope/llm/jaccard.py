"""Operator 2: n-gram Jaccard join by a MinHash LSH forest.

Equal texts become one node. Each node has TREES signatures of DEPTH minhashes; a tree is the sorted
prefix trie of one of them. Matched prefixes shorten from DEPTH: at each length the pairs that newly
match in some tree are verified on whole shingle sets (five words, 64-bit hashes), and a node stops
once the recall that its least similar verified link implies at that length reaches RECALL. Nodes
without a link go on to ``least_prefix()``, where a link at the threshold itself is met with that recall.

Subtrees at that least prefix are the units of work. Large ones are dealt into blocks of about BLOCK
nodes and each pair of blocks is one unit; a pair counts in the first tree where it meets; pairs never
become rows: a unit gives each node's number of links and the least node of its component there. Classes
are the connected components; links counts a node's verified partners. Texts under five words are one
shingle; null and wordless texts link to nothing and are each a class of their own; repeated rows
share a class; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_hot, text_key
from .graph import components

WORDS_PER_SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, BLOCK = 16, 8, 0.995, 256


def recall_at(similarity, k: int):
    """Chance that two sets of this similarity match on k minhashes in one tree or more."""
    return 1 - (1 - similarity**k) ** TREES


def least_prefix(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    k = DEPTH
    while k > 1 and recall_at(threshold, k) < recall:
        k -= 1
    return k


def _signatures(docs: DataFrame, n: int, least: int) -> DataFrame:
    """key, prefixes (hash of the first ``least`` minhashes in each tree), signs (16 bits of each minhash)."""

    def run(batches):
        import numpy as np
        import pandas as pd

        from .shingles import WordHashes, mix, shingle_set

        hashes = WordHashes()
        seeds = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                s = shingle_set(hashes, text, n)
                if not len(s):
                    continue
                low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 2048):
                    x = s[at : at + 2048, None] ^ seeds[None, :]
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                    low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
                low = low.reshape(TREES, DEPTH)
                prefix = np.zeros(TREES, np.uint64)
                for d in range(least):
                    prefix = mix(prefix * np.uint64(31) + low[:, d])
                rows.append((key, prefix.astype(np.int64), low.astype(np.uint16).tobytes()))
            yield pd.DataFrame(rows, columns=["key", "prefixes", "signs"])

    return docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).mapInPandas(run, "key string, prefixes array<long>, signs binary")


def _shingle_table(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """key, shingles (sorted 64-bit hashes as bytes) of the texts that take part in a candidate."""

    def run(batches):
        from .shingles import WordHashes, shingle_set

        hashes = WordHashes()
        for batch in batches:
            yield batch[["key"]].assign(shingles=[shingle_set(hashes, t, n).tobytes() for t in batch["text"]])

    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text"))
    # Copies go before the exchange, so that no task gets all rows of a hot text.
    return texts.dropDuplicates(["key"]).join(keys, "key", "left_semi").mapInPandas(run, "key string, shingles binary")


def _overlaps(shingles):
    """Function of two index arrays: numbers of common shingles, pair by pair while pairs are few, else from one product for all."""
    import numpy as np

    m, product = len(shingles), None
    sizes = np.fromiter(map(len, shingles), np.int64, m)

    def of(x, y):
        nonlocal product
        if product is None and len(x) <= 4 * m:
            return np.fromiter((len(np.intersect1d(shingles[i], shingles[j], assume_unique=True)) for i, j in zip(x, y)), np.int64, len(x))
        if product is None:
            # Shingles of one node alone add to no intersection; the others are columns of a 0/1 matrix, made a strip at a time.
            _, column, times = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
            row, number = np.repeat(np.arange(m), sizes), np.cumsum(times > 1) - 1
            shared = times[column] > 1
            row, column = row[shared], number[column[shared]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            product = np.zeros((m, m), np.float32)  # whole numbers under 2**24: exact
            for at in range(0, int(number[-1]) + 1, 4096):
                lo, hi = np.searchsorted(column, [at, at + 4096])
                strip = np.zeros((m, 4096), np.float32)
                strip[row[lo:hi], column[lo:hi] - at] = 1
                product += strip @ strip.T
        return product[x, y].astype(np.int64)

    return of


def _matched(signs, x, y):
    """Longest matched prefix of each pair over all trees."""
    import numpy as np

    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 1 << 14):
        same = signs[x[at : at + (1 << 14)]] == signs[y[at : at + (1 << 14)]]
        out[at : at + (1 << 14)] = np.logical_and.accumulate(same, axis=2).sum(axis=2).max(axis=1)
    return out


def _verified(prefixes, signs, shingles, tree: int, own, threshold: float, least: int):
    """Matrix of the pairs that first meet in this tree and reach the threshold; own has each node's side where two blocks meet, else None."""
    import numpy as np

    m = len(shingles)
    ask = np.triu(np.ones((m, m), bool), 1)
    if own is not None:
        ask &= own[:, None] != own[None, :]
    for t in range(tree):
        ask &= prefixes[:, t, None] != prefixes[None, :, t]
    sizes = np.fromiter(map(len, shingles), np.int64, m)
    ask &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :])
    x, y = np.nonzero(ask)
    length, common = _matched(signs, x, y), _overlaps(shingles)
    linked, lowest = np.zeros((m, m), bool), np.full(m, np.inf)
    settled, done = np.zeros(m, bool), np.zeros(len(x), bool)

    def verify(now):
        i, j = x[now], y[now]
        both = common(i, j)
        good = both >= threshold * (sizes[i] + sizes[j] - both)
        i, j, similarity = i[good], j[good], (both / (sizes[i] + sizes[j] - both))[good]
        linked[i, j] = True
        np.minimum.at(lowest, i, similarity)
        np.minimum.at(lowest, j, similarity)
        done[now] = True

    for k in range(DEPTH, least - 1, -1):
        verify((length == k if k > least else length <= k) & ~(settled[x] & settled[y]))
        settled = np.isfinite(lowest) & (recall_at(np.minimum(lowest, 1.0), k) >= RECALL)
    # Pairs of texts that had reached the recall come last, so that no pair that shares a prefix goes unverified.
    verify(~done)
    return linked


def _unit_links(keys, prefixes, signs, shingles, tree: int, own, threshold: float, least: int) -> list[tuple[str, str, int]]:
    """(key, least key of its component in this unit, number of links here) of the nodes with links."""
    import numpy as np

    ok = _verified(prefixes, signs, shingles, tree, own, threshold, least)
    ok |= ok.T
    degree = ok.sum(axis=1)
    at = np.argsort(np.array(keys))
    rank = np.empty(len(keys), np.int64)
    rank[at] = np.arange(len(keys))
    rank = np.where(degree > 0, rank, len(keys))
    while True:
        near = np.minimum(rank, np.where(ok, rank[None, :], len(keys)).min(axis=1))
        if (near == rank).all():
            return [(keys[i], keys[at[rank[i]]], int(degree[i])) for i in np.nonzero(degree)[0]]
        rank = near


def links(docs: DataFrame, n: int = WORDS_PER_SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """key, to, n: a text of the same class (itself for the least of a unit) and a number of verified links; a key's n add up to its links."""
    least = least_prefix(threshold)
    signatures = cut(_signatures(docs, n, least).dropDuplicates(["key"]))
    trie = signatures.select("key", F.posexplode("prefixes").alias("tree", "p"))
    prints = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"h{i}") for i in range(2)]
    buckets = trie.groupBy("tree", "p").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), *prints).where("n > 1")
    # Buckets of the same nodes in later trees hold no pair that has not met before.
    buckets = buckets.groupBy("n", "low", "high", "h0", "h1").agg(F.min(F.struct("tree", "p")).alias("at")).select("at.tree", "at.p", "n")
    members = cut(trie.join(buckets, ["tree", "p"]))
    shingles = _shingle_table(docs, members.select("key").distinct(), n)
    nodes = signatures.join(shingles, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    units = members.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = units.select("key", "tree", "p", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    unit = ["tree", "p", "i", "j"]
    dealt = units.join(nodes, "key").repartition(*unit).sortWithinPartitions(*unit)

    def run(batches):
        import itertools

        import numpy as np
        import pandas as pd

        rows = (r for b in batches for r in zip(b["tree"], b["p"], b["i"], b["j"], b["own"], b["key"], b["prefixes"], b["signs"], b["shingles"]))
        out = []
        for (tree, _, i, j), group in itertools.groupby(rows, key=lambda r: r[:4]):
            own, keys, prefixes, signs, sets = zip(*(r[4:] for r in group))
            if len(keys) > 1:
                own = None if i == j else np.array(own)
                signs = np.stack([np.frombuffer(x, np.uint16).reshape(TREES, DEPTH) for x in signs])
                out += _unit_links(keys, np.stack(prefixes), signs, [np.frombuffer(x, np.uint64) for x in sets], tree, own, threshold, least)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["key", "to", "n"])
                out = []
        yield pd.DataFrame(out, columns=["key", "to", "n"])

    return cut(dealt.mapInPandas(run, "key string, to string, n long"))


def join_classes(docs: DataFrame, n: int = WORDS_PER_SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (different linked texts), copies (rows of the same text)."""
    found = links(docs, n, threshold)
    roots = components(found.where("key <> to").select(F.col("key").alias("a"), F.col("to").alias("b")))
    degree = found.groupBy(F.col("key").alias("node")).agg(F.sum("n").alias("n_links"))
    nodes = roots.join(degree, "node").withColumnRenamed("node", "key")
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"(?U)\w")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), wordless.alias("wordless"))
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).join(nodes, "key", "left")
    keys = cut(keys.withColumn("root", F.coalesce("root", "key")))
    classes = keys.groupBy("root").agg(F.min("first").alias("class_id"))
    keys = keys.join(classes, "root").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
    return join_hot(rows, keys, "key").select(
        "doc_id", F.when(F.col("wordless"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("n_links").cast("long"), F.col("copies").cast("long")
    )


def keep_one(docs: DataFrame, n: int = WORDS_PER_SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: of least doc_id (nulls last), then of least text key; ids may be null or repeat. Wordless rows all stay."""
    found = links(docs, n, threshold)
    roots = components(found.where("key <> to").select(F.col("key").alias("a"), F.col("to").alias("b")))
    key, wordless, kept, own = (fresh(docs, c) for c in ("key", "wordless", "kept", "own"))
    marked = docs.withColumns({key: text_key(), wordless: ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"(?U)\w")})
    worded = marked.where(~F.col(wordless))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))
    first = worded.groupBy(F.col(key).alias("key")).agg(F.min(order).alias("first"))
    first = first.join(roots, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    survivors = first.select(F.col("first.key").alias(kept), F.col("first.doc_id").alias(own))
    one = worded.join(survivors, (F.col(key) == F.col(kept)) & worded["doc_id"].eqNullSafe(F.col(own)), "left_semi")
    return one.dropDuplicates([key]).union(marked.where(F.col(wordless))).drop(key, wordless)
