"""Operator 5: language identification by bit-sliced Bloom filters of character n-grams.

Each slot of the filter holds one bit per language; the AND over an n-gram's slots returns all
languages that may hold it at once. Popcounts per language, corrected for each language's rate of
false positives, decide. n-grams are learned from whole texts of about FIT_ROWS labelled rows, chosen
by a hash threshold where they lie; a language keeps its GRAMS most frequent ones. ``und`` where the
text is null or has no letter, or where no language was learned; ties go to the first language by
name; repeated rows are predicted alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, share_of, trains

FIT_ROWS = 6000
GRAMS = 3000
SLOTS = 1 << 18
HASHES = 4
N = 3
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def grams(text: str):
    """64-bit codes of the character trigrams of lower-cased words, padded by spaces."""
    import re

    import numpy as np

    s = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    c = np.frombuffer(s.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(c) < N:
        return np.empty(0, np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]


def _slots(codes):
    import numpy as np

    for m in MULTIPLIERS[:HASHES]:
        yield ((codes * np.uint64(m)) >> np.uint64(64 - 18)).astype(np.int64)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Language names, filter planes of 64 languages each, and false-positive rates."""
    import numpy as np

    rows = docs.where(trains() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    # The hash takes in the text, so that rows of one id do not stand or fall together.
    rows = rows.where(share_of(F.xxhash64("doc_id", "text"), fit_rows, rows.count())).select("lang", "text")

    def count(batches):
        import pandas as pd

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                codes, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": codes.astype(np.int64), "n": n.astype(np.int64)})

    counts = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= GRAMS).select("lang", "gram").toPandas()
    langs = sorted(kept["lang"].unique())
    planes = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
    for i, lang in enumerate(langs):
        for at in _slots(kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).astype(np.uint64)):
            planes[i // 64, at] |= np.uint64(1 << (i % 64))
    full = [float(((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
    return {"langs": langs, "planes": planes, "false": [f**HASHES for f in full]}


def language_of(text: str | None, model: dict) -> tuple[str, float]:
    """(language, score) of one text."""
    import numpy as np

    langs, planes, false = model["langs"], model["planes"], np.asarray(model["false"])
    if text is None or not langs or not any(map(str.isalpha, text)):
        return "und", 0.0
    codes = grams(text)
    hits = np.zeros(len(langs))
    if len(codes):
        for p in range(len(planes)):
            mask = np.full(len(codes), ~np.uint64(0))
            for at in _slots(codes):
                mask &= planes[p, at]
            for i in range(64 * p, min(len(langs), 64 * p + 64)):
                hits[i] = np.count_nonzero(mask & np.uint64(1 << (i % 64)))
        hits = np.maximum(0.0, (hits - len(codes) * false) / (1 - np.minimum(false, 0.99)))
    best = int(hits.argmax())
    return langs[best], float(min(1.0, hits[best] / max(1, len(codes))))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score."""

    def make():
        return lambda texts: list(zip(*(language_of(t, model) for t in texts))) or [[], []]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, make, "lang_pred string, score double")
