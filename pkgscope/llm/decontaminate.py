"""Operator 7 [native]: benchmark decontamination by a broadcast set of n-gram windows.

Words are maximal runs outside ASCII punctuation and space after A-Z are lower-cased. Every
document window of 10 words (and of each shorter whole item's length) gets a 64-bit fingerprint
by hashing doubled runs; fingerprints meet the benchmark's set in a broadcast hash join while that
set is under ``broadcast_rows`` (a shuffled join beyond), and each hit is verified word by word.
Results depend on the text alone, so copies share one entry. Null texts have no words and are never
contaminated; an empty benchmark marks nothing; repeated rows are kept; null item ids are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_key

N_WORDS = 10
# Each character by itself: a class of single characters is one table for the JVM, one of ranges a chain of calls for every character.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _doubled(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds column fp_n for each n of lengths; intermediate powers are columns so that each is made once."""
    df = df.withColumn("f1", F.transform("words", lambda w: F.xxhash64(w)))
    have = {1: "f1"}

    def need(df: DataFrame, n: int) -> DataFrame:
        if n in have:
            return df
        half = 1 << ((n - 1).bit_length() - 1)
        df = need(need(df, half), n - half)
        a, b = F.col(have[half]), F.col(have[n - half])
        keep = F.greatest(F.size(b) - half, F.lit(0))
        have[n] = f"f{n}"
        return df.withColumn(f"f{n}", F.zip_with(F.slice(a, F.lit(1), keep), F.slice(b, F.lit(half + 1), keep), lambda x, y: F.xxhash64(x, y)))

    for n in lengths:
        df = need(df, n)
    return df


def find_contamination(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS, broadcast_rows: int = 2_000_000) -> DataFrame:
    """text_key, spans array<struct<pos, n, item_id>> of verified hits, one row per contaminated text."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words().alias("words")).where("size(words) > 0")
    items = items.withColumn("n", F.least(F.size("words"), F.lit(n_words)))
    lengths = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]
    if not lengths:
        return docs.where("false").select(text_key().alias("key"), F.expr("cast(null as array<struct<pos:int,n:int,item_id:string>>)").alias("spans"))

    def windows(df: DataFrame, keep: list[str], only_short: bool) -> DataFrame:
        df = _doubled(df, lengths)
        # Outer generators: for others Spark filters on the array's size first, which makes every array twice and more.
        each = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"f{n}").alias("f")) for n in lengths])
        rows = df.withColumnRenamed("n", "own") if only_short else df
        rows = rows.select(*keep, *(["own"] if only_short else []), F.explode_outer(each).alias("e"))
        if only_short:
            rows = rows.where("e.n = own")
        return rows.select(*keep, F.col("e.n").alias("n"), F.posexplode_outer("e.f").alias("pos", "fp"))

    bench = windows(items, ["item_id", "words"], True).select("item_id", "n", "fp", F.expr("slice(words, pos + 1, n)").alias("window")).where("pos is not null").distinct()
    n_bench = bench.count()
    # The probe side carries fingerprints alone; texts come back only for hits.
    hay = windows(docs.select(text_key().alias("key"), words().alias("words")), ["key"], False)
    prints = bench.select("n", "fp").distinct()
    hits = hay.join(F.broadcast(prints) if n_bench <= broadcast_rows else prints, ["n", "fp"])
    hits = hits.groupBy("key").agg(F.collect_set(F.struct("pos", "n", "fp")).alias("hits"))
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).join(hits, "key").dropDuplicates(["key"])
    checked = (
        texts.select("key", words().alias("words"), "hits")
        .select("key", "words", F.explode("hits").alias("hit"))
        .select("key", "hit.pos", "hit.n", "hit.fp", F.expr("slice(words, hit.pos + 1, hit.n)").alias("window"))
    )
    checked = checked.join(F.broadcast(bench) if n_bench <= broadcast_rows else bench, ["n", "fp", "window"])
    return checked.groupBy("key").agg(F.collect_set(F.struct("pos", "n", "item_id")).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """The columns of docs plus n_words, n_hit, item_ids (sorted as strings), contaminated; input columns of these names give way."""
    found = find_contamination(docs, benchmark, n_words).select(
        "key",
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1))))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))).alias("item_ids"),
    )
    key = fresh(docs, "key")
    out = docs.drop("n_words", "n_hit", "item_ids", "contaminated").withColumn(key, text_key()).withColumn("n_words", F.size(words()).cast("long"))
    out = out.join(found.withColumnRenamed("key", key), key, "left")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn(
        "item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))
    ).withColumn("contaminated", F.col("n_hit") > 0).drop(key)


def keep_clean(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """The rows of docs without any window of the benchmark, columns unchanged."""
    key = fresh(docs, "key")
    found = find_contamination(docs.select("text"), benchmark, n_words).select(F.col("key").alias(key))
    return docs.withColumn(key, text_key()).join(found, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
