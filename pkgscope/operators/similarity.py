"""Vector neighbours of a stated query set, their vote, and the closest of each class.

Queries and index meet in blocks (tiles), which keep each query's best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tiles

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def neighbours(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, label, score, rank of each query's k most similar other vectors (unit vectors, inner product)."""
    return top(tiles.best(index, queries, k).drop("side"), k)


def top(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_families(near: DataFrame, vectors: DataFrame, duplicate: float = 0.99, k: int = 10) -> DataFrame:
    """Of each query's ranked candidates (query_id, vec_id, score, label, rank) the first k that are no near copies of one chosen before.

    A query's candidates are as many as top() kept, so folding them in order is bounded; vectors are of length 1.
    """
    listed = near.join(vectors.select("vec_id", F.col("embedding").alias("_v")), "vec_id")
    listed = listed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "label", "_v"))).alias("c"))
    copy = lambda chosen, x: F.exists(chosen, lambda y: dot(y["_v"], x["_v"]) >= duplicate)
    add = lambda chosen, x: F.when((F.size(chosen) >= k) | copy(chosen, x), chosen).otherwise(F.concat(chosen, F.array(x)))
    chosen = F.aggregate("c", F.slice(F.col("c"), 1, 0), add)
    return listed.select("query_id", F.explode(chosen).alias("x")).select("query_id", "x.rank", "x.vec_id", "x.score", "x.label")


def vote(neighbours: DataFrame, malicious: Column, temperature: float = 0.02) -> DataFrame:
    """query_id, share: softmax-weighted share of malicious neighbours."""
    best = F.max("score").over(W.partitionBy("query_id"))
    w = neighbours.withColumn("w", F.exp((F.col("score") - best) / temperature))
    return w.groupBy("query_id").agg((F.sum(F.when(malicious, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))


def closest(pairs: DataFrame, malicious: Column) -> DataFrame:
    """query_id and the greatest score to a malicious and to a benign vector, with their ids."""
    def best(side: Column, name: str) -> list[Column]:
        at = F.max(F.when(side, F.struct(F.col("score"), (-F.col("vec_id")).alias("v"))))
        return [at["score"].alias(f"{name}_score"), (-at["v"]).alias(f"{name}_id")]

    return pairs.groupBy("query_id").agg(*best(malicious, "malicious"), *best(~malicious, "benign"))
