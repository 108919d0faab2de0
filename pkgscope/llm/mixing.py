"""Operator 13 [native]: sources mixed to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and text and read in up to three passes.
The virtual finish time of a document in a pass is the number of words of its source up to and with it,
divided by the source's target. All sources' documents, sorted by that time, are the mix; it stops at
the total budget, where the last document is cut short. Sums over the order are taken in two levels
(inside range partitions and over them), and rows equal in all that is returned are told apart by a
number of their own only, so a hot source or a row repeated without end is spread over tasks.

Words are runs of characters other than the space and \\x09-\\x0D; a null or empty text has none, and is
never taken. Sources weigh by their rank in code-point order, null last and a source of its own.
Targets: the budget by weight, none above PASSES times its source's words, the excess shared anew
by weight among the others. Columns other than doc_id, text and source are ignored. Repeated rows
are rows of their own. Ties in the virtual time: by the source's rank. An empty table, or one without words,
takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PASSES = 3


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """rows with ``upto``: the sum of value over the rows of the group up to and with each, by order.

    Rows are range-partitioned by group and order, so a large group lies in many partitions; sums of whole
    partitions (one row a partition and group) come before the sums inside them. The sorted table is written,
    so that a lost executor changes no partition. Orders must be unique where value is not 0.
    """
    dealt = cut(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_{g}") for g in group], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same &= F.col(g) == F.col(f"_{g}")
    inside = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    upto = (F.col("_base") + F.sum(value).over(inside)).cast("long")
    return dealt.join(F.broadcast(base), same).withColumn("upto", upto).drop("_part", "_p", "_base", *[f"_{g}" for g in group])


def targets(sources: DataFrame, passes: int = PASSES, weights: tuple = WEIGHTS) -> DataFrame:
    """source, place (rank from 0, null last), source_size, target for rows (source, source_size): one row a source.

    A source is capped where its words times passes over its weight lie at or below the level that the others
    reach; with sources in the order of that ratio these are a prefix, so one pass over sums finds the level.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("place", place.cast("int")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))) + 1))
    rows = rows.withColumn("cap", passes * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "place")
    here, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(here), F.lit(0))
    # The level if this source and all of greater ratio share what the sources before it leave.
    rows = rows.withColumn("level", left / F.sum("weight").over(rest))
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level"))).over(W.partitionBy())
    rows = rows.withColumn("free", free)
    capped = F.col("free").isNull() | (F.struct("ratio", "place") < F.struct("free.ratio", "free.place"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("free.level"))
    return rows.select("source", "place", "source_size", target.alias("target"))


def shuffled(docs: DataFrame, words: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, size, place, source_size, target, upto) with the words of their source up to each, and the sources."""
    size = F.regexp_count("text", F.lit(WORD)) if words is None else words
    # One row may be repeated without end: the number, written once, sets its copies apart.
    rows = cut(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))).alias("draw"),
    ))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("row", "doc_id", "size", "draw", "place", "source_size", "target")
    done = running_sum(placed, ["place"], ["draw", "row"], "size").drop("draw")
    return done, sources


def mix(rows: DataFrame, passes: int = PASSES) -> DataFrame:
    """The mix: row, doc_id, place, pass, size, finish, start (words of the mix before it) and taken, by finish.

    rows as shuffled() returns them. The budget is the sum of all sizes. By time 1 no source has passed its target; where the
    documents that end shortly after it fill the budget, as one sum tells, those that end later are not sorted.
    """
    facts = rows.groupBy("place").agg(F.max("size").alias("longest"), F.sum("size").alias("words")).agg(F.sum("longest").alias("longest"), F.sum("words").alias("words")).first()
    budget = facts["words"] or 0
    edge = 1 + 2 * (facts["longest"] or 0) / max(1, budget)

    def finish(at: Column) -> Column:
        return (at * F.col("source_size") + F.col("upto")) / F.col("target")

    ended = sum(F.when(finish(F.lit(p)) <= edge, F.col("size")).otherwise(0) for p in range(passes))
    worded = rows.where("size > 0")
    enough = (worded.agg(F.sum(ended).alias("n")).first()["n"] or 0) >= budget
    items = worded.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("finish", finish(F.col("pass")))
    items = items.where(F.col("finish") <= (edge if enough else float("inf"))).select("row", "doc_id", "place", "pass", "size", "upto", "finish")
    sums = running_sum(items.withColumnRenamed("upto", "within"), [], ["finish", "place", "within", "pass"], "size")
    start = F.col("upto") - F.col("size")
    return sums.where(start < budget).select(
        "row", "doc_id", "place", "pass", "size", "finish", start.alias("start"), (F.least("upto", F.lit(budget)) - start).cast("long").alias("taken"),
    )


def taken(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: what the mix takes of each document, repeats counted.

    A source's part of the mix is the beginning of its passes, one after another, so the words taken of the whole source
    say which passes of a document lie in it.
    """
    rows, sources = shuffled(docs)
    part = mix(rows, passes).groupBy("place").agg(F.sum("taken").alias("part"))
    names = sources.select("place", "source").join(part, "place", "left").select("place", "source", F.coalesce("part", F.lit(0)).alias("part"))
    out = rows.join(F.broadcast(names), "place")
    words = sum(
        F.least(F.col("size"), F.greatest(F.lit(0), F.col("part") - (p * F.col("source_size") + F.col("upto") - F.col("size")))) for p in range(passes)
    )
    return out.select("doc_id", "source", "size", "source_size", "target", words.cast("long").alias("taken"))
