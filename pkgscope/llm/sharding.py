"""Operator 3 [native]: histogram sort into shards of near-equal bytes.

Rows are ordered by (hash of text, hash of doc_id), so equal texts are neighbours and a hot group
of copies may still be cut between shards. Exact bytes below candidate boundaries are counted on
all partitions; only the bins that hold an unmet splitter are probed again, more finely, until
every splitter is within the tolerance or its bin is a single key; then rows are exchanged once.
The driver sees at most shards x PROBES counts a round. Size: UTF-8 bytes plus 16; a null text has
no bytes and crc32 0. Rows equal in doc_id and text share a key and stay together. An empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

PROBES = 512
BITS = 62


def _probe(rows: DataFrame, brackets: dict) -> dict:
    """Exact bytes, least and greatest key of each probe bin inside each bracket."""
    which = at = None
    for i, (column, lo, hi, fixed) in brackets.items():
        key = F.col(column)
        inside = (key >= lo) & (key <= hi)
        if fixed is not None:
            inside &= F.col("h") == fixed
        width = max(1, -(-(hi - lo + 1) // PROBES))
        bin_ = F.expr(f"({column} - {lo}L) div {width}L")
        which = F.when(inside, F.lit(i)) if which is None else which.when(inside, F.lit(i))
        at = F.when(inside, bin_) if at is None else at.when(inside, bin_)
    found = (
        rows.select("h", "t", "size", which.alias("i"), at.alias("b")).where("i is not null").groupBy("i", "b")
        .agg(F.sum("size").alias("s"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("t").alias("t0"), F.max("t").alias("t1")).collect()
    )
    out: dict = {}
    for r in sorted(found, key=lambda r: (r["i"], r["b"])):
        out.setdefault(r["i"], []).append(r)
    return out


def splitters(rows: DataFrame, n_shards: int, tolerance: float = 0.002) -> list[tuple[int, int]]:
    """Least-excess upper keys (h, t) of shards 0 .. n_shards-2."""
    top = (1 << BITS) - 1
    first = _probe(rows, {0: ("h", 0, top, None)}).get(0, [])
    total = sum(r["s"] for r in first)
    slack = tolerance * total / n_shards
    goals = {k: total * (k + 1) / n_shards for k in range(n_shards - 1)}
    state = {k: (("h", 0, top, None), 0) for k in goals}
    probed = {("h", 0, top, None): first}
    done: dict[int, tuple[int, int]] = {}
    while state:
        nxt = {}
        for k, (bracket, below) in state.items():
            acc, chosen = below, None
            for r in probed[bracket]:
                chosen = r
                if acc + r["s"] >= goals[k]:
                    break
                acc += r["s"]
            if chosen is None:
                done[k] = (top, top)
            elif acc + chosen["s"] - goals[k] <= slack or (chosen["h0"] == chosen["h1"] and chosen["t0"] == chosen["t1"]):
                done[k] = (chosen["h1"], top if bracket[0] == "h" else chosen["t1"])
            elif chosen["h0"] == chosen["h1"]:
                nxt[k] = (("t", chosen["t0"], chosen["t1"], chosen["h0"]), acc)
            else:
                nxt[k] = (("h", chosen["h0"], chosen["h1"], None), acc)
        brackets = sorted({b for b, _ in nxt.values()}, key=str)
        found = _probe(rows, dict(enumerate(brackets))) if brackets else {}
        probed = {b: found.get(i, []) for i, b in enumerate(brackets)}
        state = nxt
    return [done[k] for k in sorted(done)]


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.col("text").cast("string")
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - BITS).alias("h"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("row")), 64 - BITS).alias("t"),
    ))
    shard = F.lit(0)
    for h, t in splitters(rows, n_shards, tolerance):
        shard = shard + ((F.col("h") > h) | ((F.col("h") == h) & (F.col("t") > t))).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "part", F.shiftright("h", BITS - 6) * 64 + F.shiftright("t", BITS - 6)
    )
    # Slots run on through the (shard, part) cells; their counts, at most 4,096 a shard, give each cell's start.
    cells = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("h", "t", "doc_id", "text_crc32"))
    return placed.withColumn("rank", rank).join(cells, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
