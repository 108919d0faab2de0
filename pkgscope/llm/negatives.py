"""Operator 12: hard negatives by an inverted multi-index with certified windows.

Vectors are cut into two halves, each with its own codebook; a row lies in the cell of its two nearest codes.
For an anchor, half a code's score plus the anchor's half norm times the code's radius (the largest distance of
any indexed row's half from it) bounds what that half can add, so the sum of two such bounds covers every row of a cell.
A heap walks both sorted lists of bounds and yields cells by falling sum; it stops at the first sum below what
is still sought, so whatever lies in cells not visited is certified not to matter. Three rounds: cells
of about SEED_ROWS rows give the score of a fifth positive; all cells that may hold a better one give the positives;
all cells that may reach the lower edge of a positive's window give the negatives. All results are exact.

The codebooks are fitted on about FIT_ROWS rows, chosen by a hash of the id; every row is indexed, and radii and counts are
those of all rows. There are at most MAX_CODES squared cells, whose facts (and nothing else) reach the driver.
Cells lie in shards of about SHARD_ROWS rows, larger ones in several; a round sends each anchor once to each shard
that it needs, and a task reads a shard's rows first and then its anchors as a stream, whatever their number.

Rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors meet those of their
own dimension only. Rows of the anchor's own id are neither its positives nor its negatives; other repeated rows
count each; an anchor repeated with equal label and vector is asked once. Inner products must fit a long. A positive of a negative
score has an empty window. An anchor without positives returns nothing, an empty table an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, share_of

FIT_ROWS = 20_000
MAX_CODES = 64
ROWS_A_CELL = 512
SHARD_ROWS = 16_384
SEED_ROWS = 1_024
ASKED = 256
INDEX = "vec_id long, label long, vec binary, cell int, e1 double, e2 double"
ROUTED = "shard long, anchor_id long, label long, vec binary, akey long, pids array<long>, pscores array<long>, cells array<int>"
FOUND = "anchor_id long, akey long, place int, positive_id long, positive_score long, vec_id long, score long"


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integer components) and dim of the rows that take part; labels are shifted where vec_id is divisible by 7."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return v.select("vec_id", label.alias("label"), F.transform("x", lambda x: F.floor(x * 256)).alias("v"), F.size("x").alias("dim"))


def codebook(x, k: int, rounds: int = 10):
    """k centres of the rows of x by Lloyd's rounds from a fixed draw."""
    import numpy as np

    centres = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        code = nearest_code(x, centres)
        counts = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_code(x, centres):
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _matrix(column, dim: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def build(rows: DataFrame, dim: int, n: int) -> tuple[DataFrame, dict]:
    """The index of n rows of one dimension (written), and its facts: codebooks, radii, cell counts and shards."""
    import numpy as np
    import pyarrow as pa

    codes = max(1, min(MAX_CODES, round((n / ROWS_A_CELL) ** 0.5)))
    sample = rows.where(share_of(F.xxhash64("vec_id"), FIT_ROWS, n)).select("v").toArrow()["v"].to_pylist() or [[0] * dim]
    sample = np.array(sample, dtype=float).reshape(len(sample), dim)
    half = dim // 2
    books = [codebook(sample[:, :half], codes), codebook(sample[:, half:], codes)]
    width = len(books[1])

    def run(batches):
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), dtype="<i8").reshape(len(batch), dim)
            own = [nearest_code(x.astype(float), b) for x, b in zip((v[:, :half], v[:, half:]), books)]
            far = [np.linalg.norm(x - b[c], axis=1) for x, b, c in zip((v[:, :half], v[:, half:]), books, own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array((own[0] * width + own[1]).astype("i4")), *map(pa.array, far)],
                names=["vec_id", "label", "vec", "cell", "e1", "e2"],
            )

    index = cut(rows.select("vec_id", "label", "v").mapInArrow(run, INDEX))
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("e1").alias("e1"), F.max("e2").alias("e2")).orderBy("cell").collect()
    radii, counts, shards, shard, used = [np.zeros(len(b)) for b in books], {}, {}, 0, 0
    for r in cells:
        at = divmod(r["cell"], width)
        counts[r["cell"]] = r["n"]
        for h in (0, 1):
            radii[h][at[h]] = max(radii[h][at[h]], r[f"e{h + 1}"])
        # Small neighbours share a shard; a large cell is cut over several.
        parts = -(-r["n"] // SHARD_ROWS)
        if used and (parts > 1 or used + r["n"] > SHARD_ROWS):
            shard, used = shard + 1, 0
        shards[r["cell"]] = (shard, parts)
        shard, used = (shard + parts, 0) if parts > 1 else (shard, used + r["n"])
    return index, {"dim": dim, "books": books, "radii": radii, "counts": counts, "shards": shards}


def visits(vec, facts: dict, floor: float, rows: float):
    """Cells by falling bound: all whose bound is floor or more, or as many as hold the given number of rows."""
    import numpy as np

    half = facts["dim"] // 2
    lists = []
    for q, book, radius in zip((vec[:half].astype(float), vec[half:].astype(float)), facts["books"], facts["radii"]):
        norm = np.linalg.norm(q)
        # The share beside the sum is above what rounding can take from it.
        bound = book @ q + norm * radius + 1e-9 * norm * (np.linalg.norm(book, axis=1) + radius) + 1e-6
        order = np.argsort(-bound, kind="stable")
        lists.append((bound[order].tolist(), order.tolist()))
    (b1, o1), (b2, o2) = lists
    heap, seen, held = [(-b1[0] - b2[0], 0, 0)], {(0, 0)}, 0
    while heap and held < rows:
        bound, i, j = heapq.heappop(heap)
        if -bound < floor:
            return
        cell = o1[i] * len(b2) + o2[j]
        if cell in facts["counts"]:
            held += facts["counts"][cell]
            yield cell
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(b1) and b < len(b2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-b1[a] - b2[b], a, b))


def _routed(asked: DataFrame, facts: dict, rows: float) -> DataFrame:
    """One row for each anchor and shard that it needs, with the cells to visit there."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = {c.split()[0]: [] for c in ROUTED.split(", ")}
            for r in batch.to_pylist():
                vec = _matrix(pa.array([r["vec"]], pa.binary()), facts["dim"])[0]
                need: dict = {}
                for cell in visits(vec, facts, r["floor"], rows):
                    first, parts = facts["shards"][cell]
                    for shard in range(first, first + parts):
                        need.setdefault(shard, []).append(cell)
                for shard, cells in need.items():
                    for c in ("anchor_id", "label", "vec", "akey", "pids", "pscores"):
                        out[c].append(r[c])
                    out["shard"].append(shard)
                    out["cells"].append(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())))],
                names=list(out),
            )

    return asked.mapInArrow(run, ROUTED)


def best_positives(score, ids, k: int):
    """Places of the best k of one anchor's scores, ties by id."""
    import numpy as np

    at = np.arange(len(score))
    if len(at) > k:
        edge = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= edge]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def windows(score, ids, positives: list[int], k: int):
    """(which positive, place) of the first k negatives in each positive's window."""
    import numpy as np

    open_ = [p for p in positives if p >= 0]
    if not open_:
        return []
    at = np.flatnonzero((score >= -(-80 * min(open_) // 100)) & (score <= max(open_)))
    at = at[np.lexsort((ids[at], -score[at]))]
    falling = -score[at]
    out = []
    for w, p in enumerate(positives):
        lo, hi = np.searchsorted(falling, -p, "left"), np.searchsorted(falling, -(-(-80 * p // 100)), "right")
        out += [(w, int(j)) for j in at[lo : max(lo, min(hi, lo + k))]]
    return out


def _meet(index: DataFrame, routed: DataFrame, facts: dict, k: int) -> DataFrame:
    """What the anchors find in the shards: their best k positives there, or (where pids are given) the first k negatives of each window."""
    import numpy as np
    import pyarrow as pa

    dim = facts["dim"]
    spark = index.sparkSession
    place = spark.createDataFrame([(c, s, p) for c, (s, p) in facts["shards"].items()], "cell int, first long, parts long")
    own = index.join(F.broadcast(place), "cell").withColumn("shard", F.col("first") + F.pmod(F.monotonically_increasing_id(), "parts"))
    none = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in ROUTED.split(", ")}
    rows = own.select("shard", F.lit(0).alias("kind"), F.col("vec_id").alias("anchor_id"), "label", "vec", none["akey"].alias("akey"), none["pids"].alias("pids"), none["pscores"].alias("pscores"), F.array("cell").alias("cells"))
    both = rows.unionByName(routed.withColumn("kind", F.lit(1))).repartition("shard").sortWithinPartitions("shard", "kind")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in FOUND.split(", ")]

    def answer(shelf, batch):
        ids, labels, vecs, cells = shelf
        members = {c: np.flatnonzero(cells == c) for c in np.unique(cells).tolist()}
        q = _matrix(batch.column("vec"), dim)
        # Products that add up exactly in doubles take the fast way.
        most = max(1, dim) * float(np.abs(vecs).max(initial=0)) * float(np.abs(q).max(initial=0))
        wide = np.float64 if most < 1 << 53 else np.int64
        score, met = np.zeros((len(q), len(ids)), wide), np.zeros((len(q), len(ids)), bool)
        wanted: dict = {}
        for i, some in enumerate(batch.column("cells").to_pylist()):
            for c in some:
                wanted.setdefault(c, []).append(i)
        for c, who in wanted.items():
            if c in members:
                score[np.ix_(who, members[c])] = q[who].astype(wide) @ vecs[members[c]].T.astype(wide)
                met[np.ix_(who, members[c])] = True
        out = []
        for i, r in enumerate(batch.select(["anchor_id", "label", "akey", "pids", "pscores"]).to_pylist()):
            sought = (ids != r["anchor_id"]) & (labels == r["label"] if r["pids"] is None else labels != r["label"])
            mine = np.flatnonzero(sought & met[i])
            got = score[i, mine]
            if r["pids"] is None:
                out += [(r["anchor_id"], r["akey"], 0, None, None, int(ids[mine[j]]), int(got[j])) for j in best_positives(got, ids[mine], k)]
            else:
                out += [(r["anchor_id"], r["akey"], w, r["pids"][w], r["pscores"][w], int(ids[mine[j]]), int(got[j])) for w, j in windows(got, ids[mine], r["pscores"], k)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

    def run(batches):
        shard, shelf, parts = None, None, []
        for batch in batches:
            edges = np.flatnonzero(np.diff(np.array(batch.column("shard")) * 2 + np.array(batch.column("kind")))) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                part = batch.slice(lo, hi - lo)
                if part.column("shard")[0].as_py() != shard:
                    shard, shelf, parts = part.column("shard")[0].as_py(), None, []
                if part.column("kind")[0].as_py() == 0:
                    parts.append((np.array(part.column("anchor_id")), np.array(part.column("label")), _matrix(part.column("vec"), dim), np.array(part.column("cells").flatten())))
                    continue
                if shelf is None and parts:
                    shelf, parts = [np.concatenate(x) for x in zip(*parts)], []
                for at in range(0, len(part) if shelf else 0, ASKED):
                    yield answer(shelf, part.slice(at, ASKED))

    return both.mapInArrow(run, FOUND)


def _mine_one(index: DataFrame, facts: dict, every: int, k: int) -> DataFrame:
    mine = W.partitionBy("anchor_id", "akey")
    asked = index.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vec", F.xxhash64("label", "vec").alias("akey"))
    asked = cut(asked.dropDuplicates(["anchor_id", "akey"]))
    none = F.lit(None).cast("array<long>")

    def positives(floor: DataFrame, rows: float) -> DataFrame:
        found = _meet(index, _routed(floor.withColumns({"pids": none, "pscores": none}), facts, rows), facts, k)
        return found.withColumn("place", F.row_number().over(mine.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)

    seeds = positives(asked.withColumn("floor", F.lit(float("-inf"))), SEED_ROWS)
    fifth = seeds.groupBy("anchor_id", "akey").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    floor = asked.join(fifth, ["anchor_id", "akey"], "left").na.fill(float("-inf"), ["floor"])
    found = positives(cut(floor), float("inf")).groupBy("anchor_id", "akey").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("p"))
    edge = F.array_min(F.transform(F.filter("p", lambda p: p["score"] >= 0), lambda p: p["score"] * 0.8 - 1e-6))
    again = asked.join(found, ["anchor_id", "akey"]).select("*", F.col("p.vec_id").alias("pids"), F.col("p.score").alias("pscores"), edge.alias("floor")).where("floor is not null")
    negatives = _meet(index, _routed(cut(again), facts, float("inf")), facts, k)
    rank = F.row_number().over(W.partitionBy("anchor_id", "akey", "place").orderBy(F.desc("score"), "vec_id")).cast("int")
    return negatives.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine(vectors: DataFrame, every: int = 100, k: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors whose vec_id is divisible by ``every``."""
    rows = prepare(vectors)
    none = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    parts = [_mine_one(*build(rows.where(F.col("dim") == dim), dim, n), every, k) for dim, n in sorted(sizes.items())]
    return reduce(DataFrame.unionByName, parts) if parts else none
