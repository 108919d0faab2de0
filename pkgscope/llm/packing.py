"""Operator 8: best-fit packing, with a configuration linear program over the length histogram.

Documents are encoded whole, an end id is added, and only longer ones are cut into pieces of the
capacity. The driver sees the histogram of piece lengths, at most ``capacity`` rows at any corpus
size. Multiplicative weights with a knapsack dynamic program as pricing solve the configuration program
on every table and amounts are whole sequences. What is left of the demand (REST of the tokens) and the
smallest lengths (DUST of the pieces) is placed best-fit into the room that the configurations leave, then
into new sequences. Tokens over capacity, and the pieces of which no two fit, bound the number of
sequences from below; beyond a gap (0.1 %, or one sequence) other first prices are tried.
Pieces take their places by rank within their length; ranks are counted over salted cells, whose
number grows with the table, so no length needs a single task. Null texts count as empty (one end
id); equal lengths are dealt by salt, doc_id and piece; repeated rows are packed each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .encode import encoder

CAPACITY = 4096
CELL_ROWS = 100_000
ETA, STEP, TRIED, DUST, REST = 2.0, 0.5, 24, 0.04, 0.04
LONG = 0.25, 0.0, 1.0


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    from pyspark.sql.types import StructType

    made = StructType.fromDDL("doc_id long, piece int, start long, length long, ids_crc32 long")

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        end = np.array([end_id], "<u4")
        for batch in batches:
            at = 0
            for ids, ends in encoder(vocabulary).slices(batch.column("text")):
                ids, low = ids.astype("<u4", copy=False), 0
                of, piece, start, length, crc = [], [], [], [], []
                for i, high in enumerate(ends.tolist()):
                    own = np.concatenate([ids[low:high], end])
                    for k in range(0, len(own), capacity):
                        part = own[k : k + capacity]
                        of.append(at + i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                    low = high
                at += len(ends)
                columns = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of, pa.int64())), *columns], names=made.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, made)


def _best_pattern(sizes: list[int], prices: list[float], most: list[int], capacity: int, tight: float = 0.1) -> dict[int, int]:
    """Bounded knapsack: {item: times} of most value that fits; one that fills the capacity is taken if it is worth as much but for a share ``tight``."""
    import numpy as np

    items = []
    for i, k in enumerate(most):
        step = 1
        while k > 0:
            items.append((i, min(step, k)))
            k -= step
            step *= 2
    best, took = np.full(capacity + 1, -np.inf), np.zeros((len(items), capacity + 1), bool)
    best[0] = 0
    for j, (i, k) in enumerate(items):
        size = sizes[i] * k
        gain = best[: max(0, capacity + 1 - size)] + prices[i] * k
        np.greater(gain, best[size:], out=took[j, size:])
        np.maximum(gain, best[size:], out=best[size:])
    c = int(best.argmax())
    if best[capacity] >= (1 - tight) * best[c]:
        c = capacity
    pattern: dict[int, int] = {}
    for j in range(len(items) - 1, -1, -1):
        if took[j, c]:
            i, k = items[j]
            pattern[i] = pattern.get(i, 0) + k
            c -= sizes[i] * k
    return pattern


def _sequences(plan: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in plan)


def plan_configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None, gap: float = 0.001) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences) pairs that hold exactly the histogram.

    The program runs from the first prices of LONG, and from its others while the shortest plan is not within the gap of the bound.
    """
    left = {w: n for w, n in histogram.items() if n}
    full = [({capacity: 1}, left.pop(capacity))] if left.get(capacity) else []
    rounds = len(left) * 8 + 100 if rounds is None else rounds
    bound = max(-(-sum(w * n for w, n in left.items()) // capacity), sum(n for w, n in left.items() if 2 * w > capacity))
    plan = None
    for long in LONG:
        placed, rest = solve_configurations(left, capacity, rounds, long), dict(left)
        for config, times in placed:
            for w, k in config.items():
                rest[w] -= k * times
        plan = min(filter(None, (plan, _best_fit(rest, capacity, placed))), key=_sequences, default=[])
        if _sequences(plan) <= bound + max(1, gap * bound):
            break
    return full + plan


def solve_configurations(need: dict[int, int], capacity: int, rounds: int, long: float = LONG[0]) -> list[tuple[dict[int, int], int]]:
    """The configuration program by multiplicative weights, in whole sequences.

    A length's first price is its size, with ``long`` x the capacity added where two of it do not fit (half of that where
    two just fit); it is multiplied by exp(-ETA x the share of its demand that is covered). Each round
    prices a configuration by knapsack, over all lengths where they are at most TRIED, else over TRIED of
    them (the least covered, fillers, and a spread of all), and takes it as often as covers at most
    a share STEP of any length's demand. The program ends when no more than REST of the tokens is left,
    or after so many rounds. Where lengths are more than TRIED, the smallest, no more than DUST of the
    pieces, are set aside: they fill what the configurations leave free.
    """
    import numpy as np

    rng, total, pieces = np.random.default_rng(0), sum(w * n for w, n in need.items()), sum(need.values())
    aside, seen = set(), 0
    for w in sorted(need) if len(need) > TRIED else ():
        seen += need[w]
        if seen > DUST * pieces or w > capacity // 8:
            break
        aside.add(w)
    lengths = np.array(sorted(w for w in need if w not in aside and need[w] > 0), np.int64)
    demand = np.array([need[w] for w in lengths.tolist()], np.int64)
    worth = lengths + long * capacity * (1 + np.sign(2 * lengths - capacity)) / 2
    open_, left, plan, third = demand.copy(), int((lengths * demand).sum()), [], TRIED // 3

    def spread(of):
        return of[((np.arange(third) + rng.random(third)) * len(of) / third).astype(int)]

    for _ in range(rounds):
        live = np.flatnonzero(open_)
        if not len(live) or left <= REST * total:
            break
        tried = live
        if len(live) > TRIED:
            covered = 1 - open_[live] / demand[live]
            least = live[covered <= np.partition(covered, third)[third]]
            fillers = live[: max(third, int(np.searchsorted(lengths[live], capacity // 8)))]
            tried = np.unique(np.concatenate([spread(least), spread(live), spread(fillers)]))
        tried = tried[::-1]
        prices = worth[tried] * np.exp(-ETA * (1 - open_[tried] / demand[tried]))
        most = np.minimum(open_[tried], capacity // lengths[tried])
        pattern = _best_pattern(lengths[tried].tolist(), prices.tolist(), most.tolist(), capacity)
        at, k = tried[list(pattern)], np.array(list(pattern.values()))
        times = min(int((open_[at] // k).min()), max(1, int(STEP * (demand[at] / k).min())))
        open_[at] -= k * times
        left -= int((lengths[at] * k).sum()) * times
        plan.append((dict(zip(lengths[at].tolist(), k.tolist())), times))
    return plan


def _best_fit(left: dict[int, int], capacity: int, placed: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit by falling length on counts, into the room of placed sequences and new ones: bins that hold the same lengths move together."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    frees: list[int] = []
    import bisect

    def put(free: int, config: dict[int, int], n: int) -> None:
        if free not in groups:
            groups[free] = []
            bisect.insort(frees, free)
        groups[free].append((config, n))

    for config, times in placed:
        put(capacity - sum(w * k for w, k in config.items()), config, times)
    for w in sorted((w for w, n in left.items() if n > 0), reverse=True):
        n = left[w]
        while n:
            at = bisect.bisect_left(frees, w)
            if at < len(frees):
                free = frees[at]
                config, bins = groups[free].pop()
                if not groups[free]:
                    del groups[free], frees[at]
            else:
                free, config, bins = capacity, {}, max(1, n // (capacity // w))
            each = min(free // w, n)
            used = min(bins, n // each)
            if used < bins and config:
                put(free, config, bins - used)
            put(free - each * w, {**config, w: config.get(w, 0) + each}, used)
            n -= each * used
    return [x for same in groups.values() for x in same]


def place_table(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, each, first_sequence, first_offset) rows."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for w in sorted(config, reverse=True):
            k, at = config[w], rank.get(w, 0)
            rows.append((w, at, at + k * times, k, sequence, offset))
            rank[w] = at + k * times
            offset += k * w
        sequence += times
    return rows


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, start, length, ids_crc32."""
    spark = cut_pieces.sparkSession
    stored = cut(cut_pieces)
    salts = max(64, -(-stored.count() // CELL_ROWS))
    salted = stored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        place_table(plan_configurations(histogram, capacity)),
        "length long, rank_from long, rank_to long, each long, first_sequence long, first_offset long",
    )
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("r", rank).join(cells, ["length", "salt"]).withColumn("r", F.col("base") + F.col("r") - 1)
    inside = [ranked["length"] == places["length"], F.col("r") >= F.col("rank_from"), F.col("r") < F.col("rank_to")]
    step = F.col("r") - F.col("rank_from")
    return ranked.join(F.broadcast(places), inside).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (step % F.col("each")) * ranked["length"]).cast("long").alias("offset"),
    )
