"""Edit distance of names to a list of popular names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that walk through the tree of popular names together.
TOGETHER = 50_000


def most_frequent(names: DataFrame, n: int) -> DataFrame:
    """name: the n most frequent ones, equal counts by name."""
    return names.where("name is not null").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n).select("name")


def nearest(names: list[str], known: list[str], limit: int) -> np.ndarray:
    """Edit distance of each name to its nearest one of the sorted known names, limit + 1 where none is as near.

    The known names are walked as a tree of their prefixes. A node holds one row of the table of distances, limit cells to both sides
    of its diagonal, for those names that may still come nearer below it than they have come so far.
    """
    most, size = limit + 1, np.fromiter(map(len, names), np.int64, len(names))
    best = np.full(len(names), most, np.uint8)
    longest = max(map(len, known), default=0)
    able = np.flatnonzero(size <= longest + limit)
    if not known or not len(able):
        return best
    # Characters as small numbers, a place a row: 1 for those of no known name, 0 beside a name. Rows to both sides for the cells there.
    width = longest + limit
    letters = np.unique(np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), "<u4"))
    text = np.array([names[i] for i in able], f"<U{width}").view("<u4").reshape(len(able), width) if width else np.empty((len(able), 0), "<u4")
    at = np.searchsorted(letters, text)
    code = np.where(np.append(letters, 0)[at] == text, at + 2, 1) * (np.arange(width) < size[able][:, None])
    chars = np.zeros((width + 2 * limit + 1, len(able)), np.uint8 if len(letters) < 254 else np.uint32)
    chars[limit : limit + width] = code.T
    size, found = size[able], np.full(len(able), most, np.uint8)
    number = {chr(c): i + 2 for i, c in enumerate(letters.tolist())}
    cells = np.minimum(np.where(np.arange(-limit, limit + 1) < 0, most, np.arange(-limit, limit + 1)), most).astype(np.uint8)
    rows = [(np.arange(len(able)), np.repeat(cells[:, None], len(able), 1))]
    before = ""
    for word in known:
        same = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
        before = word
        del rows[same + 1 :]
        for i in range(len(rows), len(word) + 1):
            own, last = rows[-1]
            if not len(own):
                break
            row = last + (chars[i - 1 : i + 2 * limit].take(own, 1) != number[word[i - 1]])
            np.minimum(row[:-1], last[1:] + 1, out=row[:-1])
            if i <= limit:
                row[: limit - i], row[limit - i] = most, i
            for b in range(1, len(row)):
                np.minimum(row[b], row[b - 1] + 1, out=row[b])
            np.minimum(row, most, out=row)
            nearer = row.min(0) < found[own]
            rows.append((own, row) if nearer.all() else (own[nearer], row[:, nearer]))
        if len(rows) == len(word) + 1 and len(rows[-1][0]):
            own, row = rows[-1]
            cell = size[own] - len(word) + limit
            inside = np.flatnonzero((cell >= 0) & (cell <= 2 * limit))
            to = own[inside]
            found[to] = np.minimum(found[to], row[cell[inside], inside])
    best[able] = found
    return best


def distances(names: DataFrame, popular: DataFrame, limit: int = 3) -> DataFrame:
    """name, distance of each distinct lower-cased name to its nearest popular name; limit + 1 where none is as near.

    The popular names, a list, are sent to the driver and from there to each task.
    """
    own = names.select(F.lower("name").alias("name")).where("name is not null").distinct()
    known = sorted(r[0] for r in popular.select(F.lower("name").alias("known")).where("known is not null").distinct().collect())

    def run(batches):
        import pyarrow as pa

        def made(part: list[str]):
            return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(nearest(part, known, limit).astype(np.int32))], names=["name", "distance"])

        part: list[str] = []
        for batch in batches:
            part += batch.column("name").to_pylist()
            if len(part) >= TOGETHER:
                yield made(part)
                part = []
        if part:
            yield made(part)

    # A name takes far more work than bytes, so the number of tasks goes by the cores.
    return own.repartition(2 * names.sparkSession.sparkContext.defaultParallelism, "name").mapInArrow(run, "name string, distance int")
