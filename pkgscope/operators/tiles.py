"""Nearest vectors by products of blocks: queries and index are packed into blocks, and blocks, not rows, meet one another.

A tile of a block of queries and one of the index is one matrix product in an Arrow batch; of it only each query's best go on.
Rows are dealt to blocks by a number of their own, so equal ids or vectors spread. Null vectors take no part; rows of the query's own id are
left out. Scores are rounded to 12 decimals, so that equal vectors score alike in every tile; equal scores go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, INDEX_BLOCK = 512, 4096


def _blocks(rows: DataFrame, columns: dict[str, Column], size: int, prefix: str) -> tuple[DataFrame, int]:
    """One row a block of about size rows: ids, labels, sides and vectors as bytes; and the number of blocks."""
    import pandas as pd

    n = max(1, -(-rows.count() // size))
    kinds = {"id": "<i8", "label": "<i8", "side": "u1"}

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = {f"{prefix}block": [frame["_block"].iloc[0]]} | {f"{prefix}{c}": [frame[c].to_numpy(k).tobytes()] for c, k in kinds.items()}
        return pd.DataFrame(out | {f"{prefix}vec": [np.stack(frame["vec"].to_numpy()).astype("<f8").tobytes()]})

    dealt = rows.select(*[c.alias(n) for n, c in columns.items()], F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("_block"))
    return dealt.groupBy("_block").applyInPandas(pack, f"{prefix}block long, " + ", ".join(f"{prefix}{c} binary" for c in [*kinds, "vec"])), n


def best(index: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", label: str | None = "label", side: Column | None = None) -> DataFrame:
    """query_id, vec_id, label, side, score: of each tile every query's best k on each side (one, where none is given). A query's best k overall are among them."""
    import pandas as pd

    def columns(labelled: bool) -> dict[str, Column]:
        mark = F.col(label).cast("long") if label and labelled else F.lit(0).cast("long")
        return {"id": F.col(id_).cast("long"), "label": mark, "side": (side if side is not None and labelled else F.lit(False)).cast("int"), "vec": F.col(vector).cast("array<double>")}

    known = index.where(F.col(vector).isNotNull() & (side.isNotNull() if side is not None else F.lit(True)))
    held, _ = _blocks(known, columns(True), INDEX_BLOCK, "c")
    asked, nq = _blocks(queries.where(F.col(vector).isNotNull()), columns(False), QUERY_BLOCK, "q")
    met = held.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<long>"))).join(asked, "qblock")

    def run(batches):
        import numpy as np

        for batch in batches:
            for t in batch.itertuples():
                qid, cid = np.frombuffer(t.qid, "<i8"), np.frombuffer(t.cid, "<i8")
                labels, sides = np.frombuffer(t.clabel, "<i8"), np.frombuffer(t.cside, "u1")
                q, c = np.frombuffer(t.qvec, "<f8").reshape(len(qid), -1), np.frombuffer(t.cvec, "<f8").reshape(len(cid), -1)
                score = np.round(q @ c.T, 12)
                score[qid[:, None] == cid[None, :]] = -np.inf
                order = np.argsort(cid, kind="stable")
                for s in (0, 1):
                    at = order[sides[order] == s]
                    if not len(at):
                        continue
                    # Sorted by falling score with ids in order before it, so that ties keep the smallest.
                    top = np.argsort(-score[:, at], axis=1, kind="stable")[:, :k]
                    found = np.take_along_axis(score[:, at], top, axis=1)
                    row, place = np.nonzero(found > -np.inf)
                    pick = at[top[row, place]]
                    yield pd.DataFrame({"query_id": qid[row], "vec_id": cid[pick], "label": labels[pick], "side": np.full(len(row), bool(s)), "score": found[row, place]})

    return met.select("qid", "qvec", "cid", "clabel", "cside", "cvec").mapInPandas(run, "query_id long, vec_id long, label long, side boolean, score double")
