"""Operator 9: exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks. Query blocks meet candidate blocks tile by tile: int8 products give
inner products with the Cauchy-Schwarz bound of both rounding errors; candidates whose upper bound
reaches the tile's k-th lower bound are recomputed in double precision, and a tile's best k go to the
merge. Nearest is the largest inner product, ties to the smaller vec_id. A null id or vector, a zero
one and one holding null or non-finite components take no part; vectors meet those of their own
dimension only; rows of the query's own vec_id are left
out; repeated candidates are kept, a repeated query is asked once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096
QUERY_BLOCK = 512


def _valid(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _blocks(v: DataFrame, size: int, rows: int, prefix: str) -> DataFrame:
    """One row per block: dim, block number, ids and double vectors as bytes. Blocks hold about size rows."""
    n = max(1, -(-rows // size))

    def run(frame):
        import numpy as np
        import pandas as pd

        ids = frame["vec_id"].to_numpy(dtype="<i8")
        return pd.DataFrame({
            "dim": [frame["dim"].iloc[0]], f"{prefix}block": [frame["block"].iloc[0]], f"{prefix}ids": [ids.tobytes()],
            f"{prefix}vecs": [np.stack(frame["v"].to_numpy()).astype("<f8").tobytes()],
        })

    placed = v.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)))
    return placed.groupBy("dim", "block").applyInPandas(run, f"dim int, {prefix}block long, {prefix}ids binary, {prefix}vecs binary")


def quantise(x):
    """int8 codes (as floats wide enough that their products add up exactly), scale, norm and rounding-error norm of each row."""
    import numpy as np

    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(float).tiny
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - codes * scale[:, None], axis=1)
    wide = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return codes.astype(wide), scale, np.linalg.norm(x, axis=1), error


def tile_best(qid, q, cid, c, k: int):
    """(query_id, vec_id, score) of each query's best k in one tile."""
    import numpy as np

    qc, qs, qn, qe = quantise(q)
    cc, cs, cn, ce = quantise(c)
    near = (qc @ cc.T).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = (qe[:, None] * cn[None, :] + (qn + qe)[:, None] * ce[None, :]) * (1 + 1e-9) + 1e-12
    own = qid[:, None] == cid[None, :]
    low = np.where(own, -np.inf, near - slack)
    take = min(k, low.shape[1])
    floor = np.partition(low, low.shape[1] - take, axis=1)[:, low.shape[1] - take]
    out = []
    for i in range(len(qid)):
        at = np.flatnonzero((near[i] + slack[i] >= floor[i]) & ~own[i])
        # Summed from the first component to the last, so that a score does not depend on the block it was found in.
        score = np.cumsum(c[at] * q[i], axis=1)[:, -1]
        best = at[np.lexsort((cid[at], -score))[:k]] if len(at) else at
        scores = dict(zip(at.tolist(), score.tolist()))
        out += [(int(qid[i]), int(cid[j]), scores[int(j)]) for j in best]
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by ``every``."""
    valid = _valid(vectors)
    queries = valid.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    n, nq = valid.count(), queries.count()
    cands = _blocks(valid, BLOCK, n, "c")
    nb = max(1, -(-nq // QUERY_BLOCK))
    asked = _blocks(queries, QUERY_BLOCK, nq, "q")
    # Every candidate block meets every query block of its dimension: blocks, not rows, are repeated.
    tiles = cands.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)).cast("array<long>"))).repartition("cblock", "qblock").join(asked, ["dim", "qblock"])

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples():
                q = np.frombuffer(row.qvecs, "<f8").reshape(-1, row.dim)
                c = np.frombuffer(row.cvecs, "<f8").reshape(-1, row.dim)
                yield pd.DataFrame(tile_best(np.frombuffer(row.qids, "<i8"), q, np.frombuffer(row.cids, "<i8"), c, k), columns=["query_id", "vec_id", "score"])

    found = tiles.select("dim", "qids", "qvecs", "cids", "cvecs").mapInPandas(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
