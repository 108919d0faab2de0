"""Vectors of files and packages: means in levels, nearest packages of each class by tiles, best file pairs.

Means add up each component in one aggregate a component, so a vector stays one row. Nearest packages come from tiles; file pairs are made
only inside the package pairs so found, of at most ``most`` files a side. Null vectors take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tiles
from .similarity import dot

SMALLEST_NORM = 1e-9


def mean_by(rows: DataFrame, keys: list[str], vector: str, width: int) -> DataFrame:
    """keys, n and the mean of the vectors of each group, component by component; vectors must have ``width`` components."""
    known = rows.where(F.col(vector).isNotNull())
    sums = known.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(width)])
    return sums.select(*keys, "n", F.array(*[F.col(f"_{i}") for i in range(width)]).alias(vector))


def unit(vector: str) -> Column:
    """The vector over its norm, which counts as 1e-9 at least, so that a zero vector stays zero."""
    norm = F.greatest(F.sqrt(dot(F.col(vector), F.col(vector))), F.lit(SMALLEST_NORM))
    return F.transform(vector, lambda x: x / norm)


def package_vectors(tokens: DataFrame, file: str, package: str, vector: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of files (package, file, n) and of packages (package, n): a file is the mean of its tokens, a package that of its files before they are scaled."""
    files = mean_by(tokens, [package, file], vector, width)
    packages = mean_by(files.drop("n"), [package], vector, width)
    return files.withColumn(vector, unit(vector)), packages.withColumn(vector, unit(vector))


def closest_by_side(index: DataFrame, queries: DataFrame, id_: str, vector: str, side: Column) -> DataFrame:
    """query_id, side, vec_id, score: each query's nearest other row on each side (true or false); equal scores: smallest id."""
    found = tiles.best(index, queries, 1, id_, vector, None, side)
    nearest = F.min(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("b")
    return found.groupBy("query_id", "side").agg(nearest).select("query_id", "side", F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def file_pairs(matches: DataFrame, files: DataFrame, package: str, file: str, vector: str, most: int = 10) -> DataFrame:
    """query_id, side, vec_id, query_file, known_file, similarity: the most similar pair of files of each package pair.

    Of a package the first ``most`` files by name count. Equal similarities to 12 decimals: smallest query file, then smallest known file.
    """
    first = files.where(F.col(vector).isNotNull()).withColumn("_place", F.row_number().over(W.partitionBy(package).orderBy(file))).where(F.col("_place") <= most)
    mine = first.select(F.col(package).alias("query_id"), F.col(file).alias("query_file"), F.col(vector).alias("_q"))
    known = first.select(F.col(package).alias("vec_id"), F.col(file).alias("known_file"), F.col(vector).alias("_k"))
    pairs = matches.select("query_id", "side", "vec_id").join(mine, "query_id").join(known, "vec_id")
    best = F.min(F.struct((-F.round(dot(F.col("_q"), F.col("_k")), 12)).alias("s"), "query_file", "known_file")).alias("b")
    return pairs.groupBy("query_id", "side", "vec_id").agg(best).select("query_id", "side", "vec_id", "b.query_file", "b.known_file", (-F.col("b.s")).alias("similarity"))
