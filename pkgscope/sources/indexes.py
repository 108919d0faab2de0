"""Indexes of packages: sample archives in two layouts, ranked project lists, acquisition indexes, advisories, job lists.

Lists of files come from Spark's binaryFile source without their content, and JSON from its JSON source with a
column for records that do not parse, which become rows of a table of rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise
from . import folders

BAD = "_corrupt_record"
UNKNOWN = "unknown"
INDEX = "package string, version string, label int, source string, pool string, intent_class string, reported string, path string"
ADVISORY = "id string, published string, modified string, affected array<struct<package: struct<name: string>, versions: array<string>>>"
JOB = "package string, version string, `set` string, label int"


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path (below root) and size of the files of a name pattern anywhere below root; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.substring_index(F.col("path"), root.split(":", 1)[-1].rstrip("/") + "/", -1)
    return found.select(below.alias("path"), F.col("length").alias("size"))


def samples(listed: DataFrame, classes: list[str], limit: int | None = None) -> DataFrame:
    """intent_class, package, version, path of sample archives (path), in the order of the classes and paths; the first ``limit`` if given.

    <class>/<package>/<version>/.../<file> has a version, <class>/<package>/<file> the version 'unknown'. Other places, and classes not named, are passed over.
    """
    parts = F.split("path", "/")
    rows = listed.withColumn("_p", parts).withColumn("_rank", F.array_position(F.array(*map(F.lit, classes)), F.col("_p")[0]))
    rows = rows.where((F.col("_rank") > 0) & (F.size("_p") >= 3))
    version = F.when(F.size("_p") > 3, F.col("_p")[2]).otherwise(UNKNOWN)
    rows = rows.select(F.col("_p")[0].alias("intent_class"), F.col("_p")[1].alias("package"), version.alias("version"), "path", "_rank")
    return (rows if limit is None else rows.orderBy("_rank", "path").limit(limit)).drop("_rank")


def ranked_projects(spark: SparkSession, path: str) -> DataFrame:
    """rank (from 1) and project of one JSON document {"rows": [{"project": ...}, ...]}; entries without a name keep their rank and go."""
    read = spark.read.schema("rows array<struct<project: string>>").option("multiLine", "true").json(path)
    return read.select(F.posexplode("rows").alias("at", "row")).select((F.col("at") + 1).alias("rank"), F.col("row.project").alias("project")).where("project is not null")


def load_index(spark: SparkSession, index: str, base: str, root: str, record: str = "meta.json") -> tuple[DataFrame, DataFrame]:
    """Rows of an acquisition index (INDEX and ``dir``), and its rejects (record, package): the index file, or the packages' own records if there are more of those.

    index: a JSON list, or absent while an acquisition runs. Records: <base>/<package>/<record>, one object each; Spark's readers pass over
    names that begin with a dot, so the record's name must not. dir: root/path, or base/package where a row has no path.
    """
    schema, options = f"{INDEX}, {BAD} string", {"multiLine": "true", "columnNameOfCorruptRecord": BAD}
    listed = folders.optional(spark, index, schema, "json", **options)
    held = folders.optional(spark, f"{base}/*/{record}", schema, "json", **options)
    on_disk = files(spark, base, record).count() if folders.exists(spark, f"{base}/*/{record}") else 0
    rows = held if on_disk > listed.where("package is not null").count() else listed
    place = F.when(F.col("path").isNotNull(), F.concat(F.lit(root + "/"), F.col("path"))).otherwise(F.concat(F.lit(base + "/"), F.col("package")))
    # Spark refuses a query that reads nothing but the column of bad records, so a second one is asked for.
    rejects = rows.where(F.col(BAD).isNotNull() & F.coalesce("package", BAD).isNotNull()).select(F.col(BAD).alias("record"), "package")
    return rows.where(F.col(BAD).isNull() & F.col("package").isNotNull()).drop(BAD).withColumn("dir", place), rejects


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """The advisories below a path, one JSON object a file; what does not parse has nulls only."""
    return spark.read.schema(ADVISORY).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def reported_day() -> Column:
    """The day an advisory was published, else modified; an empty text counts as absent, and no day is null."""
    return F.nullif(F.left(F.coalesce(F.nullif("published", F.lit("")), F.nullif("modified", F.lit(""))), F.lit(10)), F.lit(""))


def report_dates(rows: DataFrame) -> DataFrame:
    """name, reported: the earliest day of each normalised name among advisories; the first affected package is the advisory's name."""
    named = rows.select(normalise(F.try_element_at("affected", F.lit(1))["package"]["name"]).alias("name"), reported_day().alias("day"))
    return named.where("name is not null and day is not null").groupBy("name").agg(F.min("day").alias("reported"))


def recent_reports(rows: DataFrame, held: DataFrame, cutoff: str, order: str = "id") -> DataFrame:
    """name, version (null if none is listed), published: affected names of advisories published since the cutoff, each once, by the first advisory in order.

    held: a table with a column name of normalised names to leave out. The last listed version counts.
    """
    each = rows.where(F.col("published") >= cutoff).select(order, "published", F.posexplode("affected").alias("at", "a"))
    each = each.select(order, "published", "at", F.col("a.package.name").alias("name"), F.try_element_at("a.versions", F.lit(-1)).alias("version"))
    each = each.withColumn("_name", normalise(F.col("name"))).where("name is not null")
    new = each.join(held.select(F.col("name").alias("_name")).distinct(), "_name", "left_anti")
    first = F.row_number().over(W.partitionBy("_name").orderBy(order, "at"))
    return new.withColumn("_place", first).where("_place = 1").select("name", "version", "published")


def listed_names(listed: DataFrame) -> DataFrame:
    """name: the normalised names of the folders that advisories (path) lie in; hidden folders and files outside a folder name nothing."""
    parts = F.split("path", "/")
    return listed.where((F.size(parts) >= 2) & ~F.col("path").startswith(".")).select(normalise(parts[0]).alias("name")).distinct()


def jobs(reports: DataFrame, candidates: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """JOB rows to fetch: reported malware, benign candidates (name, set) of any version, and, where given, all that was stored before."""
    bad = reports.select(F.col("name").alias("package"), "version", F.lit("live-malware").alias("set"), F.lit(1).alias("label"))
    good = candidates.select(F.col("name").alias("package"), F.lit("").alias("version"), "set", F.lit(0).alias("label"))
    out = bad.unionByName(good)
    return out if stored is None else out.unionByName(stored.select("package", "version", "set", F.col("label").cast("int").alias("label")))
