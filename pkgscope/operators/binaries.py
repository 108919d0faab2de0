"""Files beside the source code: compiled modules without a source, indicators in binaries under a budget, path files and scripts.

A package's binaries are read in the order of their paths until a total is used up, each up to a limit; what is used before a file
comes from sizes alone, so no content is moved to find out. A module is an orphan if its package has no source file of the same stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exfiltration, files, scan

# Limits of a binary and of a package's binaries, the size of a script, suffixes, the pattern of downloaders.
MAX_BYTES, MAX_TOTAL, MAX_SCRIPT = 4 << 20, 24 << 20, 2_000_000
MODULES = (".so", ".pyd")
SOURCES = (".py", ".pyx", ".pxd", ".c", ".cc", ".cpp", ".cxx", ".h", ".rs", ".f", ".f90", ".go", ".zig", ".pyi")
SCRIPTS = (".sh", ".bash", ".bat", ".cmd", ".ps1", ".vbs", ".js")
DOWNLOADER = (
    r"(?i)\b(curl|wget)\b[^\n]{0,200}(\||&&|;|-o\b|-O\b)|Invoke-WebRequest|\biwr\b|"
    r"DownloadString|DownloadFile|certutil\b[^\n]{0,40}-urlcache|bitsadmin|mshta\b|"
    r"/dev/tcp/|\bnc\b[^\n]{0,20}-e\b|base64\s+(-d|--decode)|powershell[^\n]{0,40}-e(nc)?\b"
)
COLUMNS = ("bin_orphan_modules", "bin_compiled_init", "bin_net_indicators", "bin_url_count", "bin_exfil_refs", "bin_shell_cmd", "pth_code_lines", "script_downloader")


def stem(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.substring_index(files.file_name(path), ".", 1)


def orphans(listed: DataFrame) -> DataFrame:
    """package, path, stem of compiled modules whose package has no source file of the same stem anywhere."""
    named = listed.select("package", "path", stem(F.col("path")).alias("stem"), files.suffix(F.col("path")).alias("suffix"))
    held = named.where(F.col("suffix").isin(*SOURCES)).select("package", "stem").distinct()
    return named.where(F.col("suffix").isin(*MODULES)).join(held, ["package", "stem"], "left_anti").select("package", "path", "stem")


def within_budget(listed: DataFrame, limit: int = MAX_BYTES, total: int = MAX_TOTAL) -> DataFrame:
    """package, path of binaries (package, path, size) that are read: the bytes read of those before, by path, are under the total. The last may overshoot."""
    own = listed.where(files.suffix(F.col("path")).isin(*files.BINARY_SUFFIXES)).select("package", "path", F.least("size", F.lit(limit)).alias("read"))
    before = W.partitionBy("package").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    return own.withColumn("used", F.coalesce(F.sum("read").over(before), F.lit(0))).where(F.col("used") < total).select("package", "path")


def indicator_counts(content: Column) -> dict[str, Column]:
    """bin_net_indicators, bin_url_count, bin_exfil_refs and bin_shell_cmd of a binary's bytes."""
    found = scan.binary_indicators(content)
    text = scan.printable(content)
    every = "(?i)" + "|".join(p for group in exfiltration.PATHS.values() for p in group)
    return {
        "bin_net_indicators": found["n_hosts"] + found["n_tlds"] + found["n_ips"], "bin_url_count": found["n_urls"],
        "bin_exfil_refs": F.regexp_count(text, F.lit(every)).cast("long"), "bin_shell_cmd": F.regexp_count(text, F.lit(DOWNLOADER)).cast("long"),
    }


def path_file_lines(text: Column) -> Column:
    """Lines of a path file that run code when the interpreter starts."""
    return F.size(F.filter(F.split(text, scan.LINE_END), lambda s: s.rlike("^import[ \t]") | s.contains("exec("))).cast("long")


def other_files(table: DataFrame, limit: int = MAX_BYTES, total: int = MAX_TOTAL) -> DataFrame:
    """package and COLUMNS for every package of files (package, path, content); a null content is an empty file."""
    table = table.select("package", "path", F.coalesce("content", F.lit(b"")).alias("content"))
    listed = table.select("package", "path", F.octet_length("content").alias("size"))
    zero = F.lit(0).cast("long")
    alone = orphans(listed).select("package", F.lit(1).cast("long").alias("bin_orphan_modules"), (F.col("stem") == "__init__").cast("long").alias("bin_compiled_init"))
    read = table.join(within_budget(listed, limit, total), ["package", "path"], "left_semi").withColumn("content", F.substring("content", 1, limit))
    binary = read.select("package", *[c.alias(n) for n, c in indicator_counts(F.col("content")).items()])
    text, suffix = files.text_of(F.col("content"), 1 << 30), files.suffix(F.col("path"))
    script = suffix.isin(*SCRIPTS) & (F.octet_length("content") < MAX_SCRIPT) & ~F.col("path").rlike(files.BEHAVIOUR_TEST_PATH)
    lines = table.where((suffix == ".pth") | script).select(
        "package", F.when(suffix == ".pth", path_file_lines(text)).otherwise(zero).alias("pth_code_lines"), F.when(suffix != ".pth", text.rlike(DOWNLOADER).cast("long")).otherwise(zero).alias("script_downloader"),
    )
    every = table.select("package").distinct()
    parts = every.unionByName(alone, True).unionByName(binary, True).unionByName(lines, True)
    return parts.groupBy("package").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in COLUMNS])
