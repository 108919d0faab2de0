"""Which files and turns are read: budgets beyond the first files, and the window of a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Files read whole, files looked at beyond them and the characters of those that match, analyses and turns of a chat.
CAP, MOST_FILES, MOST_TEXT = 400, 20_000, 256 << 20
ANALYSES, TURNS = 3, 8


def beyond_cap(files: DataFrame, package: str, order: list[Column], path: str, size: str, matches: str, cap: int = CAP, most: int = MOST_FILES, budget: int = MOST_TEXT) -> DataFrame:
    """The files past the first ``cap`` of their package that are read as well: matching ones among the next ``most`` by path, while those before use less than the budget.

    files needs names and sizes and whether a text matches, not the texts. The last file may overshoot.
    """
    first = F.row_number().over(W.partitionBy(package).orderBy(*order))
    rest = files.withColumn("_place", first).where(F.col("_place") > cap)
    by_path = W.partitionBy(package).orderBy(path)
    used = F.coalesce(F.sum(F.when(F.col(matches), F.col(size)).otherwise(0)).over(by_path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = rest.withColumn("_no", F.row_number().over(by_path)).withColumn("_used", used)
    return rest.where((F.col("_no") <= most) & (F.col("_used") < budget) & F.col(matches)).drop("_place", "_no", "_used")


def chat_context(turns: DataFrame, conversation: str, turn: str, role: str, text: str, analysis: Column) -> DataFrame:
    """conversation, part, turn, newest of what a chat's next answer is built on: its last analyses, then its last turns.

    The last TURNS turns are taken first, and of them those of a user or the assistant that say anything; an analysis is any turn that is one.
    """
    last = W.partitionBy(conversation).orderBy(F.desc(turn))
    shown = turns.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= TURNS).where(F.col(role).isin("user", "assistant") & (F.coalesce(F.col(text), F.lit("")) != ""))
    known = turns.where(analysis).withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= ANALYSES)
    pick = lambda df, part, newest: df.select(conversation, F.lit(part).alias("part"), turn, newest.alias("newest"))
    return pick(known, "analysis", F.col("_r") == 1).unionByName(pick(shown, "turn", F.lit(False)))
