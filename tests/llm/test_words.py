"""Words of decontamination: the same as before, by a class that the JVM looks up in one table."""

import re
import time

from pyspark.sql import functions as F

from pkgscope.llm import decontaminate


def test_words_of_decontamination_by_one_table(spark):
    every = "".join(f"a{chr(c)}B" for c in range(1, 0x250)) + "ÉÀ中\U0001f600x"
    low = re.sub("[A-Z]", lambda m: m[0].lower(), every)
    table = spark.createDataFrame([(every,), (None,), ("",)], "text string")
    assert [r[0] for r in table.select(decontaminate.words()).collect()] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), [], []]
    long = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit(every), 20).alias("text")).cache()
    long.count()

    def seconds(column):
        begin = time.time()
        long.select(F.sum(F.size(column))).collect()
        return time.time() - begin

    seconds(decontaminate.words())
    ranges = F.regexp_extract_all(F.translate("text", decontaminate.UPPER, decontaminate.LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    assert min(seconds(decontaminate.words()) for _ in range(2)) < 0.8 * seconds(ranges)
