"""Cleaning takes a time in proportion to its cheaper steps, and removes the characters that the pattern names."""

import re
import time

from pyspark.sql import functions as F

from signalcheck.functions import text


def test_special_characters_of_all_planes(spark):
    codes = [*range(0x0, 0xD800), *range(0xE000, 0x10000), *range(0x1F300, 0x1F700)]
    rows = ["a" + "".join(map(chr, codes[i : i + 500])) + "z" for i in range(0, len(codes), 500)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    found = {r.i: r.c for r in df.select("i", text.strip_specials(F.col("t")).alias("c")).collect()}
    assert found == {i: re.sub(text.SPECIAL_PATTERN, "", r, flags=re.ASCII) for i, r in enumerate(rows)}


def test_special_characters_are_no_slower_than_tags(spark):
    rows = spark.range(0, 64, 1, 8).select(F.repeat(F.lit("Überschwemmung in der Stadt, 12 Häuser (alt); "), 4_000).alias("t")).localCheckpoint()

    def seconds(column):
        start = time.time()
        rows.agg(F.sum(F.length(column))).first()
        return time.time() - start

    tags = min(seconds(text.strip_tags(F.col("t"))) for _ in range(3))
    assert min(seconds(text.strip_specials(F.col("t"))) for _ in range(3)) < 0.5 + 6 * tags
