"""One CSV file with quoted line breaks, read by several tasks, equals the read by one task."""

import csv
import random

import pytest
from pyspark.sql import types as T

from signalcheck.sources.csv_ranges import _lines, range_table, read_csv_ranges
from signalcheck.sources.posts import POST_SCHEMA, read_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("flag", T.BooleanType())])


def rows(n, seed=1):
    rng = random.Random(seed)
    parts = ["plain", "a,b", 'say "hi"', "two\nlines", "\n\n", "é世界", '"', "x" * 700, "", " edge "]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 6))) or None, rng.choice([True, False, None])) for i in range(n)]


def write(path, names, table):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator="\n")
        out.writerow(names)
        out.writerows(table)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_file_by_many_tasks(spark, tmp_path, small_ranges):
    data = rows(400)
    write(tmp_path / "a.csv", ["id", "text", "flag"], data)
    ranges = range_table(_lines(spark, str(tmp_path))).collect()
    assert len(ranges) > 20 and any(r.begins_inside for r in ranges)
    found = read_csv_ranges(spark, str(tmp_path), SCHEMA)
    assert sorted(tuple(r) for r in found.collect()) == data
    assert found.schema == SCHEMA


def test_a_value_over_many_ranges(spark, tmp_path, small_ranges):
    data = [(1, "before", True), (2, "line of text\n" * 3_000, False), (3, "after", None), (4, "again\n" * 2_000, None)]
    write(tmp_path / "a.csv", ["id", "text", "flag"], data)
    assert sorted(tuple(r) for r in read_csv_ranges(spark, str(tmp_path), SCHEMA).collect()) == data


def test_columns_by_name_per_file(spark, tmp_path):
    write(tmp_path / "a.csv", ["flag", "more", "id", "text"], [("true", "x", 1, "one\nline"), ("", "y", 2, 'q"q')])
    write(tmp_path / "b.csv", ["text", "id"], [("three", 3)])
    (tmp_path / "c.csv").write_bytes("﻿id,text,flag\r\n\r\n4,four,false\r\n".encode())
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("id,text,flag\n")
    found = read_csv_ranges(spark, str(tmp_path), SCHEMA).collect()
    assert sorted(tuple(r) for r in found) == [(1, "one\nline", True), (2, 'q"q', None), (3, "three", None), (4, "four", False)]


def test_same_as_the_scan_of_whole_files(spark, tmp_path, small_ranges):
    table = [[f"n{i}", f"u{i}", "2020", "true", f"post {i}\nsays, \"{i}\"", i, i, f"{i}K", i, "['#a']", "link", i, "d"] for i in range(300)]
    write(tmp_path / "a.csv", POST_SCHEMA.names, table)
    whole, split = read_csv(spark, str(tmp_path)), read_csv_ranges(spark, str(tmp_path), POST_SCHEMA)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_csv_ranges(spark, str(tmp_path), SCHEMA).count() == 0
