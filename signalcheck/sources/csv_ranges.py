"""CSV scan that splits one file with quoted line breaks over many tasks.

Spark cuts a file of plain lines into byte ranges. A first pass counts the quotes of each range; the parity of all quotes
before a range tells whether it begins inside a quoted value, so a second pass can put lines together to records range by
range. Only the pieces of records that cross a border between ranges, two per range, are shuffled.

Quotes inside a value are doubled, and a value with a quote stands in quotes, as ``write_csv`` and the usual CSV rules
have it; a quote that is never closed takes the rest of its file into one record. Records are parsed by ``from_csv`` with
the columns named by each file's own header: their order does not matter, columns that the schema does not name are left
out, and those a file lacks are NULL. Empty lines and empty files give no rows; header names hold no line breaks.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalcheck.session import materialize

#: More different headers than this in one scan are a sign of files without a header.
MAX_HEADERS = 100
_PIECE = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("record", pa.string())]
)
_PIECE_DDL = "file string, block long, seq long, first boolean, last boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))


def range_table(lines: DataFrame) -> DataFrame:
    """One row per byte range: the first line of a file, and whether the range begins or ends inside a quoted value."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # A range is read by one task in file order, so the first line it meets is the first of the range.
    ranges = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"), F.first(F.when(F.col("block") == 0, F.col("value"))).alias("header"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum("quotes").over(upto)
    return ranges.select(
        "file", "block", "header", ((ends - F.col("quotes")) % 2 == 1).alias("begins_inside"), (ends % 2 == 1).alias("ends_inside")
    )


class _Range:
    """The lines of one byte range on their way to records."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.odd, self.held, self.fresh, self.seq = inside, [], True, 0

    def add(self, values: pa.Array) -> list[str]:
        """Take lines in order; the records they finish."""
        after = (np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)) + self.odd) % 2 == 1
        before = np.concatenate([[self.odd], after[:-1]]).tolist()
        done = []
        for value, inside in zip(values.to_pylist(), before, strict=True):
            if not inside and not self.fresh:
                done.append("\n".join(self.held))
                self.held = []
            self.held.append(value)
            self.fresh = False
        self.odd = bool(after[-1])
        return done

    def rows(self, records: list[str], last: bool = False) -> pa.RecordBatch:
        seqs = range(self.seq, self.seq + len(records))
        self.seq += len(records)
        columns = [
            [self.file] * len(records), [self.block] * len(records), list(seqs), [self.inside and s == 0 for s in seqs],
            [last] * len(records), records,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)

    def close(self) -> pa.RecordBatch:
        return self.rows(["\n".join(self.held)], self.odd)


def _assemble(batches):
    """Records of each range in order; the first may end one of an earlier range, the last may be unfinished."""
    now = None
    for batch in batches:
        files, blocks = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if begin == end:
                continue
            file, block = files[begin].as_py(), int(blocks[begin])
            if now is None or (now.file, now.block) != (file, block):
                if now is not None:
                    yield now.close()
                now = _Range(file, block, batch.column(3)[begin].as_py())
            done = now.add(batch.column(0).slice(begin, end - begin))
            if done:
                yield now.rows(done)
    if now is not None:
        yield now.close()


def records(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, block, seq, record): every record of the files in its first range, header records included."""
    # One short row per byte range that a quoted value crosses: a millionth of the input at Spark's usual range size.
    crossed = F.broadcast(ranges.filter(F.col("begins_inside") | F.col("ends_inside")).select("file", "block", "begins_inside"))
    source = lines.join(crossed, ["file", "block"], "left")
    inside = F.coalesce("begins_inside", F.lit(False)).alias("inside")
    pieces = source.select("value", "file", "block", inside).mapInArrow(_assemble, _PIECE_DDL)
    whole = pieces.filter(~F.col("first") & ~F.col("last")).select("file", "block", "seq", "record")
    # A record over several ranges: the last piece of one, all of those inside it, and the first piece of the next.
    open_ = source.filter(F.col("begins_inside").isNotNull()).select("value", "file", "block", inside).mapInArrow(_assemble, _PIECE_DDL)
    open_ = open_.filter(F.col("first") | F.col("last"))
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(~F.col("first"), F.struct("block", "seq")), ignorenulls=True).over(order)
    joined = (
        open_.withColumn("owner", owner)
        .groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("block", "seq", "record"))).alias("parts"))
        .select("file", F.col("owner.block").alias("block"), F.col("owner.seq").alias("seq"), F.array_join("parts.record", "\n").alias("record"))
    )
    return whole.unionByName(joined)


def _parsed(record: Column, header: str, schema: T.StructType) -> Column:
    """The record as a struct of ``schema``, its values placed by the header's names."""
    types = {f.name: f.dataType for f in schema.fields}
    fields, seen = [], set()
    for place, name in enumerate(next(csv.reader([header.removeprefix("﻿").rstrip("\r")]), [])):
        known = name in types and name not in seen
        seen.add(name)
        fields.append(f"`{name}` {types[name].simpleString()}" if known else f"`_other{place}` string")
    row = F.from_csv(record, ", ".join(fields), {"escape": '"'})
    return F.struct(*((row.getField(f.name) if f.name in seen else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of the CSV files at ``path``, columns by header name, one file in as many tasks as it has ranges."""
    lines = _lines(spark, path)
    ranges = materialize(range_table(lines), "csv-ranges")
    headers = sorted(r[0] for r in ranges.filter(F.col("header").isNotNull()).select("header").distinct().limit(MAX_HEADERS + 1).collect())
    if not headers:
        return spark.createDataFrame([], schema)
    if len(headers) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different header lines below {path}")
    found = records(lines, ranges).filter((F.col("block") > 0) | (F.col("seq") > 0))
    record = F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    found = found.withColumn("record", record).filter(F.col("record") != "")
    if len(headers) == 1:
        row = _parsed(F.col("record"), headers[0], schema)
    else:
        of_file = ranges.filter(F.col("header").isNotNull()).select("file", "header")
        found, row = found.join(F.broadcast(of_file), "file"), F.lit(None)
        for header in headers:
            row = F.when(F.col("header") == header, _parsed(F.col("record"), header, schema)).otherwise(row)
    return found.select(row.alias("row")).select("row.*")
