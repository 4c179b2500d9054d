"""Reading posts: typed CSV scan, preview and schema report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalcheck.functions.columns import is_missing

# The columns of the post table, in file order.
POST_SCHEMA = T.StructType(
    [
        T.StructField("Name", T.StringType()),
        T.StructField("UserName", T.StringType()),
        T.StructField("Timestamp", T.StringType()),
        T.StructField("Verified", T.BooleanType()),
        T.StructField("Tweets", T.StringType()),
        T.StructField("Comments", T.LongType()),
        T.StructField("Retweets", T.LongType()),
        T.StructField("Likes", T.StringType()),
        T.StructField("Impressions", T.LongType()),
        T.StructField("Tags", T.StringType()),
        T.StructField("Tweet Link", T.StringType()),
        T.StructField("Tweet ID", T.LongType()),
        T.StructField("Disaster", T.StringType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = POST_SCHEMA) -> DataFrame:
    """Scan CSV with a header and a declared schema.

    Post text may hold line breaks, so ``multiLine`` is on and one file is one task;
    ``csv_ranges.read_csv_ranges`` cuts a large file into many.
    """
    # With a declared schema Spark checks header names only when enforceSchema is off.
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write CSV that ``read_csv`` reads back unchanged, spaces at the ends included."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows over all cores when a scan has fewer splits than that.

    Text work costs far more than moving a small file; a large table has enough splits
    of its own and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key``; Spark rows have no position of their own."""
    return df.orderBy(key).limit(n)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: name, filled cells (neither NULL nor NaN), type. One aggregate over the table."""
    counts = df.agg(*[F.count_if(~is_missing(F.col(f"`{c}`"), kind)).alias(c) for c, kind in df.dtypes])
    types = dict(df.dtypes)
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("non_null"), F.lit(types[c]).alias("dtype"))
        for c in df.columns
    ]
    return counts.select(F.inline(F.array(*cells)))
