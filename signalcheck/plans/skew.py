"""Join and ranking helpers that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalcheck.session import materialize

HOT_KEYS = 10_000
ROWS_PER_TASK = 2_000_000
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after a bounded count showed that it has at most ``max_rows`` rows.

    Beyond that the frame is returned as it is and Catalyst picks a shuffle join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(weights: DataFrame, key: str, weight: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows; at most ``HOT_KEYS`` rows, so safe to broadcast.

    When more keys than that are over the line, the ones left out still hold at most
    1/HOT_KEYS of all rows each, which one shuffle partition carries.
    """
    return (
        weights.filter(F.col(weight) > rows_per_task)
        .orderBy(F.desc(weight), key)
        .limit(HOT_KEYS)
        .select(key, F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int").alias("_salts"))
    )


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    weight: str,
    spread: Column,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    also: Sequence[str] = (),
) -> DataFrame:
    """Join ``fact`` to ``dim`` on ``key`` (and ``also``), with hot keys cut into several tasks.

    ``dim[weight]`` tells how many fact rows a key has. A hot key gets one salt per
    ``rows_per_task`` rows: its dim row is repeated once per salt and its fact rows are
    dealt over the salts by the hash of ``spread``. Other keys keep salt 0.
    """
    weights = dim.select(key, weight).distinct() if also else dim
    hot = F.broadcast(hot_keys(weights, key, weight, rows_per_task))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = fact.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    right = (
        dim.drop(weight)
        .join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [key, *also, "_salt"], how).drop("_salt")


def rows_without(rows: DataFrame, keys: DataFrame, key: str, weight: str) -> DataFrame:
    """Anti-join of ``rows`` with ``keys``; the heaviest keys leave before the shuffle.

    The first join drops the rows of at most ``HOT_KEYS`` keys map-side, so whatever
    is left to shuffle holds at most 1/HOT_KEYS of the rows under any one key.
    """
    heaviest = keys.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(key)
    return rows.join(F.broadcast(heaviest), key, "left_anti").join(keys.select(key), key, "left_anti")


def global_rank(values: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """0-based position of each distinct, non-null value in sort order, without a one-task window.

    Values are range-partitioned and written together with their partition number (which
    pins the cut points), ranked inside each partition, and shifted by the number of
    values in the partitions before it.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        values.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()), "ranked-values"
    )
    sizes = ranged.groupBy("_part").count()
    # One row per partition, so this window is as small as the partition list.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(column)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_part", "_offset")
    )
