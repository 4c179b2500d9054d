"""Helpers shared by the operators: appending columns batch by batch, bounded training samples, FTRL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CACHE_ENTRIES = 600_000
LONGEST_KEY = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append_columns(
    df: DataFrame, inputs: Sequence[str], outputs: str, compute: Callable[..., list], keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` with the columns of the DDL ``outputs``, worked out per Arrow batch without a shuffle.

    ``compute`` gets one Python list per input column and returns one list per output column.
    Existing columns with the same names are replaced. ``keep`` limits what is handed back.
    """
    added = T.StructType.fromDDL(outputs)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    source = df.select(*dict.fromkeys([*kept, *inputs]))
    schema = T.StructType([source.schema[c] for c in kept] + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            results = compute(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(v, type=arrow.field(f.name).type) for v, f in zip(results, added.fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


class Bounded(dict):
    """A word memory that is emptied when full; ``make`` fills a missing entry.

    Longer keys than LONGEST_KEY are worked out anew each time, so entries bound the memory in bytes too.
    """

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.make(key)
        return value


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, y) outside the held-out fold, picked by hash.

    The picked ids are bounded by ``rows``, so they are broadcast and only their texts leave the scan.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def held_out_column(folds: int, held_out: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out, F.lit(False))


def fit_in_one_task(sample: DataFrame, fit: Callable) -> np.ndarray:
    """Run ``fit(texts, y) -> weights`` in one executor task over a bounded sample."""

    def train(frame):
        import pandas as pd

        frame = frame.sort_values(["doc_id", "text"])
        order = np.random.default_rng(7).permutation(len(frame))
        weights = fit([frame["text"].iloc[i] for i in order], frame["y"].to_numpy(float)[order])
        return pd.DataFrame({"weights": [weights.astype(np.float64).tobytes()]})

    found = sample.groupBy(F.lit(0).alias("g")).applyInPandas(train, "weights binary").collect()
    return np.frombuffer(bytes(found[0][0])) if found else np.zeros(0)


def ftrl(
    features: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int,
    alpha: float = 0.3, l1: float = 0.2, l2: float = 0.5, passes: int = 3,
) -> np.ndarray:
    """Follow-the-regularised-leader logistic regression; the last weight is the intercept."""
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    for _ in range(passes):
        for at, x, target in zip(features, values, y, strict=True):
            at, x = np.append(at, dim), np.append(x, 1.0)
            zi, root = z[at], np.sqrt(n[at])
            w = -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((1 + root) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - target) * x
            z[at] += g - (np.sqrt(root**2 + g * g) - root) / alpha * w
            n[at] += g * g
    return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((1 + np.sqrt(n)) / alpha + l2)
