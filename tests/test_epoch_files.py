"""An epoch hands on a fixed number of sets of weights, and its shuffle files do not outlive it."""

import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from signalcheck.operators import autoencoder
from signalcheck.session import materialize


def frame(shares):
    rng = np.random.default_rng(2)
    return pd.DataFrame([(s, {"indices": None, "values": rng.random(6)}) for s in shares], columns=["share", "cells"])


def test_shares_of_a_task_are_averaged_by_their_rows():
    state = np.concatenate([autoencoder.initial_weights(6, 3, 1), np.zeros(2 * 45 + 1)]).astype(np.float32)
    train = autoencoder._epoch_trainer(SimpleNamespace(value=state), 6, 3, 4)
    rows = frame([0] * 10 + [3] * 5 + [7] * 9)
    (whole,) = train([rows.iloc[:7], rows.iloc[7:12], rows.iloc[12:]])
    weights = lambda out: np.concatenate([np.frombuffer(p, np.float32) for p in out["part"]])
    alone = [next(iter(train([part]))) for _, part in rows.groupby("share")]
    expected = np.average([weights(a) for a in alone], axis=0, weights=[10, 5, 9])
    np.testing.assert_allclose(weights(whole), expected, rtol=1e-5, atol=1e-7)
    assert whole["rows"].iloc[0] == 24
    np.testing.assert_allclose(whole["loss"].iloc[0], np.average([a["loss"].iloc[0] for a in alone], weights=[10, 5, 9]))


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(top.apply(i)) for i in range(top.size())}

    before = files()
    stored = materialize(spark.range(0, 20_000, 1, 4).groupBy(F.col("id") % 1_000).agg(F.count("*").alias("n")), "sums")
    assert stored.count() == 1_000
    left = {f for f in files() - before if os.path.basename(f).startswith("shuffle_") and f.endswith(".data") and os.path.getsize(f) > 1_000}
    assert not left
