"""Vectors over all terms, folding to the width of a model, and correlations and pair counts from task sums."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from signalcheck.operators import anomaly, features, profile
from signalcheck.plans import feedback


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    counts = features.term_counts(df, "id", "tokens")
    ids = features.term_ids(counts)
    return features.term_vectors(counts, ids, df, "id"), ids


def test_more_terms_than_a_driver_vocabulary(spark):
    rows = [(i, [f"w{i}x{j}" for j in range(5_000)] + ["common"] * (i + 1)) for i in range(60)]
    found, ids = vectors_of(spark, [*rows, (99, []), (100, None)])
    assert ids.count() == 300_001 > 1 << 18
    cells = features.named_cells(features.vector_cells(found, "id"), ids, "id")
    assert cells.count() == 60 * 5_001
    assert {(r.id, r._value) for r in cells.filter("term = 'common'").collect()} == {(i, i + 1.0) for i in range(60)}
    assert found.filter("id >= 99").select(F.size(F.unwrap_udt("features")["values"]).alias("n")).collect() == [(0,), (0,)]


def test_folding_keeps_every_count(spark):
    rows = [(i, [f"t{(i * j) % 97}x" for j in range(200)]) for i in range(20)]
    found, _ = vectors_of(spark, rows)
    folded = features.fold_vectors(found, "id", 8)
    totals = {r.id: sum(r.x) for r in folded.select("id", vector_to_array("features").alias("x")).collect()}
    assert totals == {i: 200.0 for i, _ in rows}
    same = feedback.at_model_width(found, "id", 97)
    assert same is found
    assert feedback.at_model_width(found.withColumn("label", F.lit(1)), "id", 16).columns == ["id", "label", "features"]


def test_a_rare_term_changes_a_score(spark):
    """Beyond 4,096 more frequent terms, a term still moves the distance of its document."""
    common = [f"c{j}x" for j in range(5_000)]

    def distances(times):
        found, _ = vectors_of(spark, [(i, common + [f"k{i % 4}x"] * (i % 4 + 1) + ["rare"] * times.get(i, 0)) for i in range(30)])
        scored = anomaly.kmeans_anomaly(features.fold_vectors(found, "id"), "id", 2, sparse=True)
        return {r.id: r.distance for r in scored.collect()}

    assert max(distances({}).values()) < 5
    assert max(distances({7: 300, 8: 400, 9: 900}).values()) > 20


def brute_correlation(a, b):
    both = ~np.isnan(a) & ~np.isnan(b)
    x, y = a[both], b[both]
    if len(x) == 0 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def test_correlations_and_pair_counts_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 4)) * [1, 1e-3, 1e6, 1] + [0, 5, 1e9, 0]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=3_000)
    x[rng.random(x.shape) < 0.2] = np.nan
    kinds = rng.choice(["p", "q", None], 3_000)
    names = list("abcd")
    rows = [(k, *(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r))) for k, r in zip(kinds.tolist(), x, strict=True)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    found = {(r.k, r.x, r.y): r["corr"] for r in profile.correlation_matrix(df, names, "k").collect()}
    assert len(found) == 3 * 16
    for (k, a, b), r in found.items():
        part = x[np.array([c == k for c in kinds])]
        assert r == pytest.approx(brute_correlation(part[:, names.index(a)], part[:, names.index(b)]), abs=1e-6)
    got = {(r.k, r.x, r.y, r.bin_x, r.bin_y): r.n for r in profile.pair_bins(df, names, 7, "k").collect()}
    low, high = np.nanmin(x, 0), np.nanmax(x, 0)
    place = np.minimum(np.floor((x - low) / ((high - low) / 7)), 6)
    want = Counter()
    for i, j in combinations(range(4), 2):
        for k, a, b in zip(kinds.tolist(), place[:, i], place[:, j], strict=True):
            if not np.isnan(a) and not np.isnan(b):
                want[k, names[i], names[j], int(a), int(b)] += 1
    assert got == want


def test_profile_of_endless_cells_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0), (2.0, 1.0)], "a double, b double")
    found = {(r.x, r.y): r["corr"] for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert found == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}
    assert profile.pair_bins(df.limit(0), ["a", "b"]).count() == 0
    assert profile.correlation_matrix(df.limit(0), ["a", "b"], "a").count() == 0
