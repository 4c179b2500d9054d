"""Retrained classifiers read every term at a place of its own, however many terms there are."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from signalcheck.operators.features import used_terms
from signalcheck.operators.term_tree import fit_term_tree
from signalcheck.plans import feedback

RNG = np.random.default_rng(11)


def sparse_rows(spark, n, width, classes, most):
    """Counts whose labels follow some terms, with noise."""
    x = RNG.poisson(RNG.uniform(0.1, most, width), (n, width)) * (RNG.random((n, width)) < 0.5)
    label = ((x[:, 0] > 1).astype(int) + (x[:, 3] > x[:, 1])) % classes
    label = np.where(RNG.random(n) < 0.1, RNG.integers(0, classes, n), label)
    rows = [(i, SparseVector(width, v.nonzero()[0], v[v.nonzero()[0]].astype(float)), float(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, ["id", "features", "label"])


@pytest.mark.parametrize(("n", "classes", "most"), [(400, 2, 2.0), (500, 3, 60.0)])
def test_the_tree_is_sparks(spark, n, classes, most):
    rows = sparse_rows(spark, n, 30, classes, most).cache()
    own = fit_term_tree(rows, 4).transform(rows)
    plain = DecisionTreeClassifier(seed=42, maxDepth=4).fit(rows).transform(rows)
    both = own.select("id", F.col("prediction").alias("a")).join(plain.select("id", F.col("prediction").alias("b")), "id")
    assert both.count() == n and both.filter("a <> b").count() == 0


def test_terms_do_not_share_a_place(spark):
    """Each row is told by a term of its own, of more than a model's folded width."""
    n, per_row = 120, 50
    rows = [(i, "dtm", SparseVector(200_000, range(i * per_row, (i + 1) * per_row), [1.0] * per_row), i % 2) for i in range(n)]
    training = spark.createDataFrame(rows, ["id", "feature_name", "features", "label"])
    found = {r.model: r.accuracy for r in feedback.retrain_classifiers(training, "id", max_iter=3).collect()}
    assert found["svm"] == found["bayes"] == 1.0


def test_used_terms_keep_order_and_values(spark):
    rows = spark.createDataFrame([(1, SparseVector(100, [7, 90], [3.0, 2.0])), (2, SparseVector(100, [], [])), (3, SparseVector(100, [7, 50], [1.0, 4.0]))], ["id", "features"])
    found = {r.id: r.features.toArray().tolist() for r in used_terms(rows, "id").collect()}
    assert found == {1: [3.0, 0.0, 2.0], 2: [0.0, 0.0, 0.0], 3: [1.0, 4.0, 0.0]}
