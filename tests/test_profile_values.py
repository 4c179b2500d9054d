"""Missing cells, unlisted values, columns by type, reused autoencoders, and claims spread over tasks."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalcheck.functions.columns import numeric_columns
from signalcheck.operators import autoencoder, profile, verify
from signalcheck.sources import posts


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 1.0, None), (None, None, "y")], "a int, b double, c string")
    assert {r[0]: r[1] for r in profile.null_counts(df).collect()} == {"a": 1, "b": 2, "c": 1}
    assert {r[0]: r[1] for r in posts.schema_report(df).collect()} == {"a": 2, "b": 1, "c": 2}
    assert numeric_columns(df) == ["a", "b"]


def test_crosstab_counts_every_value(spark):
    df = spark.createDataFrame([("p", "F"), ("p", "X"), ("q", "O"), ("q", None), (None, "F"), ("p", "X")], "k string, v string")
    found = {r["k"]: r.asDict() for r in profile.crosstab(df, "k", "v").collect()}
    assert found == {
        "p": {"k": "p", "v_F": 1, "v_O": 0, "v_X": 2},
        "q": {"k": "q", "v_F": 0, "v_O": 1, "v_X": 0},
    }
    with pytest.raises(ValueError):
        profile.crosstab(df, "k", "v", most=2)


def test_reused_autoencoder_scales_as_it_was_trained(spark):
    rows = [(i, [i / 40, 1 - i / 40, 0.5 + i / 100]) for i in range(40)]
    frame = lambda r: spark.createDataFrame(r, "id bigint, x array<double>").select("id", array_to_vector("x").alias("features"))
    _, model = autoencoder.autoencoder_anomaly(frame(rows), "id", 3, code=4, epochs=3, partitions=1)
    error = lambda r: {x["id"]: x["error"] for x in autoencoder.autoencoder_anomaly(frame(r), "id", 3, model)[0].collect()}
    alone, crowd = error(rows[:1]), error([*rows, (99, [100.0, 100.0, 100.0])])
    assert alone[0] == pytest.approx(crowd[0])
    assert crowd[99] == max(crowd.values()) and crowd[99] > 1


def test_claims_are_spread_over_tasks(spark):
    claims = spark.range(300).select(F.concat(F.lit("river flood number "), F.col("id").cast("string")).alias("claim"))
    evidence = spark.createDataFrame([(1, "the river flood number seven")], "id bigint, body string")
    make = lambda: lambda prompts: ["True"] * len(prompts)
    found = verify.check_with_model(claims, evidence, "id", "body", make, parallelism=5)
    assert found.count() == 300
    assert found.groupBy(F.spark_partition_id()).count().count() == 5
