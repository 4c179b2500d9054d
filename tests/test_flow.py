"""Resumable checking, its stream form, feedback and the whole run."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalcheck.operators import features, verify
from signalcheck.plans import feedback, pipeline
from signalcheck.sources import posts, verdicts
from signalcheck.streaming.verify_stream import verify_stream


def says_true(claims):
    return claims.select("claim", F.lit("True").alias("verdict"))


def test_second_run_appends_nothing(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id bigint, claim string")
    assert verdicts.read_verdicts(spark, path).count() == 0
    first = verify.incremental_verify(rows, "id", path, says_true)
    assert {r["id"]: r["verdict"] for r in first.collect()} == {1: "True", 2: "True", 3: "True", 4: None}
    assert verdicts.read_verdicts(spark, path).count() == 2
    seen = []

    def counting(claims):
        seen.append(claims.count())
        return says_true(claims)

    more = rows.union(spark.createDataFrame([(5, "c")], rows.schema))
    verify.incremental_verify(more, "id", path, counting)
    verify.incremental_verify(more, "id", path, counting)
    assert seen == [1]
    assert verdicts.read_verdicts(spark, path).count() == 3


def test_stream_checks_each_claim_once(spark, tmp_path):
    source, path = str(tmp_path / "claims"), str(tmp_path / "verdicts")
    schema = "claim string"
    spark.createDataFrame([("a",), ("b",)], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    for checkpoint in ("one", "two"):  # the second checkpoint replays everything
        verify_stream(stream(), path, str(tmp_path / checkpoint), says_true, available_now=True).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], schema).write.mode("append").parquet(source)
    verify_stream(stream(), path, str(tmp_path / "two"), says_true, available_now=True).awaitTermination()
    assert sorted(r["claim"] for r in verdicts.read_verdicts(spark, path).collect()) == ["a", "b", "c"]


def test_verdict_words(spark):
    said = ["Partially False, I think", " True\n", "It is Unclear", " maybe "]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r[0] for r in df.select(verify.normalize_verdict(F.col("s"))).collect()] == ["Partially False", "True", "Unclear", "maybe"]


def test_verdict_labels(spark):
    rows = spark.createDataFrame([(v,) for v in ("False", "Partially False", "True", "Partially True", "Unclear", "odd", None)], "verdict string")
    assert [r["label"] for r in feedback.label_verdicts(rows).collect()] == [1, 1, 0, 0, 0]


def feature_rows(spark):
    rows = [(i, "bert", [float(i % 2), 1.0 - i % 2, 0.1 * (i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, feature_name string, x array<double>")
    return df.select("id", "feature_name", array_to_vector("x").alias("features"))


def test_update_system(spark):
    claims = spark.createDataFrame([(i, f"claim {i}") for i in range(60)], "id bigint, claim string")
    said = spark.createDataFrame([(f"claim {i}", "False" if i % 2 else "True") for i in range(60)], "claim string, verdict string")
    result = feedback.update_system(said, claims, feature_rows(spark), "id", code=4, epochs=2)
    scores = {(r["feature_name"], r["model"]): r["accuracy"] for r in result["hybrid"].collect()}
    assert scores == {("bert", "tree"): 1.0, ("bert", "svm"): 1.0, ("bert", "bayes"): 1.0}
    assert result["autoenc"].count() == 30
    assert list(result["models"]) == ["bert"]


def test_update_needs_verified_posts(spark):
    claims = spark.createDataFrame([(1, "a")], "id bigint, claim string")
    said = spark.createDataFrame([("other", "True")], "claim string, verdict string")
    with pytest.raises(ValueError, match="no verified post"):
        feedback.update_system(said, claims, feature_rows(spark), "id")


def test_stored_features_replace_only_their_name(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = feature_rows(spark)
    features.store_suspect_features(rows, path)
    features.store_suspect_features(rows.limit(3).withColumn("feature_name", F.lit("dtm")), path)
    features.store_suspect_features(rows.limit(2).withColumn("feature_name", F.lit("dtm")), path)
    stored = spark.read.schema(rows.schema).parquet(path)
    assert {r["feature_name"]: r["count"] for r in stored.groupBy("feature_name").count().collect()} == {"bert": 60, "dtm": 2}


def test_csv_keeps_line_breaks_quotes_and_spaces(spark, tmp_path):
    rows = [(1, ' a "quoted"\nline, with comma '), (2, "plain")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    posts.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, posts.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == rows


def test_whole_run(spark, tmp_path):
    words = "flood water town rescue quake fire smoke road bridge people".split()
    rows = []
    for i in range(120):
        body = "comet zebra" if i == 77 else " ".join(words[(i * j) % 10] for j in range(1, 9))
        kind = ("Flood", "Quake")[i % 2]
        rows.append((f"N{i % 5}", f"u{i % 7}", None, i % 3 == 0, f"{body} {kind} http://x.y/{i}", i, 2 * i, f"{i}K", 10 * i, "#a", "l", i, kind))
    table = spark.createDataFrame(rows, posts.POST_SCHEMA)
    path = str(tmp_path / "posts")
    posts.write_csv(table, path)
    known = spark.createDataFrame([(1, "flood water town rescue quake fire smoke road bridge")], "item_id bigint, text string")
    config = pipeline.PipelineConfig(
        verdict_path=str(tmp_path / "verdicts"), data_source=path, evidence=known, encoding_dim=8, epochs=2, tfidf="idf"
    )
    result = pipeline.run_from_csv(spark, config)
    detectors = {r["detector"] for r in result["flags"].select("detector").distinct().collect()}
    assert detectors <= {f"{d}_{f}" for d in ("kmeans", "dbscan", "hybrid_dtsvmnb", "autoencoder") for f in ("tfidf", "dtm", "bert")}
    n = result["suspects"].count()
    assert 0 < n <= 120
    assert result["suspects"].filter("`Tweet ID` = 77").count() == 1
    checked = result["verification"]
    assert checked.count() == n
    assert checked.filter("verdict IS NULL").count() == 0
    assert result["suspect_features"].count() == 3 * n
    first = result["posts"].filter(F.col("`Tweet ID`") == 3).first()
    assert first["Likes"] == 3000.0
    assert "http" in first["Original Tweets"]
    assert "http" not in first["Tweets"]
