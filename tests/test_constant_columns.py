from signalcheck.operators.profile import correlation_matrix


def test_constant_and_empty_columns_have_no_correlation(spark):
    rows = [("u", 1.0, 5.0, None, 2.0), ("u", 2.0, 5.0, None, 4.0), ("v", 3.0, 5.0, None, 6.5)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, d double")
    found = {(r.x, r.y): r["corr"] for r in correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert round(found["a", "d"], 3) == 0.998 and found["a", "a"] == 1.0
    assert all(found[p] is None for p in (("a", "b"), ("b", "b"), ("a", "c"), ("c", "c"), ("b", "c")))
    assert correlation_matrix(df, ["a", "b"], by="k").count() == 8
