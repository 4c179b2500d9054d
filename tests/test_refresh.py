from signalcheck.queries import QUERIES


def test_every_feature_name_is_refreshed(spark, folder):
    found = QUERIES["autoencoder_refresh"](spark, folder)
    assert {r[0] for r in found.select("feature_name").distinct().collect()} == {"bert", "dtm"}
