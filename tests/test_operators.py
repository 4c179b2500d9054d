"""Operators against brute force on small data, including forced wide and skewed paths."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalcheck.operators import anomaly, autoencoder, evidence, features, profile, vote
from signalcheck.operators.dbscan import dbscan_noise
from signalcheck.operators.quantile import exact_quantiles, flag_above_quantile
from signalcheck.plans.skew import broadcast_if_small, global_rank, lookup, rows_without

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def numbers(spark):
    heavy = np.concatenate([RNG.exponential(100, 600).round(1), np.full(400, 42.0), [1e9, -5.0]])
    return heavy, spark.createDataFrame([(i, float(v)) for i, v in enumerate(heavy)], "id bigint, v double")


@pytest.mark.parametrize("limits", [{}, {"max_distinct": 20, "accuracy": 20}])
def test_exact_quantiles(numbers, limits):
    values, df = numbers
    wanted = [0.0, 0.3, 0.95, 1.0]
    got = exact_quantiles(df, ["v"], wanted, **limits)["v"]
    assert np.allclose(got, np.percentile(values, [100 * p for p in wanted]), rtol=1e-12)


def test_quantile_between_two_brackets(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 50 + [2] * 50 + list(range(3, 40))], "v double")
    values = np.array([r[0] for r in df.collect()])
    for p in (0.36, 0.365, 0.5, 0.73):
        assert exact_quantiles(df, ["v"], [p], max_distinct=3, accuracy=10)["v"][0] == pytest.approx(np.percentile(values, 100 * p))


def test_quantiles_skip_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


def test_flag_is_strictly_above(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "id int, s double")
    assert flag_above_quantile(df, "s").filter("is_anomaly").count() == 0


def test_histogram_of_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    bins = {r["bin"]: r["n"] for r in profile.histogram(df, ["v"], bins=4).collect()}
    assert bins == {0: 2, 1: 0, 2: 0, 3: 0}


def test_lookup_with_hot_key_keeps_every_row(spark):
    fact = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    dim = fact.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = lookup(fact, dim, "k", "n", F.col("id"), rows_per_task=50)
    plain = fact.join(dim.drop("n"), "k")
    assert sorted(map(tuple, got.select("id", "k", "first").collect())) == sorted(map(tuple, plain.select("id", "k", "first").collect()))


def test_rows_without(spark):
    rows = spark.range(100).select("id", (F.col("id") % 10).alias("k"))
    keys = rows.filter("k < 4").groupBy("k").agg(F.count("*").alias("n"))
    assert rows_without(rows, keys, "k", "n").count() == 60


def test_broadcast_only_below_the_bound(spark):
    plan = spark.range(10).join(broadcast_if_small(spark.range(10), 5).hint("merge"), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan


def test_global_rank(spark):
    words = sorted({f"w{i * 37 % 1000:03d}" for i in range(500)})
    ranked = global_rank(spark.createDataFrame([(w,) for w in words[::-1]], "w string"), "w")
    assert [r["w"] for r in ranked.orderBy("rank").collect()] == words
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(len(words)))


def brute_noise(x, eps, m):
    gaps = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) <= eps
    core = gaps.sum(1) >= m
    return set(np.flatnonzero(~gaps[:, core].any(1)).tolist())


@pytest.mark.parametrize(("block", "pivots"), [(4096, None), (40, 6), (25, 1)])
def test_dbscan_against_brute_force(spark, block, pivots):
    clusters = [RNG.normal(c, 0.4, (60, 3)) for c in (0, 3, 6)]
    copies = np.tile([[9.0, 9.0, 9.0]], (80, 1))
    rare = np.array([[20.0, 0.0, 0.0]] * 3)
    x = np.concatenate([*clusters, copies, rare, RNG.uniform(-5, 12, (40, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>")
    got = {r["id"] for r in dbscan_noise(df, "id", "x", 0.7, 5, block=block, pivots=pivots).collect()}
    assert got == brute_noise(x, 0.7, 5)
    assert got & {260, 261, 262}


def test_count_noise_equals_density_noise(spark):
    bags = ["a b", "b a", "a b", "b a", "a b", "a a b", "c d", "c d"]
    rows = spark.createDataFrame([(i, [f"{w}{w}" for w in b.split()]) for i, b in enumerate(bags)], "id bigint, tokens array<string>")
    got = {r["id"] for r in anomaly.duplicate_noise(rows, "id", anomaly.bag_of_terms(F.col("tokens"))).collect()}
    vocabulary = "abcd"
    x = np.array([[float(b.split().count(w)) for w in vocabulary] for b in bags])
    assert got == brute_noise(x, 0.5, 5) == {5, 6, 7}


def test_sparse_and_dense_distances_agree(spark):
    rows = [(i, [f"t{(i * j) % 9}x" for j in range(1, 8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    found = features.term_counts(df, "id", "tokens")
    counts = features.term_vectors(found, features.term_ids(found), df, "id")
    sparse = {r["id"]: r["distance"] for r in anomaly.kmeans_anomaly(counts, "id", 3, sparse=True).collect()}
    dense = {r["id"]: r["distance"] for r in anomaly.kmeans_anomaly(counts, "id", 3).collect()}
    assert sparse.keys() == dense.keys()
    assert all(abs(sparse[i] - dense[i]) < 1e-6 for i in dense)


def test_kmeans_flags_the_planted_outlier(spark):
    x = np.concatenate([RNG.normal(0, 0.1, (60, 4)), RNG.normal(5, 0.1, (60, 4)), [[2.5, 9.0, -4.0, 1.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    flags = anomaly.kmeans_anomaly(df.select("id", array_to_vector("x").alias("features")), "id", 2)
    flagged = {r["id"] for r in flags.filter("is_anomaly").collect()}
    assert 120 in flagged
    assert len(flagged) <= 0.05 * 121 + 1


def test_union_holds_every_part(spark):
    a = spark.createDataFrame([(1, True), (2, False)], "id bigint, is_anomaly boolean")
    b = spark.createDataFrame([(1,), (3,)], "id bigint")
    got = {r["id"]: (r["detectors"], r["n_detectors"]) for r in anomaly.union_suspects(anomaly.union_flags({"b": b, "a": a}, "id"), "id").collect()}
    assert got == {1: ("a,b", 2), 3: ("b", 1)}


@pytest.mark.parametrize("partitions", [1, 3])
def test_autoencoder_learns_and_finds_the_odd_row(spark, partitions):
    base = RNG.uniform(0, 1, (300, 1))
    x = np.clip(np.concatenate([base, 1 - base, base, 1 - base], axis=1) + RNG.normal(0, 0.01, (300, 4)), 0, 1)
    x = np.concatenate([x, [[1.0, 1.0, 0.0, 0.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    df = df.select("id", array_to_vector("x").alias("features"))
    flags, model = autoencoder.autoencoder_anomaly(df, "id", 4, code=16, epochs=12, partitions=partitions)
    assert model.losses[-1] < model.losses[0]
    assert {r["id"] for r in flags.filter("is_anomaly").collect()} >= {300}
    again, same = autoencoder.autoencoder_anomaly(df, "id", 4, model)
    assert same is model
    assert again.count() == 301


def test_autoencoder_gradient():
    x, theta = RNG.uniform(0, 1, (5, 3)), autoencoder.initial_weights(3, 4, 1)
    _, slope = autoencoder._gradient(x, theta, 3, 4)
    for i in range(0, theta.size, 5):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up, down = (autoencoder._gradient(x, theta + s, 3, 4)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-8)


def test_split_does_not_depend_on_partitions(spark):
    one = vote.train_test_split(spark.range(0, 2000, 1, 1), "id").filter("is_test")
    many = vote.train_test_split(spark.range(0, 2000, 1, 8), "id").filter("is_test")
    ids = {r["id"] for r in one.collect()}
    assert ids == {r["id"] for r in many.collect()}
    assert 330 < len(ids) < 470


def test_vote_doubts_the_wrong_label(spark):
    rows = []
    for i in range(240):
        side = i % 2
        noise = RNG.uniform(0, 0.3, 2)
        rows.append((i, [float(side + noise[0]), float(1 - side + noise[1])], "ab"[side]))
    held = [r["id"] for r in vote.train_test_split(spark.range(240), "id").filter("is_test").collect()]
    wrong = held[0]
    rows[wrong] = (wrong, rows[wrong][1], "ba"[wrong % 2])
    df = spark.createDataFrame(rows, "id bigint, x array<double>, label_text string")
    scores = vote.vote_scores(df.select("id", array_to_vector("x").alias("features"), "label_text"), "id").collect()
    assert {r["id"] for r in scores} == set(held)
    assert max(scores, key=lambda r: r["score"])["id"] == wrong


def brute_evidence(claims, texts, k, share):
    found = set()
    for claim in set(claims):
        terms = set(claim.split())
        need = max(1, int(np.ceil(len(terms) * share - 1e-9)))
        hits = [(-len(terms & set(t.split())), i) for i, t in texts if len(terms & set(t.split())) >= need]
        found |= {(claim, i, -n, place) for place, (n, i) in enumerate(sorted(hits)[:k], 1)}
    return found


@pytest.mark.parametrize("share", [0.2, 0.5, 1.0])
def test_evidence_against_brute_force(spark, share):
    vocabulary = [f"w{i}q" for i in range(40)]
    weights = 1 / np.arange(1, 41)
    pick = lambda n: " ".join(RNG.choice(vocabulary, n, p=weights / weights.sum()))
    claims = [pick(n) for n in RNG.integers(1, 12, 30)] + ["nothing known here"]
    texts = [(i, pick(n)) for i, n in enumerate(RNG.integers(1, 30, 60))]
    got = evidence.rank_evidence(
        spark.createDataFrame([(c,) for c in claims * 2], "claim string"),
        spark.createDataFrame(texts, "id int, body string"),
        "id",
        "body",
        min_share=share,
        stop_words=["the"],
    )
    assert {(r["claim"], r["id"], r["shared"], r["rank"]) for r in got.collect()} == brute_evidence(claims, texts, 3, share)


def test_evidence_blocks_of_common_terms(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PAIR_BLOCK", 4)
    claims = [f"shared c{i}" for i in range(30)]
    texts = [(i, f"shared t{i}") for i in range(20)]
    got = evidence.rank_evidence(
        spark.createDataFrame([(c,) for c in claims], "claim string"), spark.createDataFrame(texts, "id int, body string"), "id", "body", k=50
    )
    assert got.count() == 600


def test_result_blocks_by_class(spark):
    html = '<ul><li class="x b_algo y">One &amp; <b>two</b></li><li class="other">no</li><li class="b_algo">three\nfour</li></ul>'
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(evidence.result_blocks(F.col("h"), css_class="b_algo")).first()[0] == "One & two three\nfour"
