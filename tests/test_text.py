"""Cleaning, tokens, stemming and number parsing on hand-made edge rows."""

import pytest
from pyspark.sql import functions as F

from signalcheck.functions import columns, scoring, text
from signalcheck.functions.porter import porter_stem

EDGE_ROWS = [
    (1, "Flood in TOWN http://a.b/c #help", "1.2K", "flood"),
    (2, "<b>Quake</b> felt, 5.1!", "3M", "quake"),
    (3, "", "50", "flood"),
    (4, None, None, None),
    (5, "   ", "1K2M", "fire"),
    (6, "a b", "7k", "fire"),
    (7, "Flood in TOWN http://a.b/c #help", "0", "flood"),
    (8, "x <a\nb> y", "12.5", "quake"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, "id bigint, text string, likes string, class string")


def by_id(df, column):
    return {r["id"]: r[column] for r in df.select("id", column).collect()}


def test_suffix_numbers(edge):
    got = by_id(edge.withColumn("n", columns.parse_suffix_number(F.col("likes"))), "n")
    assert got == {1: 1200.0, 2: 3e6, 3: 50.0, 4: None, 5: None, 6: None, 7: 0.0, 8: 12.5}


def test_clean_text(edge):
    got = by_id(edge.withColumn("c", text.clean_text(F.lower("text"))), "c")
    assert got[1] == "flood in town  help"
    assert got[2] == "quake felt 51"
    assert got[4] is None
    assert got[6] == "ab"
    assert got[8] == "x a\nb y"


def test_unicode_space_is_kept_on_request(edge):
    got = by_id(edge.withColumn("c", text.clean_text(F.col("text"), unicode_space=True)), "c")
    assert got[6] == "a b"


def test_lower_columns_reaches_into_arrays(spark):
    df = spark.createDataFrame([(["A", None, "bC"], 1)], "words array<string>, n int")
    assert text.lower_columns(df, ["words", "n"]).first() == (["a", None, "bc"], 1)


def test_tokens_lemmas_stop_words(spark):
    df = spark.createDataFrame([("the men  were running",)], "t string")
    words = text.tokenize(F.col("t"))
    assert df.select(text.lemmatize(words)).first()[0] == ["the", "man", "be", "running"]
    assert df.select(text.drop_stop_words(text.lemmatize(words))).first()[0] == ["man", "running"]
    assert df.select(text.stem_tokens(words)).first()[0] == ["the", "men", "were", "run"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"),
        ("ponies", "poni"),
        ("dies", "die"),
        ("cats", "cat"),
        ("feed", "feed"),
        ("agreed", "agre"),
        ("plastered", "plaster"),
        ("bled", "bled"),
        ("motoring", "motor"),
        ("conflated", "conflat"),
        ("sized", "size"),
        ("hopping", "hop"),
        ("falling", "fall"),
        ("filing", "file"),
        ("happy", "happi"),
        ("sky", "sky"),
        ("enjoy", "enjoy"),
        ("relational", "relat"),
        ("conditional", "condit"),
        ("vietnamization", "vietnam"),
        ("formality", "formal"),
        ("electrical", "electr"),
        ("hopefulness", "hope"),
        ("replacement", "replac"),
        ("adoption", "adopt"),
        ("effective", "effect"),
        ("probate", "probat"),
        ("rate", "rate"),
        ("controll", "control"),
        ("roll", "roll"),
        ("succeed", "succeed"),
        ("is", "is"),
        ("geologi", "geolog"),
    ],
)
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_blank_and_missing_text_scores(edge):
    scored = edge.withColumn("s", scoring.sentiment_by_words(F.col("text"))).withColumn("e", scoring.emotions_by_words(F.col("text")))
    got = by_id(scored, "s")
    assert [tuple(x) for x in got[3]] == [("neutral", 0.0)] == [tuple(x) for x in got[5]]
    assert got[4] is None
    assert [tuple(x) for x in by_id(scored, "e")[5]] == [("neutral", 0.0)]


def test_sentiment_and_emotion_words(spark):
    df = spark.createDataFrame([("Happy, happy but sad!",)], "t string")
    star = df.select(scoring.sentiment_by_words(F.col("t"))).first()[0][0]
    assert (star["label"], round(star["score"], 4)) == ("4 stars", 0.6667)
    feelings = df.select(scoring.emotions_by_words(F.col("t"))).first()[0]
    assert [(e["label"], round(e["score"], 4)) for e in feelings][:2] == [("joy", 0.6667), ("sadness", 0.3333)]
    assert len(feelings) == 6


def test_only_the_failing_row_becomes_an_error(edge):
    def make():
        def scorer(texts):
            if any("Quake" in t for t in texts):
                raise ValueError("cannot score")
            return [[{"label": "ok", "score": 1.0}] for _ in texts]

        return scorer

    got = by_id(scoring.score_with_model(edge, "text", "s", make), "s")
    labels = {i: s and s[0]["label"] for i, s in got.items()}
    assert labels == {1: "ok", 2: "error", 3: "neutral", 4: None, 5: "neutral", 6: "ok", 7: "ok", 8: "ok"}


def test_embedding_reads_the_whole_text(spark):
    long_text = "a " * 5_000
    df = spark.createDataFrame([(1, long_text + "tail"), (2, long_text + "other"), (3, "")], "id int, t string")
    got = by_id(scoring.embed(df, "t", "v", scoring.hashed_words_embedder(16)), "v")
    assert got[1] != got[2]
    assert len(got[1]) == 16
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5
    assert set(got[3]) == {0.0}


def test_category_codes_and_one_hot(edge):
    codes = by_id(columns.category_codes(edge.select("id", "class"), "class", "id", "code"), "code")
    assert codes == {1: 1, 2: 2, 3: 1, 4: -1, 5: 0, 6: 0, 7: 1, 8: 2}
    row = columns.one_hot(edge.select("id", "class"), "class").filter("id = 4").first().asDict()
    assert row == {"id": 4, "class": None, "Original_class": None, "class_fire": False, "class_flood": False, "class_quake": False}
    with pytest.raises(ValueError, match="more than 2"):
        columns.one_hot(edge, "class", max_classes=2)
