"""The whole run: preprocess, build features, detect, unite, keep suspect features, verify."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.functions import columns, scoring, text
from signalcheck.operators import anomaly, features
from signalcheck.operators.autoencoder import ENCODING_DIM, EPOCHS, autoencoder_anomaly, vector_width
from signalcheck.operators.dbscan import EPS, MIN_SAMPLES, dbscan_noise
from signalcheck.operators.verify import Check, check_by_overlap, incremental_verify
from signalcheck.operators.vote import vote_anomaly
from signalcheck.session import materialize
from signalcheck.sources.csv_ranges import read_csv_ranges
from signalcheck.sources.posts import POST_SCHEMA


@dataclass
class PipelineConfig:
    """Column names of the post table and the parts a user may swap."""

    verdict_path: str
    data_source: str | None = None
    key: str = "Tweet ID"
    text: str = "Tweets"
    label: str = "Disaster"
    likes: str | None = "Likes"
    # Columns made lower case, and columns cleaned.
    lower: tuple[str, ...] = ("Name", "UserName", "Tweets", "Tags", "Tweet Link", "Disaster")
    clean: tuple[str, ...] = ("Name", "UserName", "Tweets", "Tags", "Disaster")
    make_embedder: Callable[[], scoring.Embedder] = field(default_factory=scoring.hashed_words_embedder)
    make_sentiment: Callable[[], scoring.Scorer] | None = None
    make_emotions: Callable[[], scoring.Scorer] | None = None
    # ``counts`` gives the "tfidf" detectors plain counts, ``idf`` weights them.
    tfidf: str = "counts"
    clusters: int = anomaly.CLUSTERS
    eps: float = EPS
    min_samples: int = MIN_SAMPLES
    quantile: float = anomaly.QUANTILE
    encoding_dim: int = ENCODING_DIM
    epochs: int = EPOCHS
    # Places of the vectors that models read; term vectors hold every term and are folded to this width.
    model_width: int = features.MODEL_WIDTH
    # Where the feature rows of the suspects are kept, by feature name; None keeps them for this run only.
    feature_path: str | None = None
    evidence: DataFrame | None = None
    evidence_key: str = "item_id"
    evidence_text: str = "text"
    check: Check | None = None


def preprocess(posts: DataFrame, config: PipelineConfig) -> DataFrame:
    """Numbers, lower case, a copy of the text, cleaning, tokens, sentiment and emotion."""
    if config.likes:
        posts = posts.withColumn(config.likes, columns.parse_suffix_number(F.col(config.likes)))
    posts = text.lower_columns(posts, config.lower)
    posts = posts.withColumn("Original Tweets", F.col(f"`{config.text}`"))
    posts = posts.withColumns({c: text.clean_text(F.col(f"`{c}`")) for c in config.clean})
    words = text.drop_stop_words(text.lemmatize(text.tokenize(F.col(f"`{config.text}`"))))
    posts = posts.withColumn("Tokens", text.stem_tokens(words)).withColumn("Token_String", text.token_string(F.col("Tokens")))
    original = "Original Tweets"
    if config.make_sentiment:
        posts = scoring.score_with_model(posts, original, "Sentiment_Scores", config.make_sentiment)
    else:
        posts = posts.withColumn("Sentiment_Scores", scoring.sentiment_by_words(F.col(original)))
    if config.make_emotions:
        posts = scoring.score_with_model(posts, original, "Emotion_Labels", config.make_emotions)
    else:
        posts = posts.withColumn("Emotion_Labels", scoring.emotions_by_words(F.col(original)))
    label, score = scoring.top_score(F.col("Sentiment_Scores"))
    return posts.withColumns({"Sentiment_Label": label, "Sentiment_Score": score})


def build_features(posts: DataFrame, config: PipelineConfig) -> dict[str, DataFrame]:
    """Feature vectors by name, each ``(key, features)`` with every term, stored since every detector reads them."""
    key = config.key
    found = materialize(features.term_counts(posts, key, "Tokens"), "term-counts")
    ids = features.term_ids(found)
    counts = features.term_vectors(found, ids, posts, key)
    weighted = counts
    if config.tfidf == "idf":
        weighted = features.term_vectors(features.tfidf(found, key), ids, posts, key, "weight")
    embedded = scoring.embed(posts.select(key, F.col(f"`{config.text}`").alias("_text")), "_text", "_vector", config.make_embedder)
    bert = materialize(embedded.select(key, array_to_vector("_vector").alias("features")), "features-bert")
    return {"tfidf": weighted, "dtm": counts, "bert": bert}


def detect(posts: DataFrame, vectors: dict[str, DataFrame], config: PipelineConfig) -> DataFrame:
    """``(key, detector)`` of every row that one of the eleven detector and feature pairs flags."""
    key, q = config.key, config.quantile
    exact, vectors = vectors, model_vectors(vectors, config)
    dense = vectors["bert"].select(key, F.unwrap_udt("features")["values"].alias("x"))
    flags = {
        "kmeans_dtm": anomaly.kmeans_anomaly(vectors["dtm"], key, config.clusters, q=q, sparse=True),
        "kmeans_bert": anomaly.kmeans_anomaly(vectors["bert"], key, config.clusters, q=q),
        "dbscan_dtm": _count_noise(posts, exact["dtm"], config),
        "dbscan_bert": dbscan_noise(dense, key, "x", config.eps, config.min_samples),
        "hybrid_dtsvmnb_dtm": vote_anomaly(_labelled(vectors["dtm"], posts, config), key, q),
        "autoencoder_dtm": _rebuilt(vectors["dtm"], config, sparse=True),
        "autoencoder_bert": _rebuilt(vectors["bert"], config),
    }
    if vectors["tfidf"] is vectors["dtm"]:  # same numbers, same flags: not computed twice
        for detector in ("kmeans", "dbscan", "hybrid_dtsvmnb", "autoencoder"):
            flags[f"{detector}_tfidf"] = flags[f"{detector}_dtm"]
    else:
        plain = exact["tfidf"].select(key, vector_to_array("features").alias("x"))
        flags |= {
            "kmeans_tfidf": anomaly.kmeans_anomaly(vectors["tfidf"], key, config.clusters, q=q, sparse=True),
            "dbscan_tfidf": dbscan_noise(plain, key, "x", config.eps, config.min_samples),
            "hybrid_dtsvmnb_tfidf": vote_anomaly(_labelled(vectors["tfidf"], posts, config), key, q),
            "autoencoder_tfidf": _rebuilt(vectors["tfidf"], config, sparse=True),
        }
    return anomaly.union_flags(flags, key)


def model_vectors(vectors: dict[str, DataFrame], config: PipelineConfig) -> dict[str, DataFrame]:
    """The vectors at the width of the models; equal feature sets stay one."""
    folded = {id(v): features.fold_vectors(v, config.key, config.model_width) for name, v in vectors.items() if name != "bert"}
    return {name: folded.get(id(v), v) for name, v in vectors.items()}


def _count_noise(posts: DataFrame, counts: DataFrame, config: PipelineConfig) -> DataFrame:
    """Density noise on all term counts; below a radius of 1 only equal rows are neighbours."""
    if config.eps < 1:
        return anomaly.duplicate_noise(posts, config.key, anomaly.bag_of_terms(F.col("Tokens")), config.min_samples)
    return dbscan_noise(counts.select(config.key, vector_to_array("features").alias("x")), config.key, "x", config.eps, config.min_samples)


def _labelled(vectors: DataFrame, posts: DataFrame, config: PipelineConfig) -> DataFrame:
    labels = posts.select(config.key, F.col(f"`{config.label}`").alias("label_text")).na.drop(subset=["label_text"])
    return vectors.join(labels, config.key)


def _rebuilt(vectors: DataFrame, config: PipelineConfig, sparse: bool = False) -> DataFrame:
    flags, _ = autoencoder_anomaly(
        vectors,
        config.key,
        vector_width(vectors),
        q=config.quantile,
        sparse=sparse,
        code=config.encoding_dim,
        epochs=config.epochs,
    )
    return flags


def run(posts: DataFrame, config: PipelineConfig) -> dict[str, DataFrame]:
    """Frames of every stage: posts, flags, suspects, suspect features, verdicts per suspect."""
    key = config.key
    ready = materialize(preprocess(posts, config), "posts")
    vectors = build_features(ready, config)
    flags = materialize(detect(ready, vectors, config), "flags")
    suspects = anomaly.union_suspects(flags, key)
    rows = anomaly.select_suspects(ready, suspects, key)
    kept = features.suspect_features(vectors, suspects, key)
    if config.feature_path is not None:
        features.store_suspect_features(kept, config.feature_path)
        kept = ready.sparkSession.read.schema(kept.schema).parquet(config.feature_path)
    result = {
        "posts": ready,
        "flags": flags,
        "suspects": suspects,
        "suspect_features": kept,
    }
    check = config.check
    if check is None and config.evidence is not None:

        def check(claims: DataFrame) -> DataFrame:
            return check_by_overlap(claims, config.evidence, config.evidence_key, config.evidence_text)

    if check is not None:
        claims = rows.withColumn("claim", F.col("Original Tweets"))
        result["verification"] = incremental_verify(claims, key, config.verdict_path, check)
    return result


def run_from_csv(spark: SparkSession, config: PipelineConfig) -> dict[str, DataFrame]:
    """``run`` on the post CSV named in the configuration."""
    if config.data_source is None:
        raise ValueError("data_source names the CSV to read")
    return run(read_csv_ranges(spark, config.data_source, POST_SCHEMA), config)
