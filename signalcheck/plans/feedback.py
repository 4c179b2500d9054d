"""Verdicts back into training: labels, training rows, retrained classifiers and autoencoders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalcheck.operators.autoencoder import Autoencoder, autoencoder_anomaly, load_autoencoders, save_autoencoders, vector_width
from signalcheck.operators.features import MODEL_WIDTH, fold_vectors, used_terms
from signalcheck.operators.verify import VERDICT_LABELS, attach_verdicts
from signalcheck.operators.vote import accuracy, fit_three, with_bayes_input
from signalcheck.session import materialize

# Features with values below zero, which naive Bayes and sparse scaling cannot take as they are.
SIGNED_FEATURES = ("bert",)


def verdict_label(verdict: Column) -> Column:
    """1 for (partially) false, 0 for (partially) true or unclear, NULL for anything else."""
    mapped = F.when(verdict.isin([v for v, label in VERDICT_LABELS.items() if label == 1]), F.lit(1))
    return mapped.when(verdict.isin([v for v, label in VERDICT_LABELS.items() if label == 0]), F.lit(0))


def label_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts with their label; verdicts outside the five are dropped."""
    return verdicts.withColumn("label", verdict_label(F.col("verdict"))).na.drop(subset=["label"])


def training_set(verdicts: DataFrame, posts: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """One row per verified post, feature name and verdict: ``features`` columns plus ``label``.

    A claim with verdicts that differ counts once for each of them.

    ``posts`` holds ``key`` and ``claim``; ``features`` holds ``key`` and ``feature_name``.
    """
    return features.join(training_labels(verdicts, posts, key), key)


def training_labels(verdicts: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """``(key, label)`` of every verified post, once for each of its verdicts: features of other posts need not be built."""
    stated = attach_verdicts(posts.select(key, "claim"), verdicts, key, "inner", every=True)
    return label_verdicts(stated).select(key, "label")


def at_model_width(rows: DataFrame, key: str, width: int = MODEL_WIDTH) -> DataFrame:
    """The rows with vectors of at most ``width`` places; wider ones are folded, so no term is lost."""
    if vector_width(rows) <= width:
        return rows
    return rows.drop("features").join(fold_vectors(rows, key, width), key)


def retrain_classifiers(training: DataFrame, key: str, max_iter: int = 20) -> DataFrame:
    """Refit the three classifiers per feature name: ``(feature_name, model, accuracy)`` on the training rows.

    Every term keeps a place of its own, however many there are: nothing is folded.
    """
    spark = training.sparkSession
    scores = []
    for name in feature_names(training):
        signed = name in SIGNED_FEATURES
        rows = training.filter(F.col("feature_name") == name).select("features", F.col("label").cast("double").alias("label"))
        rows = materialize(with_bayes_input(rows, signed).withColumn("_row", F.monotonically_increasing_id()), "retrain-input")
        classes = rows.select("label").distinct().count()
        if classes < 2:
            raise ValueError(f"the verified {name} rows all have the same label; nothing to separate")
        if not signed:  # naive Bayes smooths over the whole dictionary; to the others a term that no row holds is nothing
            rows = materialize(rows.drop("features").join(used_terms(rows, "_row"), "_row"), "retrain-terms")
        for model_name, model in fit_three(rows, max_iter, terms=not signed).items():
            scores.append((name, model_name, model.transform(rows).select(accuracy()).first()[0]))
    return spark.createDataFrame(scores, "feature_name string, model string, accuracy double")


def refresh_autoencoders(
    training: DataFrame, key: str, models: Mapping[str, Autoencoder] | None = None, width: int = MODEL_WIDTH, **options
) -> tuple[DataFrame | None, dict[str, Autoencoder]]:
    """Score the label-0 rows per feature name, training where no model of that name and width is known.

    Returns the flags as ``(key, feature_name, error, is_anomaly)`` and the models by feature name.
    """
    known = dict(models or {})
    flags = None
    for name in feature_names(training):
        normal = training.filter((F.col("feature_name") == name) & (F.col("label") == 0)).select(key, "features")
        if normal.isEmpty():
            continue
        normal = at_model_width(normal, key, width)
        scored, known[name] = autoencoder_anomaly(
            normal, key, vector_width(normal), known.get(name), sparse=name not in SIGNED_FEATURES, **options
        )
        scored = scored.withColumn("feature_name", F.lit(name))
        flags = scored if flags is None else flags.unionByName(scored)
    return flags, known


def update_system(
    verdicts: DataFrame,
    posts: DataFrame,
    features: DataFrame,
    key: str,
    models: Mapping[str, Autoencoder] | None = None,
    max_iter: int = 20,
    model_path: str | None = None,
    **options,
) -> dict[str, object]:
    """The whole feedback step: classifier accuracies, autoencoder flags and the autoencoders.

    With ``model_path`` the autoencoders of the last step are taken up from there (``models`` come first) and stored again.
    """
    training = materialize(training_set(verdicts, posts, features, key), "training-set")
    if training.isEmpty():
        raise ValueError("no verified post has features")
    stored = load_autoencoders(training.sparkSession, model_path) if model_path else {}
    flags, known = refresh_autoencoders(training, key, stored | dict(models or {}), **options)
    if model_path and any(stored.get(name) is not model for name, model in known.items()):
        save_autoencoders(training.sparkSession, known, model_path)
    return {"hybrid": retrain_classifiers(training, key, max_iter), "autoenc": flags, "models": known}


def feature_names(features: DataFrame) -> list[str]:
    """Feature names in use; they name detectors, so they are few."""
    return sorted(r[0] for r in features.select("feature_name").distinct().collect())
