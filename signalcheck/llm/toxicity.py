"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicons (a short public list and word or word-start lists mined from the training rows) and patterns.
The label model estimates each voter's vote rates per class by EM and weighs a voter down by its correlation with
others given the class. Null and empty texts score with the intercept; rows are scored one by one, so ties, repeated
rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import Bounded, append_columns, fit_in_one_task, ftrl, held_out_column, table, training_sample

BITS = 18
SAMPLE_ROWS = 12_000
STARTS = (4, 5, 6, 7)
SEED_WORDS = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile bastard".split())
LEXICONS = 8
WORDS = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STARTS if len(word) > k)]


def slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def slots_of(words: set[str], memory: Bounded) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a text's distinct words, and how many of these words have each."""
    flat = [s for w in words for s in memory[w]]
    at, counts = np.unique(np.array(flat, np.int32), return_counts=True)
    return at, counts.astype(np.float32)


def votes(texts: list[str], found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """A row of votes per text: 1 toxic, -1 clean, 0 abstains."""
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for own, target in zip(found, y, strict=True):
        (toxic if target else clean)[own] += 1
    share = max(y.sum(), 1) / max((1 - y).sum(), 1)
    mined = (toxic >= 3) & (toxic > 20 * share * (clean + 0.2))
    seeds = np.zeros(1 << BITS, bool)
    seeds[[slot(w) for w in SEED_WORDS]] = True
    table = np.zeros((len(texts), LEXICONS + 4))
    for i, (text, own) in enumerate(zip(texts, found, strict=True)):
        hits = own[mined[own]]
        table[i, hits % LEXICONS] = 1
        table[i, LEXICONS] = 1 if seeds[own].any() else 0
        table[i, LEXICONS + 1] = 1 if len(hits) >= 3 else 0
        table[i, LEXICONS + 2] = -1 if len(hits) == 0 else 0
        table[i, LEXICONS + 3] = -1 if sum(text.count(c) for c in "#%&$|") * 10 > len(text) else 0
    return table


def label_model(table: np.ndarray, prior: float, start: np.ndarray, steps: int = 15) -> np.ndarray:
    """Posterior of the toxic class: EM over class-wise vote rates, correlated voters sharing their weight."""
    posterior = np.clip(start, 0.05, 0.95)
    kinds = np.stack([table == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(steps):
        log = []
        weight = np.ones(table.shape[1])
        for mass in (posterior, 1 - posterior):
            rates = (np.einsum("i,ijk->jk", mass, kinds) + 0.1) / (mass.sum() + 0.3)
            mean = (mass @ table) / max(mass.sum(), 1e-9)
            centred = (table - mean) * np.sqrt(mass)[:, None]
            spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
            related = np.abs(centred.T @ centred) / np.outer(spread, spread)
            weight = np.minimum(weight, 1 / np.maximum(related.sum(axis=0), 1))
            log.append(np.log(rates))
        odds = np.einsum("ijk,jk->i", kinds, (log[0] - log[1]) * weight[:, None]) + math.log(prior / (1 - prior))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
    return posterior


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    def fit(texts, y):
        memory = Bounded(lambda w: [slot(t) for t in terms(w)], 100_000)
        found = [slots_of(distinct_words(t), memory) for t in texts]
        prior = float(np.clip(y.mean(), 0.01, 0.99))
        at = [a for a, _ in found]
        posterior = label_model(votes(texts, at, y), prior, y)
        posterior = np.where(np.abs(posterior - 0.5) < 0.3, y, posterior)  # the model is undecided: the label stays
        return ftrl(at, [c for _, c in found], posterior, 1 << BITS, alpha=0.2, l1=1.0, l2=0.1, passes=4)

    return fit_in_one_task(training_sample(docs, labels, "toxic", 3, 1, rows), fit)


def score_toxicity(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    weights = weights if len(weights) else np.append(np.zeros(1 << BITS), -3.0)

    def compute(texts):
        worth = Bounded(lambda w: float(sum(weights[slot(t)] for t in terms(w))), 200_000)
        scores = []
        for text in texts:
            margin = math.fsum(worth[w] for w in distinct_words(text)) + float(weights[-1])
            scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, margin)))))
        return [scores]

    return append_columns(docs, ["text"], "score double", compute, keep)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    weights = fit_toxicity(docs, table(spark, folder, "labels"))
    return score_toxicity(docs, weights, ["doc_id"]).select(
        "doc_id", held_out_column(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
