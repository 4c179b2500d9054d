"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark passages are cut out,
personal data is replaced, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and reads all rows its predecessor kept. Null texts count as empty. Equal rows
are near duplicates, of which one stays; rows without doc_id stay where nothing else is in their group. Columns beside
those of documents are handed on, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import table
from signalcheck.llm.decontaminate import remove_benchmark
from signalcheck.llm.packing import pack_documents
from signalcheck.llm.pii import sanitise
from signalcheck.llm.simhash import keep_first
from signalcheck.llm.toxicity import fit_toxicity, score_toxicity
from signalcheck.session import materialize

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, weights)
    return scored.filter(F.col("score") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups at three-word shingles and up to three differing bits, as the SimHash operator forms them."""
    return keep_first(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", replace_personal),
    ("packing", pack),
]
#: Classifier, fingerprints and vocabulary are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
