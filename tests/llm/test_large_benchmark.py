"""A benchmark of any size is searched whole: in parts it gives what one part gives."""

import pytest

import corpus_pipeline
from signalcheck.llm import decontaminate


@pytest.fixture()
def one_part(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    windows = decontaminate.load_windows(spark.read.parquet(f"{folder}/benchmark.parquet"))
    found = decontaminate.search_documents(docs, windows, ["doc_id"])
    return docs, windows, {r.doc_id: r for r in found.collect()}


def test_search_in_parts(spark, folder, one_part, monkeypatch):
    docs, windows, expected = one_part
    monkeypatch.setattr(decontaminate, "PART_BYTES", 2_000)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    parts = decontaminate.benchmark_parts(benchmark)
    assert len(parts) > 2 and sum(p.count() for p in parts) == benchmark.filter("text is not null").distinct().count()
    rows = decontaminate.op3_decontaminate(spark, folder).collect()
    assert len(rows) == len(expected) and any(r.n_hit for r in rows)
    for r in rows:
        e = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (e.n_words, e.n_hit, e.n_items, e.items_sha256)


def test_cuts_in_parts(spark, folder, one_part, monkeypatch):
    docs, windows, _ = one_part
    expected = {r.doc_id: r for r in decontaminate.remove_passages(docs, windows).collect()}
    monkeypatch.setattr(decontaminate, "PART_BYTES", 2_000)
    assert {r.doc_id: r for r in corpus_pipeline.cut_benchmark(spark, docs, folder).collect()} == expected


def test_passages_that_meet_after_a_cut_in_parts(spark, monkeypatch):
    """Cutting one item joins the words of another; texts without a word left are dropped, odd rows stay."""
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t"), (3, "me"), (4, None)], "item_id long, text string")
    texts = ["x k l m n o a b c d e f g h i j p q r s t y", "a b c d e f g h i j", "me", "", None, "plain", "a b c d e f g h i j k l m n o p q r s t z"]
    docs = spark.createDataFrame([(i % 5, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    windows = decontaminate.load_windows(items.filter("text is not null"))
    expected = sorted(decontaminate.remove_passages(docs, windows).collect(), key=str)
    monkeypatch.setattr(decontaminate, "PART_BYTES", 4)
    assert len(decontaminate.benchmark_parts(items)) > 2
    assert sorted(decontaminate.remove_benchmark(docs, items).collect(), key=str) == expected
    assert decontaminate.remove_benchmark(docs.limit(0), items).count() == 0
