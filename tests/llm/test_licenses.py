"""Licence scans: an added, dropped and changed word for every template, and every row against a full search."""

import pytest

from signalcheck.llm import licenses
from signalcheck.llm.decontaminate import words_of


def edited():
    """(label or None, text): each template whole, with one word added, dropped or changed, and with too many changed."""
    for label, text in licenses.TEMPLATES:
        words = text.split()
        free = [i for i, w in enumerate(words) if not w.isupper()]
        yield label, text
        for i in free:
            yield label, " ".join([*words[:i], "xyzzy", *words[i:]])
            yield label, " ".join([*words[:i], "xyzzy", *words[i + 1 :]])
            yield label, " ".join(words[:i] + words[i + 1 :])
        for i in set(range(len(words))) - set(free):
            yield None, " ".join([*words[:i], "xyzzy", *words[i + 1 :]])
        many = free[: licenses.allowed_edits(len(words)) + 1]
        yield None, " ".join("xyzzy" if i in many else w for i, w in enumerate(words))


def brute_labels(text):
    words = words_of(text)
    base = {label for phrase, label in licenses.PHRASES if any(words[i : i + len(phrase.split())] == words_of(phrase) for i in range(len(words)))}
    own = set()
    for label, template in licenses.TEMPLATES:
        want, needed = licenses.template_words(template)
        if licenses.fewest_edits(want, needed, words) <= licenses.allowed_edits(len(want)):
            own.add(label)
    return ",".join(sorted(base)), ",".join(sorted(base | own))


def test_edited_notices(spark):
    cases = [(i, label, f"First some words. {text}, and then others") for i, (label, text) in enumerate(edited())]
    rows = [(i, text) for i, _, text in cases]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label, text in cases:
        assert (found[i].base_labels, found[i].labels) == brute_labels(text), text
        if label:
            assert label in found[i].labels.split(","), text
        assert 0 <= found[i].score <= 1


def test_measured_notices(spark):
    said = [
        ("mit", "released under the very MIT license"), ("mit", "released under the terms of the MIT license"), ("cc-by-nc", "licensed under a CC BY-NC license"),
        ("lgpl", "GNU Lesser General Public Software License"), ("", "released under the license of the authors"), ("", "licensed under the"),
    ]
    found = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(said)], "doc_id int, text string")).collect()
    for row in found:
        assert said[row.doc_id][0] in row.labels.split(","), row


def test_rows_of_documents_are_a_full_search(spark, folder, texts_of):
    for row in licenses.op10_licenses(spark, folder).collect():
        assert (row.base_labels, row.labels) == brute_labels(texts_of[row.doc_id]), row.doc_id


@pytest.fixture(scope="module")
def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_repeated_rows_and_clashing_columns(spark):
    text = "Licensed under CC BY-NC. " * 3
    rows = [(None, text, "a"), (None, text, "a"), (7, text, None), (8, None, "b"), (9, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    found = licenses.scan_licenses(docs).collect()
    assert sorted(r.n_base for r in found) == [0, 0, 3, 3, 3]
    assert [r.labels for r in found if r.n_base] == ["cc-by,cc-by-nc"] * 3
