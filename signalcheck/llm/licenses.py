"""License scans by diagonal voting.

All rolling word pair hashes of the documents are joined to the positions of the same pairs in licence templates. A hit
votes for the diagonal (word place minus template place); neighbouring diagonals of one template are merged, as far as
its allowed edits can shift a copy, and a merged band with enough different pairs is a candidate span. Candidates are
verified on the words of the text: the template must occur with at most its allowed edits (words added, dropped or
changed), the words that name the licence unchanged. An edit destroys at most two pairs, so the vote loses nothing that
the verification would take. Base phrases are templates that need every pair on one diagonal.

Null and empty texts have no words and no labels. Equal texts are voted on once and every row keeps its own result, so
repeated rows and null doc_ids stay; texts of one word have no pairs; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import append_columns, table
from signalcheck.llm.decontaminate import words_of
from signalcheck.plans.skew import BROADCAST_ROWS, lookup
from signalcheck.session import Scratch, materialize

#: The phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices as the licences state them or as texts name them. Words in capitals name the licence.
TEMPLATES = (
    ("agpl", "under the terms of the gnu AFFERO general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the APACHE license version 2 0"),
    ("apache-2.0", "licensed under the APACHE license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the BSD license"),
    ("bsl", "permission is hereby granted free of charge to any person or ORGANIZATION obtaining a copy of the software and ACCOMPANYING documentation"),
    ("cc-by-nc", "licensed under CC BY NC"),
    ("cc-by-nc", "licensed under a creative commons attribution NONCOMMERCIAL license"),
    ("cc-by-sa", "licensed under CC BY SA"),
    ("cc-by-sa", "licensed under a creative commons attribution SHAREALIKE license"),
    ("gpl", "this work is licensed under the GNU GENERAL public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the GNU GENERAL public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu LESSER general public license"),
    ("mit", "released under the MIT license"),
    ("mit", "released under the terms of the MIT license"),
    ("mit", "permission is hereby granted free of charge to any PERSON obtaining a copy of this software and ASSOCIATED documentation files the software "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
            "sublicense and or sell copies of the software"),
    ("mpl", "this source code form is subject to the terms of the MOZILLA public license"),
    ("unlicense", "this is free and UNENCUMBERED software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
)
#: A template may differ by one word in this many, but at least by one.
WORDS_PER_EDIT = 8
#: Rows of one text that a task takes before they are cut.
ROWS_PER_TASK = 50_000
#: Candidate spans that are broadcast at most, about 50 MB.
BROADCAST_SPANS = 1_000_000


def template_words(text: str) -> tuple[list[bytes], list[bool]]:
    """The words of a template and whether each must stand unchanged."""
    return words_of(text), [w.isupper() for w in text.split()]


def allowed_edits(words: int) -> int:
    return max(1, words // WORDS_PER_EDIT)


def fewest_edits(words: list[bytes], needed: list[bool], text: list[bytes]) -> int:
    """Edits between the template and the nearest run of ``text``; a needed word that is missing counts as them all."""
    never = len(words) + 1
    row = [0] * (len(text) + 1)
    for word, fixed in zip(words, needed, strict=True):
        drop = never if fixed else 1
        last, row[0] = row[0], min(row[0] + drop, never)
        for j, other in enumerate(text, 1):
            best = min(last + (0 if word == other else drop), row[j] + drop, row[j - 1] + 1, never)
            last, row[j] = row[j], best
    return min(row)


def pair_hashes(words: list[bytes]) -> np.ndarray:
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(own) < 2:
        return np.zeros(0, np.int64)
    return (own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:] * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, pairs, reach, hash, place): a fixed table of a few hundred rows.

    ``reach`` is how many diagonals a copy may spread over; ``need`` is how many pairs it keeps at least.
    """
    rows = []
    for i, (label, text, base) in enumerate([(b, a, True) for a, b in PHRASES] + [(a, b, False) for a, b in TEMPLATES]):
        words, _ = template_words(text)
        hashes = pair_hashes(words).tolist()
        reach = 0 if base else allowed_edits(len(words))
        rows += [(i, label, base, len(hashes) - 2 * reach, reach, h, k) for k, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, need int, reach int, hash long, place int")


def candidates(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """Per text key with hits: base places and labels, and candidate spans (template, diagonal) to verify."""

    def compute(texts):
        return [[pair_hashes(words_of(t)) for t in texts]]

    hashed = append_columns(keyed, ["text"], "hashes array<long>", compute, ["key"])
    pairs = hashed.select("key", F.posexplode("hashes").alias("spot", "hash"))
    hits = pairs.join(F.broadcast(templates(keyed.sparkSession)), "hash").withColumn("diagonal", F.col("spot") - F.col("place"))
    # Copies of a text vote for the same diagonals, which the first half of the aggregation puts together.
    votes = hits.groupBy("key", "template", "label", "base", "need", "reach", "diagonal").agg(F.collect_set("place").alias("places"))
    votes = scratch.materialize(votes, "license-votes")
    base = (
        votes.filter(F.col("base") & (F.size("places") == F.col("need")))
        .groupBy("key")
        .agg(
            F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"),
            F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("b"),
        )
    )
    bands = (
        votes.filter(~F.col("base"))
        .withColumn("band", F.explode(F.sequence(F.col("diagonal") - F.col("reach"), F.col("diagonal"))))
        .groupBy("key", "template", "need", "band")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("met"))
        .filter(F.col("met") >= F.col("need"))
    )
    spans = bands.groupBy("key").agg(F.collect_list(F.struct(F.col("template").alias("t"), F.col("band").cast("int").alias("d"))).alias("spans"))
    return base.join(spans, "key", "full")


def verify(texts, spans) -> list[list]:
    """n_words, labels and the best share of words unchanged, per text and its candidate spans."""
    known = [(label, *template_words(text)) for label, text in TEMPLATES]
    n_words, labels, shares = [], [], []
    for text, found in zip(texts, spans, strict=True):
        words = words_of(text)
        n_words.append(len(words))
        best: dict[str, float] = {}
        for template, bands in _by_template(found).items():
            label, want, needed = known[template - len(PHRASES)]
            allowed = allowed_edits(len(want))
            for begin, end in _runs(bands, len(want) + 2 * allowed):
                edits = fewest_edits(want, needed, words[max(0, begin - allowed) : end + 2 * allowed + len(want)])
                if edits <= allowed:
                    best[label] = max(best.get(label, 0.0), 1 - edits / len(want))
        labels.append(sorted(best))
        shares.append(max(best.values(), default=0.0))
    return [n_words, labels, shares]


def _by_template(spans) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for span in spans or ():
        out.setdefault(span["t"], []).append(span["d"])
    return out


def _runs(bands: list[int], near: int) -> list[tuple[int, int]]:
    """First and last of the runs of bands whose windows overlap, so each stretch of text is read once."""
    runs: list[tuple[int, int]] = []
    for band in sorted(bands):
        if runs and band <= runs[-1][1] + near:
            runs[-1] = (runs[-1][0], band)
        else:
            runs.append((band, band))
    return runs


def scan_licenses(docs: DataFrame) -> DataFrame:
    """n_words, base places, base and method labels, and a score for each row of ``docs`` (doc_id, text)."""
    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    with Scratch(docs.sparkSession) as scratch:
        found = candidates(keyed, scratch)
        found = scratch.materialize(found, "license-candidates")
        rows, spans = found.agg(F.count("*"), F.sum(F.greatest(F.size("spans"), F.lit(0)))).first()
        if rows <= BROADCAST_ROWS and (spans or 0) <= BROADCAST_SPANS:
            joined = keyed.join(F.broadcast(found), "key", "left")
        else:  # a text that a third of all rows repeat is met in as many tasks as its rows need
            counted = found.join(keyed.groupBy("key").agg(F.count("*").alias("rows")), "key")
            joined = lookup(keyed, scratch.materialize(counted, "license-counted"), "key", "rows", F.col("doc_id"), "left", ROWS_PER_TASK)
        joined = joined.select("doc_id", "text", "n_base", "first_word", "last_word", "b", "spans")
        checked = append_columns(
            joined, ["text", "spans"], "n_words long, m array<string>, share double", verify, ["doc_id", "n_base", "first_word", "last_word", "b"]
        )
        base, none = F.coalesce("b", F.array().cast("array<string>")), F.lit(0.0)
        result = checked.select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            F.array_join(F.array_sort(base), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(base, "m")), ",").alias("labels"),
            F.greatest("share", F.when(F.col("n_base") > 0, 1.0).otherwise(none)).alias("score"),
        )
        return materialize(result, "license-labels")


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))
