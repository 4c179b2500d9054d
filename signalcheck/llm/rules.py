"""Quality rules: word, symbol and repetition counts, and tokeniser fertility with bands per language and script.

A public vocabulary with byte fallback measures characters per token, the share of byte tokens and the token entropy
of each text. Texts form groups by the column ``lang`` (null: ``und``; without the column: all) and the script of most
of their letters, whatever script that is. Over all texts of a group that pass the base rules, exact quartiles of the
measures, rounded to 1/1000, give bands: quartile minus or plus a multiple of their distance and a slack. The multiple
is ``reach * (1 + DOUBT / n)`` for n texts, so few texts give wide bands and a lone text always lies within its own.
A text outside a band is rejected.

A null text has no words and fails the base rules. Repeated rows count as often as they occur, so ties share a verdict;
an empty table gives an empty result. Columns named like the measures are replaced; others stay, whatever their names.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalcheck.llm.common import Bounded, append_columns, free_name, table
from signalcheck.plans.skew import BROADCAST_ROWS, lookup
from signalcheck.session import materialize

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 8
MIN_WORDS = 20
REACH = 3.0
DOUBT = 30
SYMBOLS = b"#*$%&|<>"
#: Unicode names of characters start with their script; these start otherwise.
NAMED = {"cjk": "han", "hiragana": "kana", "katakana": "kana", "katakana-hiragana": "kana", "fullwidth": "latin", "halfwidth": "kana"}
ASCII = re.compile("[\\x00-\\x7f]+")
NO_LETTERS = bytes(c for c in range(256) if not chr(c).isalpha() or c > 127)
_models: dict[str, Bounded] = {}


def pieces_of(path: str) -> Bounded:
    if path not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        fallback = frozenset(i for i in range(model.get_piece_size()) if model.is_byte(i))

        def measure(word: bytes) -> tuple[bytes, int]:
            ids = model.encode(word.decode("utf-8", "replace"))
            return np.array(ids, "<i4").tobytes(), 0 if fallback.isdisjoint(ids) else sum(i in fallback for i in ids)

        _models[path] = Bounded(measure)
    return _models[path]


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in a window of ``size`` words that occurs at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[which] > 1)
    places = defaultdict(list)
    for i in maybe.tolist():  # equal hashes are compared as words
        places[tuple(words[i : i + size])].append(i)
    starts = [i for found in places.values() if len(found) > 1 for i in found]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.array(starts, np.int64) + size, -1)
    return int((np.cumsum(cover)[: len(words)] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    worded = list(compress(lines, map(str.strip, lines)))
    if len(worded) != len(lines):  # strip() knows more white space than the rule does
        worded = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(worded) - len(set(worded))


@functools.lru_cache(65_536)
def script_of(letter: str) -> str:
    """Script of one character by its Unicode name; empty for what is no letter or vowel sign."""
    if unicodedata.category(letter)[0] not in "LM":
        return ""
    first = unicodedata.name(letter, "").split(" ")[0].lower()
    return "" if first in ("combining", "modifier", "variation") else NAMED.get(first, first)


def script(text: str, data: bytes) -> str:
    """The script of most letters, the first by name among equals; ``data`` is the text in UTF-8."""
    if len(text) == len(data):
        return "latin"
    counts = Counter(latin=len(data.translate(None, NO_LETTERS)))
    for letter, times in Counter(ASCII.sub("", text)).items():
        counts[script_of(letter)] += times
    del counts[""]
    return min(counts, key=lambda name: (-counts[name], name))


def measure(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    def compute(texts):
        memory = pieces_of(path)
        rows = []
        for text in texts:
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            words = data.split()
            chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
            found = [memory[w] for w in words]
            ids = np.frombuffer(b"".join([f[0] for f in found]), "<i4")
            times = np.bincount(ids)
            share = times[times > 0] / len(ids) if len(ids) else np.ones(1)
            rows.append((
                len(words), chars, sum(data.count(bytes([s])) for s in SYMBOLS), duplicate_lines(text), repeated_words(words),
                script(text, data), chars / max(len(ids), 1), sum(f[1] for f in found) / max(len(ids), 1),
                float(-(share * np.log2(share)).sum()) / np.log2(max(len(ids), 2)),
            ))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 9

    ddl = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
        "chars_per_token double, byte_share double, entropy double"
    )
    return append_columns(docs, ["text"], ddl, compute, keep)


MEASURES = ("chars_per_token", "byte_share", "entropy")


def slack(measure: str, quartile: Column) -> Column:
    """What a text may lie beyond the reach; in proportion for characters per token, whose size differs by script."""
    return {"chars_per_token": quartile * 0.12, "byte_share": F.lit(0.1), "entropy": F.lit(0.03)}[measure]


def fertility_bands(measured: DataFrame, group: str, reach: float = REACH) -> DataFrame:
    """One row per group: its number of texts, and low and high of each measure.

    Rounded values are counted first: at most some twenty thousand cells a group, so no window sees more, and the
    quartiles do not depend on how rows are partitioned.
    """
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(m, 3).alias("value")) for m in MEASURES])
    cells = (
        measured.filter(~F.col("base_failed")).select(F.col(group).alias("group"), F.inline(values)).groupBy("group", "measure", "value")
        .agg(F.count("*").alias("n"))
    )
    own = Window.partitionBy("group", "measure")
    upto = own.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(own).alias("texts"))

    def quartile(m: str, share: float) -> Column:
        return F.min(F.when((F.col("measure") == m) & (F.col("upto") >= F.col("texts") * share), F.col("value")))

    cuts = [quartile(m, share).alias(f"{m}_{name}") for m in MEASURES for name, share in (("q1", 0.25), ("q3", 0.75))]
    found = ranked.groupBy("group").agg(F.max("texts").alias("texts"), *cuts)
    ends = []
    for m in MEASURES:
        q1, q3 = F.col(f"{m}_q1"), F.col(f"{m}_q3")
        wide = F.lit(reach) * (1 + F.lit(DOUBT) / F.col("texts")) * (q3 - q1)
        ends += [(q1 - wide - slack(m, q1)).alias(f"{m}_low"), (q3 + wide + slack(m, q3)).alias(f"{m}_high")]
    return found.select(F.col("group").alias(group), "texts", F.struct(*ends).alias(f"{group}_band"))


def apply_rules(docs: DataFrame, path: str, reach: float = REACH, keep: list[str] | None = None) -> DataFrame:
    keep = docs.columns if keep is None else keep
    group = free_name("_group", docs)
    language = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("all")
    named = docs.withColumn(group, language)
    measured = measure(named, path, [*keep, group])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = measured.withColumn(group, F.concat_ws("/", group, "script")).withColumn("base_failed", failed)
    measured = materialize(measured, "quality-measures")
    bands = materialize(fertility_bands(measured, group, reach), "quality-bands")
    band = f"{group}_band"
    if bands.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(bands.drop("texts")), group, "left")
    else:
        joined = lookup(measured, bands, group, "texts", F.monotonically_increasing_id(), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.round(m, 3).between(F.col(band)[f"{m}_low"], F.col(band)[f"{m}_high"]), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop(group, band)


def op6_rules(spark: SparkSession, folder: str) -> DataFrame:
    return apply_rules(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), keep=["doc_id"])
