"""Token counts from pre-tokens: pieces are counted once per distinct pre-token and summed by frequency.

A document's pre-token frequencies are joined to the piece counts inside the task that reads it; no id list of a
document is built and nothing is shuffled. A null text counts as empty. Special strings are one token each, as the
library's default has it. Rows are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalcheck.llm.common import Bounded, append_columns, table

VOCABULARY = "byte_bpe_50k.json"
_counters: dict[str, tuple] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)})
    return letters


def counter(path: str) -> tuple:
    """(pattern of special strings, pattern of pre-tokens, memory of piece counts), once per worker."""
    if path not in _counters:
        with open(path) as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        model = Tokenizer.from_file(path).model
        letters = byte_letters()
        memory = Bounded(lambda piece: len(model.tokenize("".join(letters[b] for b in piece.encode()))))
        split = regex.compile("|".join(map(regex.escape, special))) if special else None
        _counters[path] = (split, regex.compile(public_tokenizers.PATTERN), memory)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    def compute(texts):
        special, pattern, memory = counter(path)
        sizes, counts = [], []
        for text in texts:
            text = text or ""
            parts = special.split(text) if special else [text]
            frequencies = Counter()
            for part in parts:
                frequencies.update(pattern.findall(part))
            counts.append(len(parts) - 1 + sum(n * memory[piece] for piece, n in frequencies.items()))
            sizes.append(len(text.encode()))
        return [sizes, counts]

    return append_columns(docs, ["text"], "n_bytes long, n_tokens long", compute, keep)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
