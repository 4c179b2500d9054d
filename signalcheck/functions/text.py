"""Text cleaning and token arrays as native expressions; no Python worker except for stemming."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalcheck.functions.lexicons import LEMMAS, STOP_WORDS
from signalcheck.functions.porter import porter_stem
from signalcheck.plans.skew import broadcast_if_small

# What cleaning removes, in this order.
URL_PATTERN = r"http\S+"
TAG_PATTERN = r"<.*?>"
SPECIAL_PATTERN = r"[^a-zA-Z0-9\s]"
# The same characters, whole runs at a time: a negated class of ranges is far slower in Java than one of POSIX classes.
_SPECIAL_RUNS = r"[^\p{Alnum}\s]+"


def lower_any(column: Column, kind: T.DataType) -> Column:
    """Lower-case text and (nested) arrays of text; anything else passes through."""
    if isinstance(kind, T.StringType):
        return F.lower(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: lower_any(item, kind.elementType))
    return column


def lower_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: lower_any(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns})


def strip_urls(text: Column, unicode_space: bool = False) -> Column:
    return F.regexp_replace(text, _flagged(URL_PATTERN, unicode_space), "")


def strip_tags(text: Column) -> Column:
    """Remove ``<...>``; a tag broken over two lines is kept."""
    return F.regexp_replace(text, TAG_PATTERN, "")


def strip_specials(text: Column, unicode_space: bool = False) -> Column:
    # With the Unicode flag POSIX classes would take in letters beyond ASCII.
    return F.regexp_replace(text, _flagged(SPECIAL_PATTERN, True) if unicode_space else _SPECIAL_RUNS, "")


def clean_text(text: Column, unicode_space: bool = False) -> Column:
    """URLs, tags, then all but ASCII letters, digits and white space.

    ``unicode_space`` keeps no-break and other Unicode spaces; by default they go.
    """
    return strip_specials(strip_tags(strip_urls(text, unicode_space)), unicode_space)


def _flagged(pattern: str, unicode_space: bool) -> str:
    return f"(?U){pattern}" if unicode_space else pattern


def tokenize(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, r"\s+"), lambda token: token != "")


def lemmatize(tokens: Column, lemmas: Mapping[str, str] = LEMMAS) -> Column:
    """Replace tokens that a small word table knows.

    The table is folded into the plan as a map by first letter, so a lookup scans a few
    entries and no row leaves its task. Use ``lemmatize_by_table`` for a full dictionary.
    """
    by_letter: dict[str, list[Column]] = {}
    for word, lemma in lemmas.items():
        by_letter.setdefault(word[0], []).extend([F.lit(word), F.lit(lemma)])
    table = F.create_map(*[c for letter, row in by_letter.items() for c in (F.lit(letter), F.create_map(*row))])
    return F.transform(
        tokens,
        lambda t: F.coalesce(F.try_element_at(F.try_element_at(table, F.substring(t, 1, 1)), t), t),
    )


def lemmatize_by_table(df: DataFrame, key: str, tokens: str, lemmas: DataFrame) -> DataFrame:
    """Lemmatise with a table ``(token, lemma)`` of any size, one row per token.

    A table within the checked broadcast bound is joined map-side; a larger one is
    joined by shuffle, where AQE splits the partitions of very common words.
    """
    words = df.select(key, F.posexplode(tokens).alias("_pos", "token"))
    found = words.join(broadcast_if_small(lemmas), "token", "left")
    # The group is one row's own token list, put back in order.
    lists = (
        found.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("lemma", "token").alias("w")))).alias("_words"))
        .select(key, F.col("_words.w").alias("_words"))
    )
    joined = df.join(lists, key, "left")
    return joined.withColumn(tokens, F.coalesce("_words", F.col(tokens))).drop("_words")


def drop_stop_words(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    words = sorted(stop_words)
    return F.filter(tokens, lambda token: ~token.isin(words))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    """Porter stem of every token; each worker remembers the words it has met."""
    return tokens.map(lambda row: None if row is None else [_remembered_stem(t) for t in row])


@lru_cache(maxsize=1 << 17)
def _remembered_stem(token: str) -> str:
    return porter_stem(token)


def token_string(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def countable(tokens: Column) -> Column:
    """Tokens that a term count keeps: two characters or more."""
    return F.filter(tokens, lambda token: F.length(token) >= 2)
