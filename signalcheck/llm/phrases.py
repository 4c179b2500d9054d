"""Phrase collocations per language, counted by broadcast double-array tries.

Words of at least ``least`` occurrences in a language get a number; texts become arrays of numbers, read by a trie of
"language, tab, word" that advances all words of a batch by one byte a step. Length by length, the candidates are the
phrases whose two parts of one word less are frequent (Apriori) and whose sightings, counted up to ``least`` in each
task, add up to ``least``. Their trie is broadcast; all text positions advance through it together, accepting states are
counted with bincount, and the counts of the tasks are added.

A trie holds at most ``TRIE_KEYS`` keys. More words or candidates are cut by number into several tries, and the numbers
of the texts are read once per trie; nothing is dropped. Rounds are bounded in memory, their number grows with the
candidates.

A null text is empty, a null language ``und``; repeated rows count each time; other columns are not read; an empty table
gives an empty result. Very long texts are read window by window. Ties go to the smaller phrase in UTF-8 byte order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalcheck.llm import double_array
from signalcheck.llm.common import table
from signalcheck.plans.skew import global_rank
from signalcheck.session import Scratch, materialize

LEAST = 10
MOST_WORDS = 3
FIRST = 2000
#: A longer candidate with this share (in percent) of the occurrences of one that it holds replaces it.
COVERED = 50
TRIE_KEYS = 400_000
#: Bytes of text, numbers of words, and different phrases that a task works on at once.
WINDOW_BYTES = 2_000_000
WINDOW_WORDS = 250_000
SEEN_PHRASES = 600_000
#: Counters that travel together.
COUNTERS = 4_096
#: The first ranks are taken among parts of a language first.
PARTS = 64

UPPER = "".join(map(chr, range(65, 91)))
#: 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UNKNOWN, BREAK = -1, -2


def words_of(docs: DataFrame) -> DataFrame:
    """(lang, word) of every word."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    word = F.explode(F.split(text, r"[\x20\x09.,;:!?\x0A-\x0D]+")).alias("word")
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), word).filter("word <> ''")


def arrays_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits of a text or binary column without nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    limits = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(1, np.uint8), limits


def in_parts(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that one holds about WINDOW_BYTES of the column, or a single longer row."""
    for batch in batches:
        _, limits = arrays_of(batch, name)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(limits, limits[lo] + WINDOW_BYTES, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def read_window(data: np.ndarray, lo: int, hi: int, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data[lo:hi]``, and places of the piece ends."""
    kind = KIND[data[lo:hi]]
    inside = np.concatenate([[False], kind == 0, [False]])
    opens, shuts = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = row_starts[(row_starts >= lo) & (row_starts < hi)] - lo
    opens[cut] = inside[1:-1][cut]
    cut = cut[cut > 0]
    shuts[cut - 1] = inside[1:-1][cut - 1]
    return np.flatnonzero(opens) + lo, np.flatnonzero(shuts) + 1 + lo, np.flatnonzero(kind == 2) + lo


def number_words(trie: double_array.Trie, first: int, states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of the words, read from ``states`` on; UNKNOWN where the trie has no such word."""
    out = np.full(len(starts), UNKNOWN, np.int32)
    active = np.flatnonzero(states >= 0)
    at, states, level, lengths = starts[active], states[active], 0, (ends - starts)[active]
    while active.size:
        states, found = trie.step(states, LOWER[data[at + level]])
        level += 1
        done = found & (lengths == level)
        value = trie.value[states[done]]
        out[active[done]] = np.where(value >= 0, value + first, UNKNOWN)
        go = found & ~done
        active, at, states, lengths = active[go], at[go], states[go], lengths[go]
    return out


def language_states(trie: double_array.Trie, langs: list[str]) -> np.ndarray:
    """The state after "language, tab" per row, -1 where the trie does not know the language."""
    known: dict[str, int] = {}
    for lang in set(langs):
        state = 0
        for symbol in lang.encode("utf-8", "surrogatepass") + b"\t":
            nxt = int(trie.base[state]) + symbol
            if trie.check[nxt] != state:
                state = -1
                break
            state = nxt
        known[lang] = state
    return np.fromiter(map(known.__getitem__, langs), np.int64, len(langs))


def encode(docs: DataFrame, shared, keep: bool) -> DataFrame:
    """The numbers of the words of each text as 32-bit integers, BREAK between pieces; known numbers are kept."""
    again = "numbers" in docs.columns
    schema = "lang string, text string, numbers binary" if keep else "numbers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, trie = shared.value
        for batch in in_parts(batches, "text"):
            data, limits = arrays_of(batch, "text")
            langs = language_states(trie, batch.column(batch.schema.get_field_index("lang")).to_pylist())
            row_starts = limits[:-1][limits[:-1] < limits[1:]]
            found, rows, piece, before = [], [], [], 0
            lo, end = int(limits[0]), int(limits[-1])
            while lo < end:
                hi = min(lo + WINDOW_BYTES, end)
                while hi < end and KIND[data[hi - 1]] == 0:
                    look = np.flatnonzero(KIND[data[hi : hi + WINDOW_BYTES]])
                    hi = min(hi + (int(look[0]) + 1 if look.size else WINDOW_BYTES), end)
                starts, ends, cuts = read_window(data, lo, hi, row_starts)
                row = np.searchsorted(limits, starts, "right") - 1
                found.append(number_words(trie, first, langs[row], data, starts, ends))
                rows.append(row)
                piece.append(before + np.searchsorted(cuts, starts))
                before += len(cuts)
                lo = hi
            number = np.concatenate([*found, np.zeros(0, np.int32)])
            row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
            piece_of = np.concatenate([*piece, np.zeros(0, np.int64)])
            new = np.flatnonzero((np.diff(piece_of) != 0) & (np.diff(row) == 0)) + 1
            number = np.insert(number, new, BREAK)
            row = np.insert(row, new, row[new])
            if again:
                old, ends = arrays_of(batch, "numbers")
                number = np.maximum(number, np.frombuffer(old[ends[0] : ends[-1]].tobytes(), np.int32))
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)) * 4
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(number.tobytes())]).cast(pa.binary())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("lang", "text")] if keep else []
            yield pa.RecordBatch.from_arrays([*kept, column], names=["lang", "text", "numbers"] if keep else ["numbers"])

    return docs.mapInArrow(run, schema)


def walk(trie: double_array.Trie, width: int, length: int, numbers: np.ndarray) -> np.ndarray:
    """The key that starts at each position, or -1: all positions go one byte further in each step."""
    out = np.full(len(numbers), -1, np.int32)
    if len(numbers) < length:
        return out
    whole = numbers[: len(numbers) - length + 1] >= 0
    for k in range(1, length):
        whole &= numbers[k : len(numbers) - length + 1 + k] >= 0
    at = np.flatnonzero(whole)
    states = np.zeros(len(at), np.int64)
    for k in range(length):
        for shift in range(8 * (width - 1), -1, -8):
            states, found = trie.step(states, (numbers[at + k] >> shift) & 255)
            at, states = at[found], states[found]
    out[at] = trie.value[states]
    return out


def pieces_of(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[np.ndarray]:
    """The numbers of several texts with a BREAK after each, in windows that share ``overlap`` words."""
    for batch in in_parts(batches, "numbers"):
        data, limits = arrays_of(batch, "numbers")
        numbers = np.frombuffer(data[limits[0] : limits[-1]].tobytes(), np.int32)
        numbers = np.insert(numbers, (limits[1:] - limits[0]) // 4, BREAK)
        for lo in range(0, len(numbers), WINDOW_WORDS):
            yield numbers[lo : lo + WINDOW_WORDS + overlap]


def sightings(texts: DataFrame, length: int, shared, width: int, least: int) -> DataFrame:
    """(code, seen): phrases of ``length`` words whose first words are a frequent phrase of the trie (any word, for two).

    A code is the number of the first words, times 2^32, plus the number of the last word. ``seen`` is counted up to
    ``least`` in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged(codes, seen):
            new, count = np.unique(np.concatenate([*waiting, np.zeros(0, np.int64)]), return_counts=True)
            waiting.clear()
            both = np.concatenate([codes, new])
            order = np.argsort(both, kind="stable")
            both, weight = both[order], np.concatenate([seen, count])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            return both[first], np.minimum(np.add.reduceat(weight, first), least) if len(first) else weight

        def handed(codes, seen):
            for lo in range(0, len(codes), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(codes[part]), pa.array(seen[part].astype(np.int32))], names=["code", "seen"])

        held = 0
        for numbers in pieces_of(batches, length - 1):
            if shared is None:
                heads = numbers
            else:
                first, last, numbered, trie = shared.value
                heads = walk(trie, width, length - 1, numbers)
                known = heads >= 0
                # The other part must be frequent too, where this trie can tell.
                tails = numbers[1:]
                own = (tails >= first) & (tails <= last) & (heads[1:] < 0)
                known[:-1] &= ~own
                heads = np.where(known, numbered[heads], -1)
            end = min(len(numbers) - length + 1, WINDOW_WORDS)
            if end <= 0:
                continue
            ok = np.flatnonzero((heads[:end] >= 0) & (numbers[length - 1 : end + length - 1] >= 0))
            waiting.append((heads[ok].astype(np.int64) << 32) | numbers[ok + length - 1].astype(np.int64))
            held += len(ok)
            if held >= SEEN_PHRASES:
                codes, seen = merged(codes, seen)
                held = 0
                if len(codes) >= SEEN_PHRASES:
                    yield from handed(codes, seen)
                    codes, seen = codes[:0], seen[:0]
        yield from handed(*merged(codes, seen))

    return texts.mapInArrow(run, "code long, seen int")


def counted(texts: DataFrame, length: int, shared, width: int) -> DataFrame:
    """(number, a): the occurrences of the trie's phrases.

    A task hands on its counters in blocks; the blocks of the tasks are added, each where its number sends it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, numbered, trie = shared.value
        counts = np.zeros(len(numbered), np.int64)
        for numbers in pieces_of(batches, length - 1):
            accepted = walk(trie, width, length, numbers)[:WINDOW_WORDS]
            counts += np.bincount(accepted[accepted >= 0], minlength=len(counts))
        for lo in range(0, len(counts), COUNTERS):
            part = counts[lo : lo + COUNTERS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // COUNTERS], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(counts, np.int64)
                sums[block] = sums[block] + new if block in sums else new
        numbered = shared.value[2]
        for block, counts in sums.items():
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(numbered[hit + block * COUNTERS]), pa.array(counts[hit])], names=["number", "a"])

    return texts.mapInArrow(run, "block int, counts binary").repartition("block").mapInArrow(added, "number long, a long")


def shards(df: DataFrame, rows: int) -> Iterator[DataFrame]:
    """``df`` by ranges of its gapless number, at most TRIE_KEYS rows each."""
    for lo in range(0, rows, TRIE_KEYS):
        yield df.filter(F.col("number").between(lo, min(lo + TRIE_KEYS, rows) - 1)).orderBy("number")


def number_trie(spark: SparkSession, part: DataFrame, length: int, width: int):
    """Broadcast (first and last number of the first word, numbers of the keys, trie) of one bounded part."""
    got = part.select("number", *(f"w{i}" for i in range(length))).toArrow()
    columns = [got.column(f"w{i}").to_numpy() for i in range(length)]
    numbered = got.column("number").to_numpy().astype(np.int64)
    return spark.sparkContext.broadcast((int(columns[0][0]), int(columns[0][-1]), numbered, double_array.of_numbers(columns, width)))


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def over_parts(parts: Iterator, passed: Callable, scratch: Scratch, label: str, totals: Callable) -> DataFrame:
    """The united results of one round per trie, each stored before its trie is given up."""
    frames = []
    for shared in parts:
        frames.append(scratch.materialize(totals(passed(shared)), label))
        if shared is not None:
            shared.destroy()
    return united(frames)


def frequent_words(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(number, lang, word, a) of the frequent words in key order, and (lang, n) of all words."""
    counts = scratch.materialize(words_of(docs).groupBy("lang", "word").agg(F.count("*").alias("a")), "phrase-words")
    key = F.concat("lang", F.lit("\t"), F.col("word"))
    frequent = global_rank(counts.filter(F.col("a") >= least).withColumn("key", key), "key", "number")
    return scratch.materialize(frequent, "phrase-vocabulary"), counts.groupBy("lang").agg(F.sum("a").alias("n"))


def encoded(docs: DataFrame, words: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for lo in range(0, rows, TRIE_KEYS):
        part = words.filter(F.col("number").between(lo, lo + TRIE_KEYS - 1)).orderBy("number").select("key").toArrow()
        keys = [k.encode("utf-8", "surrogatepass") for k in part.column("key").to_pylist()]
        shared = spark.sparkContext.broadcast((lo, double_array.of_texts(keys)))
        texts = scratch.materialize(encode(texts, shared, lo + TRIE_KEYS < rows), "phrase-texts")
        shared.destroy()
    return texts


def phrase_counts(docs: DataFrame, least: int, most_words: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Per length: (number, w0, w1, ..., a) of the frequent phrases, words first as (number, w0, lang, word, a); and (lang, n)."""
    spark = docs.sparkSession
    words, totals = frequent_words(docs, least, scratch)
    rows = words.count()
    levels = [words.withColumn("w0", F.col("number"))]
    if not rows:
        return levels, totals
    width = max(1, (max(rows - 1, 1).bit_length() + 7) // 8)
    texts = encoded(docs, words, rows, scratch)
    for length in range(2, most_words + 1):
        below, known = levels[-1], rows
        if not known:
            break
        tries = iter([None]) if length == 2 else (number_trie(spark, p, length - 1, width) for p in shards(below, known))
        seen = over_parts(
            tries, lambda shared: sightings(texts, length, shared, width, least), scratch, "phrase-seen",
            lambda df: df.groupBy("code").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least).select("code"),
        )
        head = below.select(F.col("number").alias("head"), *(f"w{i}" for i in range(length - 1)))
        split = seen.select("code", F.shiftright("code", 32).alias("head"), (F.col("code").bitwiseAND(2**32 - 1)).alias(f"w{length - 1}"))
        found = split.join(head, "head")
        if length > 2:
            found = found.join(below.select(*(F.col(f"w{i}").alias(f"w{i + 1}") for i in range(length - 1))), [f"w{i}" for i in range(1, length)], "left_semi")
        found = scratch.materialize(global_rank(found.select("code", *(f"w{i}" for i in range(length))), "code", "number"), "phrase-candidates")
        rows = found.count()
        if not rows:
            levels.append(found.withColumn("a", F.lit(0).cast("long")))
            break
        parts = (number_trie(spark, p, length, width) for p in shards(found, rows))
        a = over_parts(parts, lambda shared: counted(texts, length, shared, width), scratch, "phrase-counts", lambda df: df)
        levels.append(scratch.materialize(found.join(a, "number").filter(F.col("a") >= least), "phrase-frequent"))
    return levels, totals


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, first: int = FIRST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first phrases of each language."""
    with Scratch(docs.sparkSession) as scratch:
        levels, totals = phrase_counts(docs, least, most_words, scratch)
        words = levels[0].select("number", "lang", "word")
        counts = [level.select(*(f"w{i}" for i in range(k + 1)), "a") for k, level in enumerate(levels)]
        rated = []
        for length in range(2, len(levels) + 1):
            names = [f"w{i}" for i in range(length)]
            found, best = counts[length - 1], None
            for k in range(1, length):
                left = counts[k - 1].select(*names[:k], F.col("a").alias(f"l{k}"))
                right = counts[length - k - 1].select(*(F.col(f"w{i}").alias(names[k + i]) for i in range(length - k)), F.col("a").alias(f"r{k}"))
                found = found.join(left, names[:k]).join(right, names[k:])
                cut = F.struct(score_of(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
                best = cut if best is None else F.least(best, cut)
            found = found.withColumn("cut", best)
            for longer in range(length + 1, len(levels) + 1):
                inside = [
                    counts[longer - 1].select(*(F.col(f"w{at + i}").alias(names[i]) for i in range(length)), F.col("a").alias("over"))
                    for at in range(longer - length + 1)
                ]
                found = found.join(united(inside).groupBy(*names).agg(F.max("over").alias("over")), names, "left")
                found = found.filter(F.coalesce(F.lit(100) * F.col("over") < F.lit(covered) * F.col("a"), F.lit(True))).drop("over")
            for i, name in enumerate(names):
                named = words.select(F.col("number").alias(name), F.col("word").alias(f"t{i}"), *(["lang"] if i == 0 else []))
                found = found.join(named, name)
            rated.append(found.select("lang", F.concat_ws(" ", *(f"t{i}" for i in range(length))).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
        if not rated:
            return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        parted = united(rated).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
        ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
        return materialize(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
ones AS (SELECT lang, unnest(w) AS phrase FROM words),
totals AS (SELECT lang, count(*) AS n FROM ones GROUP BY lang),
grams AS (
  SELECT lang, 1 AS size, phrase FROM ones
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, p.a AS l, q.a AS r, 1000000::HUGEINT * c.a * c.a // (p.a::HUGEINT * q.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f p ON p.lang = c.lang AND p.size = k AND p.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f q ON q.lang = c.lang AND q.size = c.size - k AND q.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, k) = 1
), inner_pairs AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT lang, a, string_split(phrase, ' ') AS w, unnest([1, 2]) AS i FROM f WHERE size = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_pairs i ON b.size = 2 AND i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.over IS NULL OR 100 * i.over < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
