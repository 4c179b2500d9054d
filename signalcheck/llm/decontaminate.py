"""Benchmark decontamination with an FM-index per shard.

A shard is a batch of documents as word numbers of the benchmark vocabulary; any other word ends a run, and runs
shorter than the shortest window cannot hold one and stay out of the index. The index is the Burrows-Wheeler
transform of the shard behind a wavelet matrix with rank counts; windows are found by backward search, located by
walking to sampled suffix positions, and their spans merged per document.

A benchmark of more bytes than one task should hold is searched part by part, and the hits of a document are put
together afterwards: the same result, with one pass over the documents per part.

Null and empty texts have no words. Rows are searched one by one, so ties and repeated rows change nothing; empty
tables on either side give zero hits.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import append_columns, free_name, table
from signalcheck.session import Scratch, materialize

WINDOW = 10
SAMPLING = 8
#: Bytes of benchmark items that one pass searches for.
PART_BYTES = 8 << 20
_letters = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_letters).split()


class Windows:
    """The distinct windows of all items as word numbers (from 1), with the items of each."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(str(item))
        self.windows = sorted(owners, key=len)
        self.owners = [frozenset(owners[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if self.windows else 0
        self.table = np.zeros((len(self.windows), size), np.int64)
        for row, window in zip(self.table, self.windows, strict=True):
            row[size - len(window) :] = window


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in sort order, by prefix doubling; the last symbol is the unique smallest."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(symbols)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        """``symbols`` ends with a 0 that occurs nowhere else."""
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        self.n, self.levels = len(symbols), max(1, int(symbols.max()).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << self.levels))))
        self.ones, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(int((bit == 0).sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.marked = order % SAMPLING == 0
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = order[self.marked]
        self.bwt_at = bwt

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        low, high = np.zeros_like(at), at.copy()
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - depth)) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned patterns."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for back in range(1, width + 1):
            symbol = patterns[:, width - back]
            live = np.flatnonzero((back <= lengths) & (low < high))
            unknown = symbol[live] >= len(self.before) - 1  # beyond all symbols of this shard
            high[live[unknown]] = low[live[unknown]]
            live = live[~unknown]
            s = symbol[live]
            low[live] = self.before[s] + self.rank(s, low[live])
            high[live] = self.before[s] + self.rank(s, high[live])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        at, steps, place = at.copy(), np.zeros_like(at), np.full(len(at), -1, np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            done = self.marked[at[open_]]
            here = open_[done]
            place[here] = self.samples[self.mark_rank[at[here]]] + steps[here]
            open_ = open_[~done]
            symbol = self.bwt_at[at[open_]]
            at[open_] = self.before[symbol] + self.rank(symbol, at[open_])
            steps[open_] += 1
        return place


def find(words: list[list[bytes]], windows: Windows, block: int = 2_000_000) -> list[list[tuple[int, int, int]]]:
    """(first word, end, window) of every occurrence in every text of a shard."""
    out: list[list] = [[] for _ in words]
    if not windows.windows:
        return out
    number = windows.vocabulary.get
    kept, docs, places, size = [], [], [], 0

    def close():
        nonlocal kept, docs, places, size
        if kept:
            text, doc, place = (np.concatenate(x) for x in (kept, docs, places))
            index = FMIndex(np.append(text, 0))
            low, high = index.search(windows.table + 1, windows.lengths)
            count = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(count)), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            for spot, w in zip(index.locate(rows).tolist(), which.tolist(), strict=True):
                start = int(place[spot])
                out[int(doc[spot])].append((start, start + int(windows.lengths[w]), w))
        kept, docs, places, size = [], [], [], 0

    for d, own in enumerate(words):
        ids = np.fromiter((number(w, 0) for w in own), np.int64, len(own))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= windows.shortest:
                kept.append(np.append(ids[a:b] + 1, 1))  # 1 separates runs and occurs in no window
                docs.append(np.full(b - a + 1, d))
                places.append(np.arange(a, b + 1))
                size += b - a + 1
        if size >= block:
            close()
    close()
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_parts(benchmark: DataFrame, most: int | None = None) -> list[DataFrame]:
    """The items in parts by hash, each of about ``most`` bytes at most; an item stays whole."""
    most = most or PART_BYTES
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = F.octet_length("text")
    total, largest = items.agg(F.sum(size), F.max(size)).first()
    count = -(-(total or 0) // most)
    if count <= 1:
        return [items]
    items = items.distinct()  # equal rows have equal hashes
    while True:
        part = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(count))
        if items.groupBy(part.alias("part")).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] <= most + largest:
            return [items.filter(part == i) for i in range(count)]
        count *= 2


def load_windows(part: DataFrame) -> Windows:
    """The windows of one part on the driver, which hands them to the tasks."""
    return Windows([(r[0], r[1]) for r in part.select("item_id", "text").collect()])


def search_documents(docs: DataFrame, windows: Windows, keep: list[str] | None = None) -> DataFrame:
    def compute(texts):
        words = [words_of(t) for t in texts]
        found = find(words, windows)
        items = [{i for _, _, w in f for i in windows.owners[w]} for f in found]
        return [[len(w) for w in words], *told(items, found)]

    return append_columns(docs, ["text"], f"n_words long, {TOLD}", compute, keep)


TOLD = "n_hit long, n_items long, items_sha256 string, hit_spans array<struct<first:long,end:long>>"


def told(items: list[set[str]], found: list[list[tuple]]) -> list[list]:
    """The columns of TOLD from the items and the spans of each text."""
    cuts = [merged(f) for f in found]
    digests = [hashlib.sha256(",".join(sorted(own)).encode()).hexdigest() for own in items]
    spans = [[{"first": a, "end": b} for a, b in cut] for cut in cuts]
    return [[sum(b - a for a, b in cut) for cut in cuts], [len(own) for own in items], digests, spans]


def part_hits(docs: DataFrame, row: str, parts: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``row`` and the columns of TOLD of every document with a hit, from one pass over the documents per part."""
    hits = []
    for part in parts:
        windows = load_windows(part)

        def compute(texts, windows=windows):
            found = find([words_of(t) for t in texts], windows)
            items = [sorted({i for _, _, w in f for i in windows.owners[w]}) for f in found]
            return [items, [[{"first": a, "end": b} for a, b in merged(f)] for f in found]]

        hit = append_columns(docs, ["text"], "items array<string>, spans array<struct<first:long,end:long>>", compute, [row])
        hits.append(scratch.materialize(hit.filter(F.size("items") > 0), "part-hits"))
    both = functools.reduce(DataFrame.union, hits).groupBy(row)
    both = both.agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def join(items, spans):
        return told([set(own) for own in items], [[(x["first"], x["end"], 0) for x in own] for own in spans])

    return append_columns(both, ["items", "spans"], TOLD, join, [row])


def search_benchmark(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``search_documents`` for all items, however many."""
    parts = benchmark_parts(benchmark)
    if len(parts) == 1:
        return search_documents(docs, load_windows(parts[0]), keep)
    row = free_name("_row", docs)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "n_items", "items_sha256", "hit_spans")]
    with Scratch(docs.sparkSession) as scratch:
        # Writing the rows fixes their numbers.
        numbered = scratch.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
        counted = append_columns(numbered, ["text"], "n_words long", lambda texts: [[len(words_of(t)) for t in texts]], [*kept, row])
        found = counted.join(part_hits(numbered, row, parts, scratch), row, "left")
        nothing = hashlib.sha256(b"").hexdigest()
        spans = F.coalesce("hit_spans", F.array().cast("array<struct<first:bigint,end:bigint>>")).alias("hit_spans")
        count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")]
        digest = F.coalesce("items_sha256", F.lit(nothing)).alias("items_sha256")
        return materialize(found.select(*kept, "n_words", *count, digest, spans), "benchmark-hits")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*parts, text[at:]])


def remove_passages(docs: DataFrame, windows: Windows) -> DataFrame:
    """The documents without benchmark passages; texts are searched again until none is left.

    A document of which no word remains is dropped; n_chars follows the text.
    """

    def compute(texts, sizes):
        texts, changed = list(texts), set()
        open_ = list(range(len(texts)))
        while open_:
            found = find([words_of(texts[i]) for i in open_], windows)
            open_ = [i for i, f in zip(open_, found, strict=True) if f]
            for i, f in zip(list(open_), [f for f in found if f], strict=True):
                texts[i] = cut_text(texts[i], merged(f))
                changed.add(i)
        gone = [i in changed and not WORD.search(texts[i]) for i in range(len(texts))]
        return [texts, [len(t) if i in changed else n for i, (t, n) in enumerate(zip(texts, sizes, strict=True))], gone]

    columns = docs.columns
    sized = docs if "n_chars" in columns else docs.withColumn("n_chars", F.length("text").cast("long"))
    moved = sized.withColumnsRenamed({"text": "_text", "n_chars": "_n"}).withColumn("_n", F.col("_n").cast("long"))
    kept = [c for c in columns if c not in ("text", "n_chars")]
    cut = append_columns(moved, ["_text", "_n"], "text string, n_chars long, _gone boolean", compute, kept)
    return cut.filter(~F.col("_gone")).select(*columns)


def remove_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``remove_passages`` for all items, however many: documents with hits are cut and searched again in rounds."""
    parts = benchmark_parts(benchmark)
    if len(parts) == 1:
        return remove_passages(docs, load_windows(parts[0]))
    row = free_name("_row", docs)
    with Scratch(docs.sparkSession) as scratch:
        numbered = scratch.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
        open_, clean, changed = numbered.select(row, "text"), [], None
        while True:
            hits = scratch.materialize(part_hits(open_, row, parts, scratch).select(row, "hit_spans"), "passages")
            if changed is not None:
                clean.append(open_.join(hits, row, "left_anti"))
            if hits.isEmpty():
                break

            def cut(texts, spans):
                return [[cut_text(t, [(x["first"], x["end"]) for x in own]) for t, own in zip(texts, spans, strict=True)]]

            found = open_.withColumnRenamed("text", "_whole").join(hits, row)
            changed = open_ = scratch.materialize(append_columns(found, ["_whole", "hit_spans"], "text string", cut, [row]), "cut-texts")
        if changed is None:
            return materialize(numbered.select(*docs.columns), "clean-documents")
        gone = lambda texts: [[not WORD.search(t) for t in texts]]
        new, left, out = (free_name(c, docs) for c in ("_new", "_gone", "_text"))
        cuts = append_columns(functools.reduce(DataFrame.union, clean), ["text"], f"{left} boolean", gone, [row, "text"])
        cuts = cuts.withColumnRenamed("text", out).withColumn(new, F.lit(True))
        both = numbered.join(cuts, row, "left").filter(~F.coalesce(left, F.lit(False)))
        values = {"text": F.when(F.col(new), F.col(out)).otherwise(F.col("text"))}
        if "n_chars" in docs.columns:
            values["n_chars"] = F.when(F.col(new), F.length(out).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return materialize(both.select(*(values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns)), "clean-documents")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = search_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return found.drop("hit_spans").withColumn("contaminated", F.col("n_hit") > 0)
