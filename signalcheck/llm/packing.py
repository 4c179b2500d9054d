"""Best-fit packing by swap-based local search.

Documents become token ids and an end id; only longer ones are cut. Pieces are dealt by hash into blocks of a fixed
mean size, so no task grows with the table. A block starts from best fit by falling length; then moves, one-for-one
and two-for-one exchanges between underfull bins raise the sum of squared fills until bins empty or nothing helps.

A null text counts as empty and gives the end id alone. Repeated rows are packed like others; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from unicodedata import category, is_normalized

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalcheck.llm.common import Bounded, append_columns, table
from signalcheck.llm.token_counts import byte_letters
from signalcheck.session import materialize

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = (0).to_bytes(4, "little")
BLOCK_PIECES = 4_000
#: Every pattern of the vocabulary stops at white space, so what stands between is encoded by itself.
CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_BYTES = byte_letters()
_encoders: dict[str, Callable[[str], bytes]] = {}


def _plain_patterns() -> tuple[re.Pattern, re.Pattern]:
    """The vocabulary's pre-tokens of lower-case Latin, Greek, Cyrillic and common signs, and any character beyond those.

    Within these characters the library's normaliser is lower case alone, as long as the text is in NFC.
    """
    common = [chr(c) for c in (*range(0x80, 0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F))]
    common = [c for c in common if c != "Σ" and len(c.lower()) == 1 and c.lower() in common]
    letters = "".join(c for c in common if category(c)[0] == "L")
    numbers = "".join(c for c in common if category(c)[0] == "N")
    parts = f"'(?:[stmd]|re|ve|ll)|[a-z{letters}]+|[0-9{numbers}]|[^\\t-\\r \x85\xa0a-z0-9{letters}{numbers}]+"
    return re.compile(parts), re.compile(f"[^\\x00-\\x7f{''.join(map(re.escape, common))}]")


PARTS, BEYOND = _plain_patterns()


def encoder(path: str) -> Callable[[str], bytes]:
    """Token ids of a text, as bytes. Plain texts are put together from remembered pre-tokens, others from chunks."""
    if path not in _encoders:
        library = Tokenizer.from_file(path)
        encode, tokenize = library.encode, library.model.tokenize
        special = [t.content for t in library.get_added_tokens_decoder().values()]

        def part_ids(part: str) -> bytes:
            return np.array([t.id for t in tokenize("".join(map(_BYTES.__getitem__, part.encode())))], "<u4").tobytes()

        parts = Bounded(part_ids)
        chunks = Bounded(lambda chunk: np.array(encode(chunk, add_special_tokens=False).ids, "<u4").tobytes(), 100_000)

        def ids_of(text: str) -> bytes:
            if BEYOND.search(text) or not is_normalized("NFC", text) or any(s in text for s in special):
                return b"".join([chunks[c] for c in CHUNK.findall(text)])
            return b"".join([parts[p] for p in PARTS.findall(text.lower())])

        _encoders[path] = ids_of
    return _encoders[path]


def to_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def compute(texts):
        ids_of = encoder(path)
        out = []
        for text in texts:
            ids = ids_of(text or "") + END
            cuts = range(0, len(ids), 4 * capacity)
            parts = [ids[a : a + 4 * capacity] for a in cuts]
            out.append([
                {"piece": i, "start": i * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for i, p in enumerate(parts)
            ])
        return [out]

    ddl = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    return append_columns(docs, ["text"], ddl, compute, ["doc_id"]).select("doc_id", F.inline("pieces"))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: each piece, longest first, goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    space: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect_left(space, (lengths[i], -1))
        if at < len(space):
            free, b = space.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        insort(space, (free - lengths[i], b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: the emptiest bin gives pieces to others, or swaps them, while squared fill grows.

    Every underfull bin gives, and every bin with room takes; one look covers all pieces of the block.
    """
    bins = [list(b) for b in bins]
    size = np.array(lengths, np.int64)
    home = np.zeros(len(size), np.int64)
    for b, members in enumerate(bins):
        home[members] = b
    fill = np.bincount(home, size, len(bins)).astype(np.int64)
    full = np.iinfo(np.int64).max
    waiting = np.where(fill < capacity, fill, full)  # fill of the bins that may still give

    def exchange(a: int) -> tuple[tuple, tuple, int] | None:
        """Pieces out of bin a, pieces back, and the bin they go to: the fullest that takes any."""
        mine = bins[a]
        outs = [(i,) for i in mine] + [(i, k) for n, i in enumerate(mine) for k in mine[n + 1 :]]
        sums = np.array([sum(lengths[i] for i in o) for o in outs])
        # Squared fill grows when the taker ends fuller than the giver was.
        whole = np.where((np.arange(len(bins)) != a) & (fill > 0), fill, -1)
        best, found = -1, None
        alone = sums[: len(mine)]
        for n, s in enumerate(alone):
            takes = np.where((whole + s <= capacity) & (whole + s > fill[a]), whole, -1)
            b = int(takes.argmax())
            if takes[b] > best:
                best, found = takes[b], (outs[n], (), b)
        theirs = whole[home]
        for n, s in enumerate(sums):
            delta = s - size
            takes = np.where((delta > 0) & (theirs + delta <= capacity) & (theirs + delta > fill[a]), theirs, -1)
            j = int(takes.argmax())
            if takes[j] > best:
                best, found = takes[j], (outs[n], (j,), int(home[j]))
        return found

    least = -(-int(size.sum()) // capacity)  # fewer bins cannot hold the pieces
    while np.count_nonzero(fill) > least and waiting.min() < full:
        a = int(waiting.argmin())
        found = exchange(a)
        if found is None:
            waiting[a] = full  # nothing helps this bin until it changes
            continue
        out, back, b = found
        bins[a] = [i for i in bins[a] if i not in out] + list(back)
        bins[b] = [i for i in bins[b] if i not in back] + list(out)
        home[list(out)], home[list(back)] = b, a
        for c in (a, b):
            fill[c] = sum(lengths[i] for i in bins[c])
            waiting[c] = fill[c] if 0 < fill[c] < capacity else full
    return [b for b in bins if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    # The number of a stored row deals equal rows over all blocks.
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-pieces.count() // block))
    salted = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long"))
    kept = [c for c in pieces.columns if c != "row"]

    def one(frame):
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False).reset_index(drop=True)
        lengths = frame["length"].tolist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = int(frame["block"].iloc[0]) << 32
        for b, members in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
        return frame.assign(sequence_id=sequence, offset=offset).drop(columns=["block", "row"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.select(kept).dtypes) + ", sequence_id long, offset long"
    return salted.groupBy("block").applyInPandas(one, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(to_pieces(docs, public_tokenizers.path(VOCABULARY)))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
