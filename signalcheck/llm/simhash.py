"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is set when over half of the shingle hashes set it. Equal fingerprints become one node. Two
fingerprints within the radius agree on some three of six bit blocks, so they meet under at least one of twenty
keys. Inside a key their Hamming distances to fixed reference fingerprints are compared: by the triangle inequality
a pair whose coordinates differ by more than the radius is discarded, and survivors are verified. A key returns a
star for each of its components, never pairs; the stars are united by large-star and small-star steps.

Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id keep their row and get
the smallest doc_id of their component. Repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import append_columns, free_name, table
from signalcheck.plans.skew import lookup
from signalcheck.session import Scratch, materialize

RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
PIVOTS = 16
GROUP = 50_000
#: A fingerprint of more rows is joined in several tasks.
ROWS_PER_TASK = 100_000


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    count = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=42), shingles), ">u8", count)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, 65_536):
        ones += np.unpackbits(hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big", signed=True)


def add_fingerprints(docs: DataFrame, size: int = 3, keep: list[str] | None = None) -> DataFrame:
    return append_columns(docs, ["text"], "fp long", lambda texts: [[fingerprint(t, size) for t in texts]], keep)


def pivots() -> np.ndarray:
    """Reference fingerprints half of whose bits differ pairwise: rows of a Hadamard matrix."""
    place = np.arange(64, dtype=np.uint64)
    rows = [np.bitwise_count(place & np.uint64(4 * i + 3)) & 1 for i in range(PIVOTS)]
    return np.array([int("".join(map(str, r)), 2) for r in rows], np.uint64)


def stars(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(smallest, member) of every component that distances up to the radius form among distinct fingerprints."""
    prints = np.sort(prints.astype(np.int64))
    bits = prints.view(np.uint64)
    far = np.bitwise_count(bits[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.argsort(far[:, 0], kind="stable")  # one coordinate sorts the rows, so a window holds the candidates
    bits, prints, far = bits[order], prints[order], far[order]
    first = far[:, 0]
    left = np.ones(len(prints), bool)
    out = []
    for seed in range(len(prints)):
        if not left[seed]:
            continue
        left[seed] = False
        members, queue = [prints[seed]], [seed]
        while queue:
            x = queue.pop()
            low = np.searchsorted(first, first[x] - radius, "left")
            high = np.searchsorted(first, first[x] + radius, "right")
            near = np.flatnonzero(left[low:high]) + low
            for c in range(1, PIVOTS):
                if len(near) < 8:
                    break
                near = near[np.abs(far[near, c] - far[x, c]) <= radius]
            near = near[np.bitwise_count(bits[near] ^ bits[x]) <= radius]
            left[near] = False
            members.extend(prints[near])
            queue.extend(near.tolist())
        root = min(members)
        out.extend((int(root), int(m)) for m in members if m != root)
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks() -> list[int]:
    """The twenty bit masks that fix three of the six blocks."""
    cuts = np.cumsum((0, *BLOCKS)).tolist()
    blocks = [((1 << size) - 1) << cut for size, cut in zip(BLOCKS, cuts, strict=False)]
    return [signed(sum(three)) for three in combinations(blocks, 3)]


def narrower(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that fix, next to the bits of ``mask``, one of radius + 1 parts of its free bits.

    Two fingerprints within the radius that agree on ``mask`` agree on at least one of these too.
    """
    free = [b for b in range(64) if not mask >> b & 1]
    return [signed(mask % (1 << 64) | sum(1 << int(b) for b in part)) for part in np.array_split(free, radius + 1)]


def with_masks(rows: DataFrame, masks) -> DataFrame:
    """(fp, key) for every mask of a row; a key is a mask and the fingerprint's bits under it."""
    keys = F.transform(masks, lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("bits")))
    return rows.select("fp", F.explode(keys).alias("key"))


def stars_by_key(keyed: DataFrame) -> DataFrame:
    grouped = keyed.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def compute(groups):
        return [[[{"a": a, "b": b} for a, b in stars(np.array(g, np.int64))] for g in groups]]

    found = append_columns(grouped, ["fps"], "edges array<struct<a:long,b:long>>", compute, [])
    return found.select(F.explode("edges").alias("e")).select("e.a", "e.b")


def links(nodes: DataFrame, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """Star edges (a, b), a < b, among distinct fingerprints; single keys never reach Python.

    A key of more than ``group`` fingerprints is split by narrower masks, twice if need be. Then at least 45 bits are fixed,
    so no key can hold more than 2**19 distinct fingerprints.
    """
    scratch = scratch or Scratch(nodes.sparkSession)
    masks = block_masks()
    keyed = with_masks(nodes, F.array(*map(F.lit, masks)))
    found = []
    for _ in range(2):
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group)
        large = scratch.materialize(sizes.select("key"), "large-keys")
        if large.isEmpty():
            break
        found.append(stars_by_key(keyed.join(large, "key", "left_anti")))
        inner = {m: narrower(m) for m in masks}
        named = F.create_map(*(x for m, parts in inner.items() for x in (F.lit(m), F.array(*map(F.lit, parts)))))
        keyed = with_masks(keyed.join(large, "key", "left_semi"), named[F.col("key.mask")]).distinct()
        masks = sorted({m for parts in inner.values() for m in parts})
    return functools.reduce(DataFrame.union, found, stars_by_key(keyed)).distinct()


def components(edges: DataFrame, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node of its component.

    Alternates large-star and small-star; each round is written to the shared folder, which cuts the lineage.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.materialize(edges.select("a", "b"), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()
        large = large.filter("a <> b")
        down = large.select(F.col("b").alias("x"), F.col("a").alias("y"))  # x > y
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("m").alias("a"), "y").filter("a <> y").select("a", F.col("y").alias("b"))
        edges = scratch.materialize(small.union(low.select(F.col("m").alias("a"), F.col("x").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """fp, rows, root (one fingerprint of its component) and component_id of every distinct fingerprint."""
    with Scratch(prints.sparkSession) as scratch:
        nodes = scratch.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "nodes")
        roots = components(links(nodes.select("fp"), scratch=scratch), scratch=scratch).withColumnRenamed("node", "fp")
        placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        return materialize(placed.join(least, "root").select("fp", "rows", "root", "component_id"), "classes")


def own_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    return materialize(add_fingerprints(docs.select("doc_id", "text"), size, ["doc_id"]), "fingerprints")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = own_fingerprints(docs, size)
    named = fingerprint_classes(prints).select("fp", "rows", "component_id")
    # Rows of one fingerprint may be a third of the table; they are cut by their number.
    return lookup(prints, named, "fp", "rows", F.col("doc_id"), rows_per_task=ROWS_PER_TASK).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row of each component: that with the smallest doc_id, any one where all its doc_ids are null.

    Equal rows collapse; rows that share a doc_id but not a text stay apart.
    """
    fp, root = free_name("_fp", docs), free_name("_root", docs)
    named = fingerprint_classes(own_fingerprints(docs, size))
    first = named.filter(F.col("component_id").isNotNull()).select(F.col("component_id").alias("doc_id")).distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    loose = append_columns(
        docs.filter(F.col("doc_id").isNull()), ["text"], f"{fp} long", lambda texts: [[fingerprint(t, size) for t in texts]]
    )
    nameless = named.filter(F.col("component_id").isNull()).select(F.col("fp").alias(fp), F.col("root").alias(root))
    return kept.unionByName(loose.join(nameless, fp).dropDuplicates([root]).select(*docs.columns))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
