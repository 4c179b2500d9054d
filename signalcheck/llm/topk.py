"""Exact top-k by inner product with M-trees.

Vectors become integers, ``floor(256 * x)``. Inside a tree every vector gets one more coordinate, so that all have the
same length; the inner product with a query then falls as the distance grows, and the search is one in a metric space.
Equal vectors are one entry that lists the first ``k + 1`` of its rows, which is all that any answer can show.

Entries are dealt to regions (the nearest of at most ``REGIONS`` objects, picked by hash) and, beyond ``TREE_ENTRIES``,
to slices of a region. A task loads one tree of pages: an inner page holds routing objects with covering radius and
distance to the parent object, a leaf page holds entries with that distance. The search opens pages best first. Before a
distance is worked out, the stored parent distance gives a bound by the triangle inequality; what it excludes is never
computed. A bound equal to the k-th score is opened, so ties are seen.

Queries go in blocks. Each first searches one tree of its own region, whose k-th score is a lower bound; then every
other tree that its region's radius does not exclude. Nothing is approximate: regions and slices only change the order.

Null vectors, and those with a null or non-finite component, take no part; nor do those whose squared length as integers
is 2^62 or more, since their scores may not fit a long. Vectors of different lengths never meet. Repeated rows are rows
of their own, a repeated query row gets its own answer; a null vec_id is no query and comes last among ties. Other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalcheck.llm.common import table
from signalcheck.plans.skew import lookup
from signalcheck.session import Scratch, materialize

SCALE = 256
REGIONS = 64
#: Entries of a tree, of a leaf page, objects of an inner page, queries of a block.
TREE_ENTRIES = 16_384
PAGE = 256
FAN = 16
BLOCK = 1_024
#: Bounds are loosened by this share of the squared lengths, far above the error of double numbers.
SLACK = 1e-9
EXACT = 2.0**53


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, v, size): the rows that take part, as integers; ``row`` tells repeated rows apart once stored."""
    components = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2.0**31 / SCALE))
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"), F.col(vector)).filter(F.col(vector).isNotNull())
    rows = rows.filter(F.coalesce(finite, F.lit(False)))
    rows = rows.filter(squares < 2.0**62)
    return rows.select("row", "vec_id", components.cast("array<long>").alias("v")).withColumn("size", F.size("v"))


def entries_of(rows: DataFrame, keep: int) -> DataFrame:
    """(entry, v, size, members): equal vectors once, with their first ``keep`` rows by vec_id; numbered when stored."""
    # The limit of a ranking window is taken before the shuffle too, so a very common vector costs few rows per task.
    ranked = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    first = rows.withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= keep)
    members = F.transform(F.array_sort(F.collect_list(F.struct("at", "row", "vec_id"))), lambda m: F.struct(m["row"].alias("row"), m["vec_id"].alias("vec_id")))
    return first.groupBy("v").agg(members.alias("members")).select(F.monotonically_increasing_id().alias("entry"), "v", F.size("v").alias("size"), "members")


def matrix(column, size: int) -> np.ndarray:
    """One row per vector of an Arrow list column."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


class Tree:
    """An M-tree over the rows of ``vectors``, bulk-loaded top down: seeds of a page take the entries nearest to them.

    A page is (rows, their points, distance of each to the parent object, covering radius of each, child page of each);
    leaves have neither radii nor children.
    """

    def __init__(self, vectors: np.ndarray):
        squares = (vectors.astype(float) ** 2).sum(1)
        self.vectors, self.most = vectors, float(squares.max(initial=0))
        lifted = np.sqrt(np.maximum(self.most - squares, 0))
        self.points = np.concatenate([vectors.astype(float), lifted[:, None]], 1)
        self.pages: list[tuple] = [()]
        rng = np.random.default_rng(3)
        todo = [(0, np.arange(len(vectors)), None)]
        while todo:
            page, rows, parent = todo.pop()
            if len(rows) <= PAGE:
                self.pages[page] = (rows, self.points[rows], self._from(rows, parent), None, None)
                continue
            seeds = rng.choice(rows, FAN, replace=False)
            nearest = self._apart(rows, seeds).argmin(1)
            nearest[np.searchsorted(rows, seeds)] = np.arange(FAN)  # a seed is its own, also where distances round to a tie
            radius, child = np.zeros(FAN), np.zeros(FAN, np.int64)
            for i, seed in enumerate(seeds):
                own = rows[nearest == i]
                radius[i] = self._from(own, seed).max()
                child[i] = len(self.pages)
                self.pages.append(())
                todo.append((child[i], own, seed))
            self.pages[page] = (seeds, self.points[seeds], self._from(seeds, parent), radius, child)

    def _apart(self, rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        a, b = self.points[rows], self.points[seeds]
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T

    def _from(self, rows: np.ndarray, parent) -> np.ndarray:
        if parent is None:
            return np.zeros(len(rows))
        return np.sqrt(((self.points[rows] - self.points[parent]) ** 2).sum(1))

    def scores(self, query: np.ndarray, rows: np.ndarray, points: np.ndarray, exact: bool) -> np.ndarray:
        """Integer products: in double numbers where no partial sum leaves their whole range."""
        if exact:
            return (points[:, :-1] @ query.astype(float)).astype(np.int64)
        return self.vectors[rows] @ query

    def search(self, query: np.ndarray, k: int, counts: np.ndarray, least: int) -> tuple[list[tuple[int, int]], int]:
        """(score, row) of the rows that may be among the first ``k``, and how many rows were compared.

        ``counts`` tells how often a row stands for one; rows that score under ``least`` are left out.
        """
        wide = query.astype(float)
        own = float(wide @ wide)
        exact = own * self.most < EXACT**2
        slack = SLACK * (own + self.most) + 1e-6
        # A score of at least s means a distance of at most sqrt(own + most - 2 s).
        reach = lambda s: float(np.sqrt(max(own + self.most - 2 * s, 0.0) + slack))
        tree_query = np.append(wide, 0.0)
        best: list[tuple[int, int]] = []
        compared = 0
        radius = reach(least)
        waiting = [(0.0, 0, None)]
        while waiting:
            nearest, page, to_parent = heapq.heappop(waiting)
            if nearest > radius:
                break
            rows, points, apart, covers, child = self.pages[page]
            if to_parent is not None:
                # The stored distances exclude objects before their own distance is worked out.
                may = np.abs(to_parent - apart) <= radius + slack + (0.0 if covers is None else covers)
                if not may.all():
                    rows, points = rows[may], points[may]
                    covers, child = (None, None) if covers is None else (covers[may], child[may])
                if not len(rows):
                    continue
            if covers is None:
                compared += len(rows)
                scores = self.scores(query, rows, points, exact)
                good = np.flatnonzero(scores >= least)
                if len(good) > k:  # at most k better ones can be needed; ties of the last stay
                    good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
                if len(good):
                    best = [*best, *zip(scores[good].tolist(), rows[good].tolist(), strict=True)]
                    best, least = first_scores(best, k, counts, least)
                    radius = reach(least)
                continue
            distance = np.sqrt(((points - tree_query) ** 2).sum(1))
            near = np.maximum(distance - covers, 0.0)
            for i in np.flatnonzero(near <= radius + slack).tolist():
                heapq.heappush(waiting, (float(near[i]), int(child[i]), float(distance[i])))
        return best, compared


def first_scores(best: list[tuple[int, int]], k: int, counts: np.ndarray, least: int) -> tuple[list[tuple[int, int]], int]:
    """The best rows until they stand for ``k``, with all ties of the last score; and the score to reach from now on."""
    best = sorted(best, reverse=True)
    held = 0
    for i, (score, row) in enumerate(best):
        held += int(counts[row])
        if held >= k:
            while i + 1 < len(best) and best[i + 1][0] == score:
                i += 1
            return best[: i + 1], max(least, score)
    return best, least


def search_blocks(blocks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(query, score, row, vec_id): per query and tree the rows that may be among the first ``k``.

    ``blocks`` (tree, block, query, q, least) meets ``trees`` (tree, size, entry, v, members), a group being one block and
    one tree; a tree is repeated once per block.
    """
    wanted = blocks.select(F.col("tree").alias("at"), F.col("block").alias("part")).distinct()
    copies = trees.withColumnRenamed("tree", "at").join(wanted, "at")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "score": [], "row": [], "vec_id": []}
        if len(left) and len(right):
            size = right.column("size")[0].as_py()
            right = right.sort_by("entry")
            vectors = matrix(right.column("v"), size)
            queries = matrix(left.column("q"), size)
            members = right.column("members").to_pylist()
            counts = np.fromiter(map(len, members), np.int64, len(members))
            tree = Tree(vectors)
            lows = left.column("least").to_pylist()
            for i, name in enumerate(left.column("query").to_pylist()):
                found, _ = tree.search(queries[i], k, counts, -(2**62) if lows[i] is None else lows[i])
                for score, row in found:
                    for member in members[row]:
                        out["query"].append(name)
                        out["score"].append(score)
                        out["row"].append(member["row"])
                        out["vec_id"].append(member["vec_id"])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    grouped = blocks.groupBy("tree", "block").cogroup(copies.groupBy("at", "part"))
    return grouped.applyInArrow(run, "query long, score long, row long, vec_id long")


def first_of(found: DataFrame, k: int, by: str = "query") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_fields(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(name, kind) for name, kind in added.items()])


def region_of(heads: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(region, size, object): at most REGIONS per vector length."""
    return [(i, r.size, np.array(r.v, np.float64)) for i, r in enumerate(heads.orderBy("size", F.xxhash64("v"), "v").collect())]


def add_region(df: DataFrame, heads: list, vector: str) -> DataFrame:
    """``df`` with the region of the nearest object of the same vector length, the distance to it, and the squared length."""
    schema = with_fields(df, region=T.IntegerType(), apart=T.DoubleType(), square=T.DoubleType())
    sizes = {}
    for region, size, point in heads:
        sizes.setdefault(size, ([], []))
        sizes[size][0].append(region)
        sizes[size][1].append(point)
    objects = {s: (np.array(r), np.stack(p)) for s, (r, p) in sizes.items()}

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            lengths = np.array(batch.column(batch.schema.get_field_index("size")).to_pylist(), np.int64)
            region, apart, square = np.zeros(len(lengths), np.int32), np.zeros(len(lengths)), np.zeros(len(lengths))
            for size in set(lengths.tolist()):
                at = np.flatnonzero(lengths == size)
                names, points = objects[size]
                own = np.array(column.take(pa.array(at)).to_pylist(), np.float64).reshape(len(at), size)
                distance = ((own * own).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * own @ points.T) if size else np.zeros((len(at), len(points)))
                near = distance.argmin(1)
                region[at], square[at] = names[near], (own * own).sum(1)
                apart[at] = np.sqrt(((own - points[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(apart), pa.array(square)], names=[*batch.schema.names, "region", "apart", "square"])

    return df.mapInArrow(run, schema)


def slices(count: Column, most: int) -> Column:
    return F.ceil(count / F.lit(most)).cast("int")


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the first ``k`` other rows of each row whose key is divisible by ``every``."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.materialize(whole_vectors(df, key, vector), "topk-rows")
        entries = scratch.materialize(entries_of(rows, k + 1), "topk-entries")
        asked = rows.filter(F.col("vec_id") % every == 0)
        queries = asked.groupBy("v").agg(F.count("*").alias("n"), F.min("row").alias("query"), F.first("size").alias("size"))
        queries = scratch.materialize(queries, "topk-queries")
        # Objects are dealt by hash; every vector length has its own, at most REGIONS.
        ranked = entries.select("size", "v", F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("v"), "v")).alias("at")).filter(F.col("at") <= REGIONS)
        heads = region_of(ranked)
        if not heads:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        placed = scratch.materialize(add_region(entries, heads, "v"), "topk-placed")
        sizes = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.max("square").alias("most")).collect()
        cut = {r.region: (-(-r.n // TREE_ENTRIES), r.radius, r.most) for r in sizes}
        parts = F.element_at(F.create_map(*(F.lit(x) for r, c in cut.items() for x in (r, c[0]))), F.col("region"))
        trees = placed.select(
            F.struct("region", F.pmod(F.xxhash64("entry"), parts).cast("int").alias("slice")).alias("tree"), "size", "entry", "v", "members"
        )
        trees = scratch.materialize(trees, "topk-trees")
        met = add_region(queries, heads, "v")
        blocks = max(1, -(-queries.count() // BLOCK))
        met = met.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumnRenamed("v", "q")
        met = scratch.materialize(met, "topk-met")
        home = F.struct("region", F.pmod(F.xxhash64("query", F.lit(1)), parts).cast("int").alias("slice"))
        # A query may stand in a region without entries of its own only if no vector of its length exists.
        seed = met.filter(parts.isNotNull()).select(home.alias("tree"), "block", "query", "q", F.lit(None).cast("long").alias("least"))
        seeded = scratch.materialize(first_of(search_blocks(seed, trees, k + 1), k + 1), "topk-seeded")
        bound = seeded.filter(F.col("rank") == k + 1).select("query", F.col("score").alias("least"))
        reached = with_regions(met.join(bound, "query", "left"), heads, cut)
        visits = reached.join(seed.select("query", F.col("tree").alias("home")), "query")
        visits = visits.select(F.col("at").alias("region"), "block", "query", "q", "least", "home").withColumn(
            "tree", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda s: F.struct(F.col("region"), s.cast("int").alias("slice"))))
        )
        visits = visits.filter(F.col("tree") != F.col("home")).select("tree", "block", "query", "q", "least")
        found = search_blocks(visits, trees, k + 1).unionByName(seeded.drop("rank"))
        answers = first_of(found, k + 1).drop("rank")
        wide = answers.groupBy("query").agg(F.collect_list(F.struct("score", "row", "vec_id")).alias("hits"))
        wide = scratch.materialize(queries.select("v", "query", "n").join(wide, "query").select("v", "n", "hits"), "topk-answers")
        own = asked.select("v", F.col("row").alias("own"), F.col("vec_id").alias("query_id"))
        # k + 1 answers for equal queries: each leaves out its own row. A very common vector is cut by its row count.
        hits = lookup(own, wide, "v", "n", F.col("own")).select("own", "query_id", F.explode("hits").alias("hit"))
        hits = hits.select("own", "query_id", "hit.*").filter(F.col("row") != F.col("own"))
        return materialize(first_of(hits, k, "own").select("query_id", "rank", "vec_id", "score"), "topk")


def with_regions(met: DataFrame, heads: list, cut: dict) -> DataFrame:
    """One row per query and region that may hold a score of at least its bound, the region being ``at``."""
    schema = with_fields(met, at=T.IntegerType())
    known = [(r, s, p, cut[r][1], cut[r][2]) for r, s, p in heads if r in cut]

    def run(batches):
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("size")).to_pylist()
            vectors = batch.column(batch.schema.get_field_index("q")).to_pylist()
            lows = batch.column(batch.schema.get_field_index("least")).to_pylist()
            rows, at = [], []
            for i, (size, vector, low) in enumerate(zip(sizes, vectors, lows, strict=True)):
                q = np.array(vector, np.float64)
                own = float(q @ q)
                for region, length, point, radius, most in known:
                    if length != size:
                        continue
                    near = max(float(np.sqrt(((q - point) ** 2).sum())) - radius, 0.0)
                    best = min((own + most - near * near) / 2, float(q @ point) + np.sqrt(own) * radius)
                    if low is None or best + SLACK * (own + most) + 1e-6 >= low:
                        rows.append(i)
                        at.append(region)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "at"])

    return met.mapInArrow(run, schema)


def op11_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
