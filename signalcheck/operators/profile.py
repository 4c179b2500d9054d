"""Table profile: missing cells, summary, histogram, box statistics, correlations, contingency, pair counts.

Each item is one aggregate with map-side combine (plus the passes of an exact
percentile); only rows of the size of the column list or the bin grid leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalcheck.functions.columns import is_missing
from signalcheck.operators.quantile import exact_quantiles

BINS = 50
WHISKER = 1.5
#: Numbers of the counters and sums of all classes that a task holds; beyond that it hands them on.
HELD_NUMBERS = 8_000_000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _valid(name: str) -> Column:
    v = _q(name).cast("double")
    return F.when(~F.isnan(v), v)


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column; NaN is missing too."""
    counts = df.agg(*[F.count_if(is_missing(_q(c), kind)).alias(c) for c, kind in df.dtypes])
    cells = [F.struct(F.lit(c).alias("column_name"), _q(c).alias("n_null")) for c in df.columns]
    return counts.select(F.inline(F.array(*cells)))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(_valid(c)).alias("n"),
                F.avg(_valid(c)).alias("mean"),
                F.stddev_samp(_valid(c)).alias("std"),
                F.min(_valid(c)).alias("min"),
                *[F.lit(v).cast("double").alias(n) for n, v in zip(("q25", "q50", "q75"), quartiles[c], strict=True)],
                F.max(_valid(c)).alias("max"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return stats.select(F.inline(F.array(*stats.columns)))


def _long(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _valid(c).alias("v")) for c in columns])
    return df.select(*keep, F.inline(cells)).filter(F.col("v").isNotNull())


def _ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: lowest and highest value."""
    ends = df.agg(
        *[
            F.struct(F.lit(c).alias("column_name"), F.min(_valid(c)).alias("lo"), F.max(_valid(c)).alias("hi")).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return ends.select(F.inline(F.array(*ends.columns))).filter(F.col("lo").isNotNull())


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / bins
    # A constant column has zero width and falls into the first bin.
    return F.least(F.coalesce(F.floor(F.try_divide(value - lo, width)), F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """Counts in ``bins`` equal bins from minimum to maximum, empty bins included, last bin closed."""
    ranges = _ranges(df, columns)  # as many rows as columns were asked for
    found = (
        _long(df, columns)
        .join(F.broadcast(ranges), "column_name")
        .groupBy("column_name", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = ranges.select(
        "column_name", "lo", ((F.col("hi") - F.col("lo")) / bins).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return grid.join(found, ["column_name", "bin"], "left").select(
        "column_name",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, ...]]:
    fences = {}
    for column, (q25, q50, q75) in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
        if q25 is not None:
            reach = WHISKER * (q75 - q25)
            fences[column] = (q25, q50, q75, q25 - reach, q75 + reach)
    return fences


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends (last value within 1.5 interquartile ranges) and outlier count per column."""
    rows = []
    for i, (column, (q25, q50, q75, low, high)) in enumerate(_fences(df, columns).items()):
        v = _valid(column)
        inside = F.when((v >= low) & (v <= high), v)
        rows.append(
            F.struct(
                F.lit(column).alias("column_name"),
                F.lit(q25).alias("q25"),
                F.lit(q50).alias("q50"),
                F.lit(q75).alias("q75"),
                F.min(inside).alias("whisker_low"),
                F.max(inside).alias("whisker_high"),
                F.count_if((v < low) | (v > high)).alias("n_outliers"),
            ).alias(f"c{i}")
        )
    stats = df.agg(*rows)
    return stats.select(F.inline(F.array(*stats.columns)))


def box_outliers(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """The points beyond the whiskers: key, column and value."""
    cells = []
    for column, (*_, low, high) in _fences(df, columns).items():
        v = _valid(column)
        cells.append(F.struct(F.lit(column).alias("column_name"), F.when((v < low) | (v > high), v).alias("value")))
    return df.select(key, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def _classes(column: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """The different values of a batch, NULL included, each with its rows."""
    coded = column.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    limits = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for i, value in enumerate(coded.dictionary.to_pylist()):
        yield value, order[limits[i] : limits[i + 1]]


def _partials(
    df: DataFrame, columns: Sequence[str], by: str | None, size: int, schema: str, add: Callable, rows: Callable
) -> DataFrame:
    """One set of numbers per task and class: ``add(old or None, matrix)`` takes in the rows of a batch, ``rows`` hands on.

    ``rows`` gives the Arrow columns of ``schema`` for the numbers of one class, with the class put first.
    """
    kind = df.schema[by] if by else None
    out = T.StructType(([kind] if by else []) + T.StructType.fromDDL(schema).fields)
    most = max(1, HELD_NUMBERS // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        typed = None

        def handed():
            for value, numbers in held.items():
                arrays = rows(numbers)
                if by:
                    arrays = [pa.array([value] * len(arrays[0]), typed), *arrays]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = np.stack([batch.column(batch.schema.get_field_index(f"c{i}")).to_numpy(zero_copy_only=False) for i in range(len(columns))], 1)
            if not by:
                held[None] = add(held.get(None), matrix)
                continue
            column = batch.column(batch.schema.get_field_index(by))
            typed = column.type
            for value, at in _classes(column):
                held[value] = add(held.get(value), matrix[at])
                if len(held) > most:
                    yield from handed()
        if not by and not held:
            held[None] = add(None, np.zeros((0, len(columns))))
        yield from handed()

    return df.mapInArrow(run, out)


def _moments(old: np.ndarray | None, matrix: np.ndarray) -> np.ndarray:
    """Sums over the rows where both columns of a pair are filled, as matrix products.

    Planes: rows, sum and squares of the first, products, infinite cells, least and greatest of the first.
    """
    filled = ~np.isnan(matrix)
    endless = np.isinf(matrix)
    m, e = filled.astype(float), endless.astype(float)
    x = np.where(filled & ~endless, matrix, 0.0)
    width = matrix.shape[1]
    least, most = np.full((width, width), np.inf), np.full((width, width), -np.inf)
    for j in range(width):
        part = matrix if filled[:, j].all() else matrix[filled[:, j]]
        if len(part):
            least[:, j] = np.fmin.reduce(part, 0)
            most[:, j] = np.fmax.reduce(part, 0)
    least, most = np.where(np.isnan(least), np.inf, least), np.where(np.isnan(most), -np.inf, most)
    new = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x, e.T @ m + m.T @ e, least, most])
    if old is None:
        return new
    return np.concatenate([old[:5] + new[:5], np.minimum(old[5:6], new[5:6]), np.maximum(old[6:], new[6:])])


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are filled, both orders.

    NULL where a column is constant, empty or infinite there. Each task turns its rows, centred on the column means,
    into one matrix of sums per class; the sums of the tasks are added.
    """
    columns = list(columns)
    # Centred sums lose no digits to a large mean; one row with a number per column.
    means = df.agg(*[F.avg(F.when(F.abs(_valid(c)) < float("inf"), _valid(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    keep = [by] if by else []
    centred = df.select(*keep, *[(_valid(c) - F.lit(means[i] or 0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    at = np.array(list(combinations_with_replacement(range(len(columns)), 2))).reshape(-1, 2)
    i, j = at[:, 0], at[:, 1]

    def rows(sums: np.ndarray) -> list[pa.Array]:
        n, s, q, p, e, lo, hi = sums
        cells = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j], e[i, j], lo[i, j], hi[i, j], lo[j, i], hi[j, i]]
        return [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, cells)]

    names = ["n", "sx", "sy", "qx", "qy", "p", "e", "lx", "hx", "ly", "hy"]
    schema = "i int, j int, " + ", ".join(f"{name} double" for name in names)
    partial = _partials(centred, columns, by, 7 * len(columns) ** 2, schema, _moments, rows)
    folds = [F.min(c).alias(c) if c[0] == "l" else F.max(c).alias(c) if c[0] == "h" else F.sum(c).alias(c) for c in names]
    total = partial.groupBy(*keep, "i", "j").agg(*folds)
    c = F.col
    n = F.nullif("n", F.lit(0.0))
    spread = (c("qx") - c("sx") * c("sx") / n) * (c("qy") - c("sy") * c("sy") / n)
    varies = (c("n") > 0) & (c("e") == 0) & (c("lx") < c("hx")) & (c("ly") < c("hy")) & (spread > 0)
    r = F.when(varies, F.when(c("i") == c("j"), F.lit(1.0)).otherwise((c("p") - c("sx") * c("sy") / n) / F.sqrt(F.nullif(F.greatest(spread, F.lit(0.0)), F.lit(0.0)))))
    name = F.array(*map(F.lit, columns))
    first, second = name[c("i")], name[c("j")]
    cells = F.array(F.struct(first.alias("x"), second.alias("y"), r.alias("corr")), F.struct(second.alias("x"), first.alias("y"), r.alias("corr")))
    return total.select(*keep, F.inline(F.when(c("i") == c("j"), F.slice(cells, 1, 1)).otherwise(cells)))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence | None = None, most: int = 1_000) -> DataFrame:
    """Counts of each row value against every column value found, 0 where a pair never occurs.

    ``values`` names the columns instead, and then has to hold every value that is to be counted. Column names must be
    known to the planner: more than ``most`` values are an error, not a silent cut.
    """
    if values is None:
        found = df.select(columns).filter(F.col(columns).isNotNull()).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{columns} has more than {most} values; count by both columns instead")
        values = sorted(r[0] for r in found)
    cells = [F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values]
    return df.filter(F.col(rows).isNotNull()).groupBy(rows).agg(*cells)


def pair_bins(df: DataFrame, columns: Sequence[str], bins: int = BINS, by: str | None = None) -> DataFrame:
    """Point counts on a ``bins`` × ``bins`` grid for every column pair, by class if ``by`` is given.

    This is the data of a scatter plot in a size that does not grow with the table.
    """
    columns = list(columns)
    ends = {r.column_name: (r.lo, r.hi) for r in _ranges(df, columns).collect()}  # a row per column that was asked for
    missing = F.lit(-1)
    places = [
        F.coalesce(F.when(_valid(c).isNotNull(), _bin(_valid(c), F.lit(ends[c][0]), F.lit(ends[c][1]), bins)), missing) if c in ends else missing
        for c in columns
    ]
    keep = [by] if by else []
    placed = df.select(*keep, *[p.cast("int").alias(f"c{i}") for i, p in enumerate(places)])
    pairs = list(combinations(range(len(columns)), 2))

    def add(old: np.ndarray | None, matrix: np.ndarray) -> np.ndarray:
        counts = np.zeros((len(pairs), bins * bins), np.int64) if old is None else old
        for at, (a, b) in enumerate(pairs):
            x, y = matrix[:, a].astype(np.int64), matrix[:, b].astype(np.int64)
            both = (x >= 0) & (y >= 0)
            counts[at] += np.bincount((x * bins + y) if both.all() else (x * bins + y)[both], minlength=bins * bins)
        return counts

    def rows(counts: np.ndarray) -> list[pa.Array]:
        pair, cell = np.nonzero(counts)
        names = [np.array(columns, object)[[p[side] for p in pairs]][pair] if len(pair) else [] for side in (0, 1)]
        return [
            *(pa.array(list(n), pa.string()) for n in names), pa.array((cell // bins).astype(np.int32)), pa.array((cell % bins).astype(np.int32)),
            pa.array(counts[pair, cell]),
        ]

    schema = "x string, y string, bin_x int, bin_y int, n long"
    partial = _partials(placed, columns, by, max(1, len(pairs)) * bins * bins, schema, add, rows)
    return partial.groupBy(*keep, "x", "y", "bin_x", "bin_y").agg(F.sum("n").alias("n"))
