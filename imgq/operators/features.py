"""Descriptor matching and ranking of values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType


def distance(a: Column, b: Column, p: float = 2) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if p == 1:
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    if p == 2:
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x))
    return F.pow(F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(float(p)))), F.lit(1 / p))


#: Queries that meet a block of the other rows at once, and the tasks that a search has at least.
QUERY_ROWS = 32768
LEAST_TASKS = 32


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _nearest_two(q: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, p: float, one_table: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The two nearest rows (ties: smallest id) of each query, some queries at a time.

    Squared distances by products, short of the query's own square, say which
    come into question, with room for their rounding; those are measured element
    by element.
    """
    if not (len(q) and len(ids)):
        return []
    out, step = [], max(1, (1 << 21) // len(ids))
    a, b, twice = (x * x).sum(1), (y * y).sum(1), np.ascontiguousarray(-2 * y.T)
    bad, most_b = np.flatnonzero(~np.isfinite(b)), b[np.isfinite(b)].max(initial=0.0)
    sorter = np.argsort(ids, kind="stable")
    first_own, last_own = (np.searchsorted(ids, q, side, sorter) for side in ("left", "right"))
    for k in range(0, len(q), step):
        at = slice(k, k + step)
        if p == 2:
            rough, room = x[at] @ twice, 1e-9 * (a[at] + most_b)
            rough += b
            rough[:, bad] = rough[~np.isfinite(a[at])] = np.inf
        else:
            rough, room = sum(np.abs(x[at, c, None] - y[None, :, c]) ** p for c in range(x.shape[1])), 0.0
            rough[np.isnan(rough)] = np.inf
        if one_table:
            for i, (f, t) in enumerate(zip(first_own[at], last_own[at], strict=True)):
                rough[i, sorter[f:t]] = np.inf
        row, first = np.arange(len(rough)), rough.argmin(1)
        least = rough[row, first]
        rough[row, first] = np.inf
        most = rough.min(1) + room
        rough[row, first] = least
        i, j = np.divmod(np.flatnonzero(rough <= np.where(most < np.inf, most, np.finfo(float).max)[:, None]), len(ids))
        i += k
        d = np.zeros(len(i))
        for c in range(x.shape[1]):
            d += np.abs(x[i, c] - y[j, c]) ** p if p != 2 else (x[i, c] - y[j, c]) ** 2
        d = d ** (1 / p) if p not in (1, 2) else np.sqrt(d) if p == 2 else d
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((q[i[place < 2]], ids[j[place < 2]], d[place < 2]))
    return out


def match_descriptors(
    queries: DataFrame, other: DataFrame, p: float = 2, max_distance: float | None = None, max_ratio: float = 1.0, block_rows: int = 32768, one_table: bool = False
) -> DataFrame:
    """The nearest of ``other`` (id, descriptor) for each of ``queries`` (q, wanted).

    All queries stand against all rows of ``other``, in blocks of about
    ``block_rows`` of them and ``QUERY_ROWS`` queries, in smaller ones where that
    makes fewer than ``LEAST_TASKS``; the two nearest of each block are merged.
    ``one_table``: both have ids of one table, so
    that a row is not its own match.
    """
    chunks = -(-max(1, queries.count()) // QUERY_ROWS)
    blocks = max(-(-max(1, other.count()) // block_rows), -(-LEAST_TASKS // chunks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    numbers = lambda t, c: (F.col(c) if t.schema[c].dataType == ArrayType(FloatType()) else F.col(c).cast("array<double>")).alias(c)
    asked = queries.select("q", numbers(queries, "wanted"), part("q", chunks).alias("_c"), every(blocks).alias("_b"))
    held = other.select("id", numbers(other, "descriptor"), part("id", blocks).alias("_b"), every(chunks).alias("_c"))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        q, x = a.column("q").to_numpy(), _matrix(a.column("wanted"))
        ids, y = b.column("id").to_numpy(), _matrix(b.column("descriptor"))
        found = _nearest_two(q, x, ids, y, p, one_table)
        parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [q[:0], ids[:0], np.zeros(0)]
        return pa.table(parts, names=["q", "id", "d"])

    kinds = StructType([StructField(c, t.schema[c].dataType) for t, c in ((queries, "q"), (other, "id"))] + [StructField("d", DoubleType())])
    pairs = asked.groupBy("_b", "_c").cogroup(held.groupBy("_b", "_c")).applyInArrow(near, kinds)
    order = Window.partitionBy("q").orderBy("d", "id")
    two = pairs.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    best = two.groupBy("q").agg(F.min_by("id", "_r").alias("id"), F.min("d").alias("d"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("d2"))
    if max_distance is not None:
        best = best.where(F.col("d") < max_distance)
    if max_ratio < 1.0:
        best = best.where(F.col("d2").isNull() | (F.col("d") < max_ratio * F.col("d2")))
    return best.select("q", "id", F.col("d").alias("distance"))


def rank_order(pixels: DataFrame) -> DataFrame:
    """Values by the rank of their kind, from 0; ranked over distinct values, not over all places."""
    kinds = pixels.select("image_id", "v").distinct()
    ranks = kinds.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy("v")) - 1)
    return pixels.join(ranks, ["image_id", "v"]).select("image_id", "y", "x", "rank")
