"""Interpolation by B-splines of order 2 to 5.

A spline that goes through all values of a line has coefficients that a
recursive filter finds, from end to end and back; lines along one axis are
filtered, then those along the other, so a group is one line. A value between
places is a sum of (order + 1) coefficients along each axis, weighted by the
basis function, which is a column expression.

Images must be without gaps and start at 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["image_id", "y", "x"]
#: Coefficients beyond each end that a line keeps in the mode nearest.
BEYOND = 4
#: Values beyond each end over which a filter settles.
_SETTLE = 48
_NUMPY = {"reflect": "symmetric", "mirror": "reflect", "wrap": "wrap", "nearest": "edge", "constant": "reflect"}


def poles(order: int) -> list[float]:
    """The roots inside the unit circle of the basis function's values at whole places."""
    values = [basis_at(k, order) for k in range(-(order // 2), order // 2 + 1)]
    return sorted(r.real for r in np.roots(values) if abs(r) < 1)


def basis_at(u: float, order: int) -> float:
    return sum((-1) ** k * math.comb(order + 1, k) * max(u + (order + 1) / 2 - k, 0.0) ** order for k in range(order + 2)) / math.factorial(order)


def basis(u: Column, order: int) -> Column:
    """The basis function ``u`` places from its middle."""
    total = F.lit(0.0)
    for k in range(order + 2):
        total = total + (-1) ** k * math.comb(order + 1, k) * F.pow(F.greatest(u + ((order + 1) / 2 - k), F.lit(0.0)), order)
    return total / math.factorial(order)


def line_coefficients(line: np.ndarray, order: int, mode: str) -> np.ndarray:
    """Coefficients of one line; in the mode nearest with ``BEYOND`` more at each end."""
    c = np.pad(line.astype(float), _SETTLE, mode=_NUMPY[mode])
    for z in poles(order):
        c = c * (1 - z) * (1 - 1 / z)
        c[0] = c[0] / (1 - z)
        for k in range(1, len(c)):
            c[k] += z * c[k - 1]
        c[-1] = z / (z - 1) * c[-1]
        for k in range(len(c) - 2, -1, -1):
            c[k] = z * (c[k + 1] - c[k])
    more = BEYOND if mode == "nearest" else 0
    return c[_SETTLE - more : len(c) - _SETTLE + more]


def coefficients(pixels: DataFrame, order: int, mode: str = "mirror") -> DataFrame:
    """``(image_id, y, x, v)``: the spline coefficients of each place, of more places beyond the border in the mode nearest."""
    if not 2 <= order <= 5:
        raise ValueError("orders 2 to 5 have coefficients")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [line_coefficients(np.asarray(x, dtype=float), order, mode) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.float64()))], names=batch.schema.names)

    out, shift = pixels.select(*PLACE, F.coalesce("v", F.lit(0.0)).alias("v")), BEYOND if mode == "nearest" else 0
    id_type = pixels.schema["image_id"].dataType.simpleString()
    for axis, other in (("x", "y"), ("y", "x")):
        lines = out.groupBy("image_id", other).agg(F.array_sort(F.collect_list(F.struct(axis, "v"))).alias("l")).select("image_id", other, F.transform("l", lambda p: p["v"]).alias("v"))
        made = lines.mapInArrow(compute, f"image_id {id_type}, {other} int, v array<double>").select("image_id", other, F.posexplode("v").alias("_at", "v"))
        out = made.select("image_id", other, (F.col("_at") - shift).alias(axis), "v").select(*PLACE, "v")
    return out


def taps(at: Column, n: Column, order: int, mode: str) -> tuple[list[tuple[Column, Column]], Column]:
    """(place, weight) of each coefficient that a value at ``at`` needs along an axis of ``n``, and whether it lies inside."""
    from .stencil import fold

    inside = (at >= 0) & (at <= n - 1) if mode == "constant" else F.lit(True)
    at = F.least(F.greatest(at, F.lit(0.0)), (n - 1).cast("double")) if mode in ("nearest", "constant") else at
    first = (F.floor(at) if order % 2 else F.floor(at + 0.5)) - order // 2
    places = [first + k for k in range(order + 1)]
    folded = (lambda p: p) if mode == "nearest" else (lambda p: fold(p, n, "mirror" if mode == "constant" else mode))
    return [(folded(p).cast("int"), basis(at - p, order)) for p in places], inside
