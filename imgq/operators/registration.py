"""Transforms estimated from tables of matched points: (sx, sy) goes to (dx, dy).

All sums that a least-squares fit needs are one aggregation; what is left is a
system of a few unknowns, solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _normal(points: DataFrame, rows: list[tuple[list[Column], Column]]) -> tuple[np.ndarray, np.ndarray]:
    """A'A and A'b where each point gives the ``rows`` (coefficients, right side)."""
    n = len(rows[0][0])
    sums = []
    for i in range(n):
        for j in range(i, n):
            sums.append(sum((F.sum(c[i] * c[j]) for c, _ in rows), F.lit(0.0)).alias(f"a{i}_{j}"))
        sums.append(sum((F.sum(c[i] * b) for c, b in rows), F.lit(0.0)).alias(f"b{i}"))
    r = points.agg(*sums).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], dtype=float)
    return a, np.array([r[f"b{i}"] or 0.0 for i in range(n)], dtype=float)


def _columns() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c).cast("double") for c in ("sx", "sy", "dx", "dy"))


def estimate_affine(points: DataFrame) -> np.ndarray:
    x, y, u, v = _columns()
    o, z = F.lit(1.0), F.lit(0.0)
    a, b = _normal(points, [([x, y, o, z, z, z], u), ([z, z, z, x, y, o], v)])
    return np.vstack([np.linalg.solve(a, b).reshape(2, 3), [0, 0, 1]])


def estimate_similarity(points: DataFrame, scale: bool = True) -> np.ndarray:
    """Rotation, translation and, unless it is one, scale (Umeyama); NaN where the points do not tell."""
    x, y, u, v = _columns()
    n = points.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for k, c in zip("xyuv", (x, y, u, v), strict=True)]).first()
    if not n["n"]:
        return np.full((3, 3), np.nan)
    x, y, u, v = x - n["x"], y - n["y"], u - n["u"], v - n["v"]
    r = points.agg(F.avg(u * x).alias("ux"), F.avg(u * y).alias("uy"), F.avg(v * x).alias("vx"), F.avg(v * y).alias("vy"), F.avg(x * x + y * y).alias("s")).first()
    cov = np.array([[r["ux"], r["uy"]], [r["vx"], r["vy"]]])
    left, d, right = np.linalg.svd(cov)
    if np.linalg.matrix_rank(cov) == 0:
        return np.full((3, 3), np.nan)
    sign = np.array([1.0, np.sign(np.linalg.det(left) * np.linalg.det(right)) or 1.0])
    turn = left @ np.diag(sign) @ right
    k = float((d * sign).sum() / r["s"]) if scale else 1.0
    shift = np.array([n["u"], n["v"]]) - k * turn @ np.array([n["x"], n["y"]])
    return np.vstack([np.column_stack([k * turn, shift]), [0, 0, 1]])


def estimate_projective(points: DataFrame) -> np.ndarray:
    """A homography, as the smallest eigenvector of the equations' normal matrix, on centred and scaled points."""
    x, y, u, v = _columns()
    n = points.agg(*[f(c).alias(f"{k}{g}") for g, f in (("m", F.avg), ("s", F.stddev_pop)) for k, c in zip("xyuv", (x, y, u, v), strict=True)]).first()
    scaled = lambda c, k: (c - n[f"{k}m"]) / (n[f"{k}s"] or 1.0)
    x, y, u, v = scaled(x, "x"), scaled(y, "y"), scaled(u, "u"), scaled(v, "v")
    o, z = F.lit(1.0), F.lit(0.0)
    a, _ = _normal(points, [([x, y, o, z, z, z, -u * x, -u * y, -u], z), ([z, z, z, x, y, o, -v * x, -v * y, -v], z)])
    h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
    place = lambda p, q: np.array([[1 / (n[f"{p}s"] or 1.0), 0, -n[f"{p}m"] / (n[f"{p}s"] or 1.0)], [0, 1 / (n[f"{q}s"] or 1.0), -n[f"{q}m"] / (n[f"{q}s"] or 1.0)], [0, 0, 1]])
    h = np.linalg.inv(place("u", "v")) @ h @ place("x", "y")
    return h / h[2, 2]


def estimate_polynomial(points: DataFrame, order: int = 2) -> np.ndarray:
    """Coefficients 2 x n of the monomials x^(j-i) y^i, j up to the order."""
    x, y, u, v = _columns()
    power = lambda c, k: F.lit(1.0) if k == 0 else F.pow(c, F.lit(float(k)))
    terms = [power(x, j - i) * power(y, i) for j in range(order + 1) for i in range(j + 1)]
    out = []
    for target in (u, v):
        a, b = _normal(points, [(terms, target)])
        out.append(np.linalg.solve(a, b))
    return np.array(out)


def matrix_transform(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Points (sx, sy) with ``tx`` and ``ty``, through a 3 x 3 matrix."""
    x, y = F.col("sx").cast("double"), F.col("sy").cast("double")
    row = lambda r: float(r[0]) * x + float(r[1]) * y + float(r[2])
    w = row(matrix[2])
    return points.withColumns({"tx": F.try_divide(row(matrix[0]), w), "ty": F.try_divide(row(matrix[1]), w)})
