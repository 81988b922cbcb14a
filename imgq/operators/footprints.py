"""More footprints, as lists of offsets from their centres; three numbers each for solid ones."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ellipse(width: int, height: int) -> list[tuple[int, int]]:
    """Places strictly inside the ellipse with half axes of ``height`` + 1 and ``width`` + 1."""
    inside = lambda dy, dx: (dy / (height + 1)) ** 2 + (dx / (width + 1)) ** 2 < 1
    return [(dy, dx) for dy, dx in product(range(-height, height + 1), range(-width, width + 1)) if inside(dy, dx)]


def octagon(m: int, n: int) -> list[tuple[int, int]]:
    """Straight sides of ``m`` places, slanted ones over ``n`` rows."""
    if m == n == 0:
        raise ValueError("m and n can't both be zero")
    last = m + 2 * n - 1
    rows = [(y, x) for y, x in product(range(last + 1), repeat=2) if min(y, last - y) + min(x, last - x) >= n]
    return [(y - (last + 1) // 2, x - (last + 1) // 2) for y, x in rows]


def star(a: int) -> list[tuple[int, int]]:
    """A square of 2 a + 1 places and the same turned by 45 degrees, put together."""
    if a == 1:
        return list(product((-1, 0, 1), repeat=2))
    tip = a + a // 2
    return [(dy, dx) for dy, dx in product(range(-tip, tip + 1), repeat=2) if max(abs(dy), abs(dx)) <= a or abs(dy) + abs(dx) <= tip]


def octahedron(radius: int) -> list[tuple[int, int, int]]:
    return [p for p in product(range(-radius, radius + 1), repeat=3) if sum(map(abs, p)) <= radius]


def ball(radius: int, strict: bool = True) -> list[tuple[int, int, int]]:
    most = radius if strict else radius + 0.5
    return [p for p in product(range(-radius, radius + 1), repeat=3) if sum(x * x for x in p) <= most * most]


def pad_footprint(offsets: list[tuple[int, ...]], shape: tuple[int, ...], pad_end: bool = True) -> list[tuple[int, ...]]:
    """A footprint of ``shape`` with a row more along its even sides: at the end, or at the beginning, which moves the centre."""
    moved = [int(n % 2 == 0 and not pad_end) for n in shape]
    return [tuple(x + d for x, d in zip(p, moved, strict=True)) for p in offsets]


def footprint_from_sequence(sequence: list[tuple[list[tuple[int, ...]], int]]) -> list[tuple[int, ...]]:
    """The one footprint that does what (footprint, times) one after the other do."""
    out = {tuple([0] * len(sequence[0][0][0]))}
    for offsets, times in sequence:
        for _ in range(times):
            out = {tuple(a + b for a, b in zip(p, q, strict=True)) for p in out for q in offsets}
    return sorted(out)


def coverage(points: DataFrame, footprint: list[tuple[int, ...]]) -> DataFrame:
    """How many points' footprints cover each place that any covers: image_id, the axes (y, x or z, y, x) and n.

    Counts are combined before the shuffle; points that come twice count twice.
    """
    axes = "zyx"[-len(footprint[0]) :]
    each = F.explode(F.array(*[F.struct(*[F.lit(o).alias(a) for a, o in zip(axes, offset, strict=True)]) for offset in footprint]))
    moved = points.select("image_id", *axes, each.alias("_o"))
    return moved.groupBy("image_id", *[(F.col(a) + F.col(f"_o.{a}")).alias(a) for a in axes]).agg(F.count(F.lit(1)).alias("n"))
