"""Spacing of peaks against going through them one after the other."""

import math

import numpy as np
import pytest

from imgq.operators import peaks

SCHEMA = "image_id long, y int, x int, v double"


def one_by_one(rows, spacing, p, inclusive):
    best = {}
    for i, y, x, v in rows:
        old = best.get((i, y, x))
        best[i, y, x] = v if old is None else old if v is None else max(old, v)
    kept = []
    for (i, y, x), v in sorted(best.items(), key=lambda r: (math.inf if r[1] is None else -r[1], r[0][1], r[0][2])):
        far = lambda k: max(abs(k[1] - y), abs(k[2] - x)) if math.isinf(p) else (abs(k[1] - y) ** p + abs(k[2] - x) ** p) ** (1 / p)
        if not any(k[0] == i and (far(k) <= spacing if inclusive else far(k) < spacing) for k in kept):
            kept.append((i, y, x, v))
    return set(kept)


@pytest.mark.parametrize(("spacing", "p", "inclusive"), [(4, math.inf, False), (5, 2.0, False), (3, 1.0, True)])
def test_like_one_by_one(spark, spacing, p, inclusive):
    rng = np.random.default_rng(spacing)
    # Few values, so that many tie; places below zero; repeated places; values that are absent.
    rows = [(int(i), int(y), int(x), float(v)) for i, y, x, v in zip(rng.integers(0, 2, 300), rng.integers(-15, 15, 300), rng.integers(-15, 15, 300), rng.integers(0, 6, 300), strict=True)]
    rows += [(0, y, 40, float(-y)) for y in range(12)] + [(1, 30, 30, None), (1, 30, 31, None), (1, 31, 31, 1.0), (1, 31, 31, None)]  # a chain, each next to the one before
    got = peaks.ensure_spacing(spark.createDataFrame(rows, SCHEMA), spacing, p, inclusive).collect()
    assert {tuple(r) for r in got} == one_by_one(rows, spacing, p, inclusive)
    assert len(got) == len({tuple(r) for r in got})


def test_no_rows_and_bad_norm(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert peaks.ensure_spacing(empty, 3).count() == 0
    with pytest.raises(ValueError, match="p_norm"):
        peaks.ensure_spacing(empty, 3, 0.5)
