"""Random walks: which seed a walker that avoids steep steps meets first from each place."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..storage import drop, materialize
from .regions import label as components
from .tiles import SIDE, Plane, Tile, tiled

PLACE = ["image_id", "y", "x"]
SYSTEM = ["image_id", "label"]
TILE = ["image_id", "_ty", "_tx"]
#: A place and its four neighbours: name, rows down, columns to the right.
SIDES = [("o", 0, 0), ("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1)]
NEAR = SIDES[1:]
#: Added to each weight, so that no two neighbours are wholly apart.
LEAST_WEIGHT = 1e-10


def _active(pixels: DataFrame, labels: DataFrame, channels: list[str]) -> DataFrame:
    """Places that take part: image_id, y, x, label (0 without a seed) and the channels."""
    named = labels.select(*PLACE, F.col("label").cast("long").alias("label"))
    whole = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in channels])
    p = pixels.select(*PLACE, *[F.col(c).cast("double").alias(c) for c in channels]).join(named, PLACE, "left")
    return p.withColumn("label", F.coalesce("label", F.lit(0))).where(whole & (F.col("label") >= 0))


def _reached(active: DataFrame) -> DataFrame:
    """The places that can be reached from a seed.

    A full rectangle is one component; only images with gaps are labelled.
    """
    per = active.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("_n"), ((F.max("y") - F.min("y") + 1).cast("long") * (F.max("x") - F.min("x") + 1)).alias("_all"), F.max("label").alias("_seed")
    ).where("_seed > 0").select("image_id", (F.col("_n") < F.col("_all")).alias("_gaps"))
    seen = materialize(active.join(F.broadcast(per), "image_id"), "active")
    full = seen.where("NOT _gaps").drop("_gaps")
    gaps = seen.where("_gaps").drop("_gaps")
    if gaps.isEmpty():
        return full
    parts = materialize(gaps.join(components(gaps.select(*PLACE, F.lit(1.0).alias("v"))).withColumnRenamed("label", "_part"), PLACE), "parts")
    seeded = parts.where("label > 0").select("image_id", "_part").distinct()
    return full.unionByName(parts.join(seeded, ["image_id", "_part"], "left_semi").drop("_part"))


def _weighted(places: DataFrame, scale: DataFrame, channels: list[str], spacing: tuple[float, float]) -> DataFrame:
    """The places without a seed, with the weight of the step to each side (0: no step) and the label found there.

    Each place sends itself to its neighbours, so no line of an image is a group.
    """
    to = F.array(*[F.struct(F.lit(k).alias("side"), (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")) for k, dy, dx in SIDES])
    sent = places.select("image_id", F.explode(to).alias("to"), *channels, "label")
    seen = [F.max(F.when(F.col("to.side") == k, F.col(c))).alias(f"{c}_{k}") for k, *_ in SIDES for c in (*channels, "label")]
    got = sent.groupBy("image_id", F.col("to.y").alias("y"), F.col("to.x").alias("x")).agg(*seen).where("label_o = 0").join(F.broadcast(scale), "image_id")
    step = lambda k, far: sum((F.pow((F.col(f"{c}_{k}") - F.col(f"{c}_o")) / far, F.lit(2.0)) for c in channels), F.lit(0.0))
    weights = [F.coalesce(F.exp(-F.col("rate") * step(k, spacing[0] if dy else spacing[1])) + LEAST_WEIGHT, F.lit(0.0)).alias(f"w_{k}") for k, dy, _ in NEAR]
    return got.select(*PLACE, *[f"label_{k}" for k, *_ in NEAR], *weights)


def _times_matrix(state: DataFrame) -> DataFrame:
    """``state`` with ``a``: the matrix times the residuals over the diagonal. One shuffle by place.

    Weights are the same in both directions, so a tile with one row and column
    of the residuals around it has all that its places need.
    """
    kept = [c for c in state.columns if c not in (*SYSTEM, "y", "x", "a")]

    def steps(t: Tile, *planes: Plane) -> tuple[Plane, ...]:
        at = dict(zip(kept, planes, strict=True))
        r, d = at["r"], at["d"]
        u = r.map(r.v / np.where(r.ok, d.v, 1.0))
        near = {o[:2]: v for v, _, o in t.around(u, [(dy, dx) for _, dy, dx in NEAR], "constant", None)}
        return r.map(r.v - sum(at[f"f_{k}"].v * near[dy, dx] for k, dy, dx in NEAR)), *planes

    out = tiled(state.select(F.struct(*SYSTEM).alias("image_id"), "y", "x", *kept), 1, steps, tuple(kept), ("a", *kept))
    return out.select("image_id.image_id", "image_id.label", "y", "x", "a", *kept)


# -- tiles without their borders ------------------------------------------------------------------
#
# The last row and column of each tile are its border. What lies inside of a tile meets the rest of
# the image there only, so a tile's inner places are solved at once for given chances on the border,
# and the rounds are about borders alone.


def _on_border(y: Column, x: Column) -> Column:
    return (F.pmod(y, F.lit(SIDE)) == SIDE - 1) | (F.pmod(x, F.lit(SIDE)) == SIDE - 1)


def _dealt(places: DataFrame) -> DataFrame:
    """``places`` by tile; those of a border go to the tiles on both sides of it."""
    for c in ("y", "x"):
        places = places.withColumn(f"_t{c}", F.explode(F.sequence(F.floor(F.col(c) / SIDE), F.floor((F.col(c) + 1) / SIDE))))
    return places


@dataclass
class _Inside:
    """A tile with the borders around it: weights of the steps down and to the right, labels (-1: no place), and which places are inner."""

    down: np.ndarray
    right: np.ndarray
    label: np.ndarray
    inner: np.ndarray

    def pull(self, u: np.ndarray) -> np.ndarray:
        """The sum of the four neighbours, as they weigh; the last axis are the systems."""
        out = np.zeros_like(u)
        out[1:] += self.down[:-1, :, None] * u[:-1]
        out[:-1] += self.down[:-1, :, None] * u[1:]
        out[:, 1:] += self.right[:, :-1, None] * u[:, :-1]
        out[:, :-1] += self.right[:, :-1, None] * u[:, 1:]
        return out

    def seeds(self, kinds: list[int]) -> np.ndarray:
        return self.pull((self.label[..., None] == np.array(kinds, np.int64)).astype(float))

    def solved(self, right_side: np.ndarray) -> np.ndarray:
        """The inner places' values, 0 elsewhere, by elimination of one line after the other."""
        if self.inner.shape[1] > self.inner.shape[0]:
            return _Inside(self.right.T, self.down.T, self.label.T, self.inner.T).solved(right_side.swapaxes(0, 1)).swapaxes(0, 1)
        m = self.inner
        scale = np.where(m, 1 / np.sqrt(np.where(m, self.pull(np.ones((*m.shape, 1)))[..., 0], 1.0)), 0.0)
        down, right = self.down[:-1] * scale[:-1] * scale[1:], self.right[:, :-1] * scale[:, :-1] * scale[:, 1:]
        r, k, inverse = right_side * scale[..., None], np.arange(m.shape[1]), []
        for i in range(len(m)):
            line = np.eye(len(k))
            line[k[:-1], k[1:]] = line[k[1:], k[:-1]] = -right[i]
            if i:
                line -= down[i - 1][:, None] * inverse[-1] * down[i - 1]
                r[i] += down[i - 1][:, None] * (inverse[-1] @ r[i - 1])
            inverse.append(np.linalg.inv(line))
        for i in range(len(m) - 1, -1, -1):
            if i < len(m) - 1:
                r[i] += down[i][:, None] * r[i + 1]
            r[i] = inverse[i] @ r[i]
        return r * scale[..., None]


def _packed(places: DataFrame, scale: DataFrame, kinds: DataFrame, channels: list[str], spacing: tuple[float, float]) -> DataFrame:
    """A row for each tile with inner places: the arrays of ``_Inside`` from its first row and column on, the image's
    labels, and for each of them the inner right side's square.
    """
    side = SIDE
    kinds = kinds.groupBy("image_id").agg(F.sort_array(F.collect_list("label")).alias("kinds"))
    table = _dealt(places.select(*PLACE, "label", *channels)).join(F.broadcast(scale.join(kinds, "image_id")), "image_id")

    def pack(t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        y0, x0, kinds = int(y.min()), int(x.min()), t.column("kinds")[0].as_py()
        at, size = (y - y0, x - x0), (int(y.max()) - y0 + 1, int(x.max()) - x0 + 1)
        label = np.full(size, -1, np.int64)
        label[at] = t.column("label").to_numpy()
        down, right = np.zeros(size), np.zeros(size)
        for c in channels:
            v = np.zeros(size)
            v[at] = t.column(c).to_numpy()
            down[:-1] += ((v[1:] - v[:-1]) / spacing[0]) ** 2
            right[:, :-1] += ((v[:, 1:] - v[:, :-1]) / spacing[1]) ** 2
        rate, there = t.column("rate")[0].as_py(), np.pad(label >= 0, ((0, 1), (0, 1)))
        down = np.where(there[:-1, :-1] & there[1:, :-1], np.exp(-rate * down) + LEAST_WEIGHT, 0.0)
        right = np.where(there[:-1, :-1] & there[:-1, 1:], np.exp(-rate * right) + LEAST_WEIGHT, 0.0)
        border = ((y0 + np.arange(size[0])) % side == side - 1)[:, None] | ((x0 + np.arange(size[1])) % side == side - 1)
        inner = (label == 0) & ~border
        squares = (_Inside(down, right, label, inner).seeds(kinds)[inner] ** 2).sum(0).tolist()
        head = [t.column(c)[:1] for c in TILE]
        row = [y0, x0, size[0], size[1], kinds, squares, *[a.tobytes() for a in (down, right, label, inner)]]
        return pa.table([*head, *[pa.array([v], type=kind) for v, kind in zip(row, [*[pa.int32()] * 4, pa.list_(pa.int64()), pa.list_(pa.float64()), *[pa.binary()] * 4], strict=True)]], names=names).slice(0, int(inner.any()))

    kept = [("y0", IntegerType()), ("x0", IntegerType()), ("h", IntegerType()), ("w", IntegerType()), ("kinds", ArrayType(LongType())), ("squares", ArrayType(DoubleType())), *[(c, BinaryType()) for c in ("down", "right", "label", "inner")]]
    names = [*TILE, *[c for c, _ in kept]]
    return table.groupBy(*TILE).applyInArrow(pack, StructType([*[table.schema[c] for c in TILE], *[StructField(c, t) for c, t in kept]]))


def _inside(t: pa.Table) -> tuple[int, int, list[int], _Inside]:
    """First row and column, labels and arrays of a packed tile."""
    y0, x0, h, w, kinds = (t.column(c)[0].as_py() for c in ("y0", "x0", "h", "w", "kinds"))
    planes = [np.frombuffer(t.column(c)[0].as_py(), kind).reshape(h, w) for c, kind in (("down", float), ("right", float), ("label", np.int64), ("inner", bool))]
    return y0, x0, kinds, _Inside(*planes)


def _rows(t: pa.Table, at: np.ndarray, y0: int, x0: int, kinds: list[int], values: dict[str, np.ndarray]) -> pa.Table:
    """A row for each place of ``at`` and label."""
    y, x = (np.repeat(c, len(kinds)) for c in np.nonzero(at))
    image = t.column("image_id").take(pa.array(np.zeros(len(y), np.int64)))
    label = np.tile(np.array(kinds, np.int64), int(at.sum()))
    return pa.table([image, label, (y + y0).astype(np.int32), (x + x0).astype(np.int32), *[v[at].ravel() for v in values.values()]], names=[*SYSTEM, "y", "x", *values])


def _fields(tiles: DataFrame, *values: str) -> StructType:
    at = [StructField("y", IntegerType()), StructField("x", IntegerType())]
    return StructType([tiles.schema["image_id"], StructField("label", LongType()), *at, *[StructField(c, DoubleType()) for c in values]])


def _given(t: pa.Table, y0: int, x0: int, kinds: list[int], shape: tuple[int, ...]) -> np.ndarray:
    """The border's values, by place and label."""
    u = np.zeros((*shape, len(kinds)))
    u[t.column("y").to_numpy() - y0, t.column("x").to_numpy() - x0, np.searchsorted(kinds, t.column("label").to_numpy())] = t.column("u").to_numpy()
    return u


def _passed_on(tiles: DataFrame, state: DataFrame) -> DataFrame:
    """image_id, label, y, x, c: what the border's residuals over the diagonal come to on the border by way of one tile's inner places."""

    def steps(t: pa.Table, given: pa.Table) -> pa.Table:
        if not (len(t) and len(given)):
            return _rows(given, np.zeros((0, 0), bool), 0, 0, [], {"c": np.zeros((0, 0, 0))})
        y0, x0, _, tile = _inside(t)
        kinds = np.unique(given.column("label").to_numpy()).tolist()
        u = tile.solved(tile.pull(_given(given, y0, x0, kinds, tile.label.shape)))
        near = (tile.label == 0) & ~tile.inner & (tile.pull(tile.inner[..., None].astype(float))[..., 0] > 0)
        return _rows(t, near, y0, x0, kinds, {"c": tile.pull(u)})

    given = _dealt(state.select(*SYSTEM, "y", "x", (F.col("r") / F.col("d")).alias("u")))
    return tiles.groupBy(*TILE).cogroup(given.groupBy(*TILE)).applyInArrow(steps, _fields(tiles, "c"))


def _from_inside(tiles: DataFrame) -> DataFrame:
    """image_id, label, y, x and what reaches the border from inside: ``seeds`` from seeds, ``even`` from even chances on the border."""

    def steps(t: pa.Table) -> pa.Table:
        y0, x0, kinds, tile = _inside(t)
        border = (tile.label == 0) & ~tile.inner
        even = tile.pull(border[..., None] / len(kinds))
        back = tile.pull(tile.solved(np.concatenate([tile.seeds(kinds), even], axis=2)))
        near = border & (tile.pull(tile.inner[..., None].astype(float))[..., 0] > 0)
        return _rows(t, near, y0, x0, kinds, {"seeds": back[..., :-1], "even": np.repeat(back[..., -1:], len(kinds), axis=2)})

    found = tiles.groupBy(*TILE).applyInArrow(steps, _fields(tiles, "seeds", "even"))
    return found.groupBy(*SYSTEM, "y", "x").agg(F.sum("seeds").alias("_seeds"), F.sum("even").alias("_even"))


def _filled(tiles: DataFrame, border: DataFrame) -> DataFrame:
    """image_id, label, y, x, p of the inner places, from those of the border."""

    def steps(t: pa.Table, given: pa.Table) -> pa.Table:
        if not len(t):
            return _rows(given, np.zeros((0, 0), bool), 0, 0, [], {"p": np.zeros((0, 0, 0))})
        y0, x0, kinds, tile = _inside(t)
        u = _given(given, y0, x0, kinds, tile.label.shape)
        return _rows(t, tile.inner, y0, x0, kinds, {"p": tile.solved(tile.seeds(kinds) + tile.pull(u))})

    given = _dealt(border.withColumnRenamed("p", "u"))
    return tiles.groupBy(*TILE).cogroup(given.groupBy(*TILE)).applyInArrow(steps, _fields(tiles, "p"))


def _times_reduced(tiles: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (the border) with ``a``: the border's own matrix product, less what comes back through the tiles."""
    own = _times_matrix(state)
    back = _passed_on(tiles, state).withColumn("a", -F.col("c")).drop("c")
    kept = [F.max(c).alias(c) for c in own.columns if c not in (*SYSTEM, "y", "x", "a")]
    return own.unionByName(back, allowMissingColumns=True).groupBy(*SYSTEM, "y", "x").agg(F.sum("a").alias("a"), *kept)


def _products(state: DataFrame) -> DataFrame:
    u = F.col("r") / F.col("d")
    return state.groupBy(*SYSTEM).agg(F.sum(F.col("r") * u).alias("gamma"), F.sum(F.col("a") * u).alias("delta"), F.sum(F.col("r") * F.col("r")).alias("rr"))


def _solved(border: DataFrame, tiles: DataFrame, kinds: DataFrame, tol: float) -> DataFrame:
    """image_id, label, y, x, p of the border by conjugate gradients, all systems at once, scaled by the diagonal.

    A round is a product with the reduced matrix, for which each tile is solved
    once, and one aggregate for both dot products; it keeps one table, a row for
    each place of the border and label. What has come near enough leaves. The
    walk begins with even chances for all labels.
    """
    to_seed = lambda k: F.when(F.col(f"label_{k}") > 0, F.col(f"w_{k}")).otherwise(0.0)
    matched = lambda k: F.when(F.col(f"label_{k}") == F.col("label"), F.col(f"w_{k}")).otherwise(0.0)
    total = lambda f: sum((f(k) for k, *_ in NEAR[1:]), f(NEAR[0][0]))
    along = {k: F.when((F.col(f"label_{k}") == 0) & _on_border(F.col("y") + dy, F.col("x") + dx), F.col(f"w_{k}")).otherwise(0.0) for k, dy, dx in NEAR}
    even = 1 / F.col("_k")
    own = total(lambda k: F.col(f"w_{k}")) - total(lambda k: along[k])  # the border's own matrix times ones
    counted = kinds.join(F.broadcast(kinds.groupBy("image_id").agg(F.count(F.lit(1)).cast("double").alias("_k"))), "image_id")
    back = border.join(F.broadcast(counted), "image_id").join(_from_inside(tiles), [*SYSTEM, "y", "x"], "left").fillna(0.0, ["_seeds", "_even"])
    begun = back.select(
        *SYSTEM, "y", "x", total(lambda k: F.col(f"w_{k}")).alias("d"), *[along[k].alias(f"f_{k}") for k in along], even.alias("z"), (total(matched) + F.col("_seeds") - own * even + F.col("_even")).alias("r"),
        F.lit(0.0).alias("q"), F.lit(0.0).alias("s"), total(matched).alias("_b"), (own - F.col("_even") * F.col("_k")).alias("_all"),
    )
    begun = materialize(begun, "walk")
    square = lambda c: F.sum(F.col(c) * F.col(c))
    inside = tiles.select("image_id", F.explode(F.arrays_zip(F.col("kinds").alias("label"), F.col("squares").alias("b"))).alias("t")).groupBy("image_id", F.col("t.label").alias("label")).agg(F.sum("t.b").alias("_inside"))
    sizes = begun.groupBy(*SYSTEM).agg(square("_b").alias("_b"), square("_all").alias("_all"), square("r").alias("_r")).join(inside, SYSTEM, "left")
    right_side = F.nullif(F.col("_b") + F.coalesce("_inside", F.lit(0.0)), F.lit(0.0))
    # Below the last bits of the first residual there is nothing left to gain.
    limits = sizes.select(*SYSTEM, F.greatest(F.least(right_side, F.nullif("_all", F.lit(0.0))) * tol * tol, F.col("_r") * 1e-26).alias("limit"))
    state = materialize(_times_reduced(tiles, begun.drop("_b", "_all")), "walk")
    now = _products(state).join(limits, SYSTEM).select(*SYSTEM, "limit", "gamma", F.lit(0.0).alias("beta"), F.try_divide("gamma", "delta").alias("alpha"), (F.col("rr") > F.col("limit")).alias("going"))
    ended, before = [], [begun]
    while True:
        now = materialize(now, "steps")
        for table in before:
            drop(table)
        counts = {r["going"]: r["count"] for r in now.groupBy("going").count().collect()}  # two rows at most
        if counts.get(False):
            ended.append(materialize(state.join(now.where("NOT going").select(*SYSTEM), SYSTEM, "left_semi").select(*SYSTEM, "y", "x", F.col("z").alias("p")), "ended"))
        if not counts.get(True):
            break
        going = now.where("going").drop("going")
        q = F.col("r") / F.col("d") + F.col("beta") * F.col("q")
        s = F.col("a") + F.col("beta") * F.col("s")
        moved = state.join(going.select(*SYSTEM, "alpha", "beta"), SYSTEM).withColumns({"q": q, "s": s})
        moved = moved.withColumns({"z": F.col("z") + F.col("alpha") * F.col("q"), "r": F.col("r") - F.col("alpha") * F.col("s")}).drop("alpha", "beta")
        before = [state, now]
        state = materialize(_times_reduced(tiles, moved), "walk")
        new = _products(state).withColumnsRenamed({"gamma": "new"}).join(going.select(*SYSTEM, "limit", "gamma", "alpha"), SYSTEM)
        beta = F.col("new") / F.col("gamma")
        now = new.select(*SYSTEM, "limit", F.col("new").alias("gamma"), beta.alias("beta"), F.try_divide(F.col("new"), F.col("delta") - beta * F.col("new") / F.col("alpha")).alias("alpha"), (F.col("rr") > F.col("limit")).alias("going"))
    return reduce(DataFrame.unionByName, ended) if ended else state.select(*SYSTEM, "y", "x", F.col("z").alias("p"))


def random_walker_probabilities(pixels: DataFrame, labels: DataFrame, beta: float = 130.0, tol: float = 1e-3, spacing: tuple[float, float] = (1.0, 1.0), channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """image_id, y, x, label, p: the chance that a walk from a place without a seed meets a seed of ``label`` first.

    ``labels`` (image_id, y, x, label): above 0 a seed, 0 or no row open, below
    0 out of the graph, like places where a channel is null or NaN. Places and
    their labels come once. Steps between neighbours weigh exp(-beta / (10 sd)
    d^2), d being the difference over ``spacing``; the sd is that of all
    channels of the image together, and beta is divided by the root of their
    number. In a flat image all steps weigh the same. The inside of each
    tile is solved exactly for what its border has; a system ends when the
    residual of the borders is at most ``tol`` of its right side, and of the
    borders' right sides of all labels together. Open places that no seed can reach
    have no rows, seeds have none either; an empty table gives no rows.
    """
    if not 1e-9 <= tol < 1:
        raise ValueError("tol must be from 1e-9 to below 1")
    channels = list(channels)
    all_values = pixels.select("image_id", F.explode(F.array(*[F.col(c).cast("double") for c in channels])).alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rate = F.coalesce(F.lit(float(beta)) / (10 * F.nullif(F.stddev_pop("v"), F.lit(0.0))) / len(channels) ** 0.5, F.lit(0.0))
    scale = all_values.groupBy("image_id").agg(rate.alias("rate"))
    places = _reached(_active(pixels, labels, channels))
    kinds = places.where("label > 0").select(*SYSTEM).distinct()
    packed = materialize(_packed(places, scale, kinds, channels, spacing), "tiles")
    near = lambda c: F.pmod(F.col(c) + 2, F.lit(SIDE)) <= 2  # noqa: E731  (a border, or beside one)
    border = _weighted(places.where(near("y") | near("x")), scale, channels, spacing).where(_on_border(F.col("y"), F.col("x")))
    width = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = packed.repartition(width, *TILE).persist()  # dealt out once for all rounds
    chances = _solved(border, tiles, kinds, tol)
    tiles.unpersist()
    return _filled(packed, chances).unionByName(chances).select(*PLACE, "label", "p")


def random_walker(pixels: DataFrame, labels: DataFrame, beta: float = 130.0, tol: float = 1e-3, spacing: tuple[float, float] = (1.0, 1.0), channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """image_id, y, x, label for every place of ``pixels``: the label with the best chance (to six digits; ties: the smallest).

    Seeds and places out of the graph keep their labels, which need not be
    consecutive; open places that no seed reaches, or without a value, get -1.
    """
    return likeliest(pixels, labels, random_walker_probabilities(pixels, labels, beta, tol, spacing, channels))


def likeliest(pixels: DataFrame, labels: DataFrame, chances: DataFrame) -> DataFrame:
    """The labels of ``random_walker`` from chances that are there already."""
    best = chances.groupBy(*PLACE).agg((-F.max(F.struct(F.round("p", 6).alias("p"), (-F.col("label")).alias("m"))).getField("m")).alias("_best"))
    named = labels.select(*PLACE, F.col("label").cast("long").alias("_own"))
    own = pixels.select(*PLACE).join(named, PLACE, "left").join(best, PLACE, "left")
    return own.select(*PLACE, F.when(F.col("_own") != 0, F.col("_own")).otherwise(F.coalesce("_best", F.lit(-1))).alias("label"))
