"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a point that is within half of
that of each. Every fingerprint therefore emits all its variants within half
the radius; those that meet on a variant are candidates.

A whole ball of radius 2 over 64 bits has 2,081 variants. The fingerprint is
first cut into two halves: of four differing bits one half has two at most, so
each half's ball of radius 1 (33 variants) is enough to meet, and pairs that
meet are verified on all bits. Where more than ``SMALL`` fingerprints meet on
one variant, pairs are not listed: those fingerprints emit their whole balls,
on which any two that meet are within the radius for certain, and each is
linked with the smallest that it meets. No link is lost either way.

Equal fingerprints are one node, so groups of copies cost nothing here.

Edge cases: a text without words, empty or null has fingerprint zero and links
like any other. Rows that repeat a ``doc_id`` keep their own fingerprints and
share one component if these link. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Names, columns, materialize
from .components import connected_components

SHINGLE = 4
RADIUS = 4
#: Fingerprints that meet on one variant of a half and are still compared in pairs.
SMALL = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1])
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, one row for each row of documents."""

    def compute(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]  # one text at a time: a batch may hold many long ones
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, fp long")


def _flips(rows: DataFrame, column: str, bits: int, radius: int) -> DataFrame:
    """Each row with every variant of ``column`` that differs in ``radius`` of its lowest ``bits`` bits at most.

    Bits are flipped one after the other in rising order; the place ``bits``
    flips nothing and can only be followed by itself, so no variant comes twice.
    """
    others = [c for c in rows.columns if c != column]
    rows = rows.withColumn("_bit", F.lit(-1))
    for _ in range(radius):
        steps = rows.select(*others, column, F.explode(F.expr(f"sequence(least(_bit + 1, {bits}), {bits})")).alias("_bit"))
        rows = steps.select(*others, F.expr(f"CASE WHEN _bit < {bits} THEN {column} ^ shiftleft(1L, _bit) ELSE {column} END").alias(column), "_bit")
    return rows.drop("_bit")


def _half_keys(nodes: DataFrame, radius: int) -> DataFrame:
    """``(key, fp, rep)``: the variants of both halves, told apart by bit 32."""
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = F.array(F.struct(F.shiftrightunsigned("fp", 32).alias("key"), F.lit(1 << 32).alias("side")), F.struct(F.col("fp").bitwiseAND(low).alias("key"), F.lit(0).cast("long").alias("side")))
    both = nodes.select("fp", "rep", F.inline(halves))
    return _flips(both, "key", 32, (radius // 2 + 1) // 2).select((F.col("key") + F.col("side")).alias("key"), "fp", "rep")


def links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Edges ``(a, b)`` between nodes ``(fp, rep)`` that connect all within the radius.

    Pairs further apart are never linked; of a crowd only as many links are
    returned as connect it. Joins shuffle: neither side has a bound.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    keys = _half_keys(nodes, radius)
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keys.join(met.hint("merge"), "key")

    lists = members.where(F.col("n") <= small).groupBy("key").agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
    near = lambda x, y: F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius
    pairs = F.flatten(
        F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x["rep"] < y["rep"]) & near(x, y)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"))))
    )
    few = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    crowd = materialize(members.where(F.col("n") > small).select("fp", "rep").distinct(), "crowd")
    if crowd.isEmpty():
        return few.distinct()
    points = _flips(crowd.withColumn("z", F.col("fp")).drop("fp"), "z", 64, radius // 2)
    # Fingerprints differ, so a point has no more of them than a ball has points.
    head = F.min("rep").over(Window.partitionBy("z"))
    star = points.select(F.col("rep").alias("a"), head.alias("b")).where("a <> b")
    return few.unionByName(star).distinct()


def components(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row: the smallest ``doc_id`` that it reaches by links.

    Rows without a ``doc_id`` have one too, if they reach a row with an id.
    """
    marks = materialize(fingerprints(documents, shingle), "fingerprints")
    nodes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    # Where rows repeat a doc_id, one id may stand for two fingerprints: their links add up.
    roots = connected_components(links(nodes.where("rep IS NOT NULL"), radius))
    named = nodes.join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marks.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def dedup(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``; columns as given.

    Rows that repeat a kept id all stay, and so do rows without an id. Columns
    may have any names besides ``doc_id`` and ``text``.
    """
    kept = Names(documents).kept
    found = components(documents.select("doc_id", "text"))
    ids = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = ids.where(~F.col("stays")).select(F.col("doc_id").alias(kept))
    return documents.join(gone.hint("merge"), F.col("doc_id") == F.col(kept), "left_anti").select(*columns(documents))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
