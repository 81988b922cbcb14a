r"""Near-duplicates by min-max hashing.

A document's set of word shingles is hashed, and each of ``PERMUTATIONS``
permutations of the hashes gives two values of the signature: the smallest and
the largest. Two sets have the same smallest hash, and also the same largest one,
with a probability that is their Jaccard similarity, so half the permutations do,
and as a smallest and a largest hash can't be the same element the two agree a
little less by chance together than two smallest ones would: less variance.
Bands of ``ROWS`` values are taken from the smallest or from the largest only;
at the similarity 0.85 a pair shares none of the ``BANDS`` bands in 6 of 10^9
cases.

Documents with the same set are one node, known by a 128-bit digest of the set.
Where many nodes share a band they are not listed in pairs: each is compared with
the hub, the one that has most in common with all (a text and its edited copies
share more bands with the text than the copies do with each other), on the full
sets. Where that leaves members of a hub in different classes, what they have
beyond the hub, and how much of the hub they lack, tells which pairs of them can
still be links (see ``_candidates``); only those are compared on the full sets.

Edge cases: words are parted by ASCII white space and only A-Z is lower-cased; of
fewer words than a shingle has, all are one shingle. A text without words, empty
or null, has an empty set and links with nothing, not even its like. Rows that
repeat an id and differ in their sets are nodes of their own. Rows without a
``doc_id`` belong to the class of an equal set that has an id, and to none (null)
where there is no such set. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Names, columns, drop, materialize
from .components import connected_components

SHINGLE = 5
#: Least similarity of a link, in percent.
THRESHOLD = 85
BANDS, ROWS = 40, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Letters of words whose hashes a worker remembers.
_CACHE = 1 << 24
_BLOCK = 1 << 10

_rng = np.random.default_rng(13)
_odd = lambda *shape: _rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS, _SHIFTS, _PLACES, _BAND_FACTORS, _BAND_SHIFTS = _odd(PERMUTATIONS, 1), _odd(PERMUTATIONS, 1), _odd(64), _odd(ROWS), _odd(BANDS)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Words to 64-bit hashes."""

    room = _CACHE

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self.room -= len(word) + 64
        if self.room < 0:
            self.clear()
            self.room = _CACHE
        out = self[word] = xxh64_intdigest(word, 13)
        return out


def shingle_set(text: str | None, known: _Words, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), 5)] if words else [], dtype=np.uint64)
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(words) - shingle + 1, dtype=np.uint64)
    for k in range(shingle):  # sums of hashes with a factor for each place
        out += w[k : len(w) - shingle + 1 + k] * _PLACES[k]
    return np.unique(_mixed(out))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest, then largest hash under each permutation."""
    low, high = np.full(PERMUTATIONS, (1 << 64) - 1, dtype=np.uint64), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        x = (hashes[at : at + _BLOCK] ^ _SHIFTS) * _FACTORS
        x ^= x >> np.uint64(31)
        x *= _MIX
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    return _mixed((signature(hashes).reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + _BAND_SHIFTS)


def marks(documents: DataFrame, shingle: int = SHINGLE, keys: bool = True) -> DataFrame:
    """``documents`` (doc_id, text and more) without text but with n (size of the set), digest of the set and, if asked for, its band keys."""
    others = [f for f in documents.schema.fields if keys is False or f.name != "text"]

    def compute(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known = _Words()
        for batch in it:
            n, digests, bands = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                s = shingle_set(text.as_py(), known, shingle)
                n.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()))
                if keys:
                    bands.append(band_keys(s).view(np.int64) if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(digests, pa.binary())] + ([pa.array(bands, pa.list_(pa.int64()))] if keys else [])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in others] + made, names=[f.name for f in others] + ["n", "digest", "keys"][: len(made)])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["n long", "digest binary", "keys array<long>"][: 3 if keys else 2]
    return documents.mapInArrow(compute, ", ".join(kinds))


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both full sets, n and n_b, the size of what they share, and ``fresh``: the hashes of a that b lacks.

    The sets come from ``texts`` (node, text).
    """

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, y = _Words(), None, None
        for batch in it:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            n, n_b, both, fresh = [], [], [], []
            for k in range(batch.num_rows):
                x = shingle_set(ta[k].as_py(), known, shingle)
                if (at := b[k].as_py()) != last:  # rows come in the order of b
                    last, y = at, shingle_set(tb[k].as_py(), known, shingle)
                fresh.append(np.setdiff1d(x, y, assume_unique=True).view(np.int64))
                n.append(len(x))
                n_b.append(len(y))
                both.append(len(x) - len(fresh[-1]))
            yield pa.RecordBatch.from_arrays([a, b, *(pa.array(v, pa.int64()) for v in (n, n_b, both)), pa.array(fresh, pa.list_(pa.int64()))], names=["a", "b", "n", "n_b", "both", "fresh"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, n long, n_b long, both long, fresh array<long>")


def _linked(compared: DataFrame, threshold: int) -> DataFrame:
    return compared.where(100 * F.col("both") >= threshold * (F.col("n") + F.col("n_b") - F.col("both"))).select("a", "b")


def _close(differ: Column, sizes: Column, threshold: int) -> Column:
    """Whether sets of that size together that differ in so many elements are similar enough."""
    return (100 + threshold) * differ <= (100 - threshold) * sizes


def _candidates(members: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``(a, b)`` of different roots that may be links, of ``members`` (hub, node, n, both, fresh, root).

    Each member has been compared with its hub: ``both`` elements are shared, the
    ``fresh`` others are not in the hub. Two members that share ``k`` fresh ones
    differ in all their other fresh ones, and in what one has of the hub beyond
    the other: |fresh x| + |fresh y| - 2k + |both x - both y| elements at least.
    Pairs for which that is few enough with k = 0 are found by their numbers
    alone, over the distinct numbers of a hub's members. The others share a fresh
    element, and the first that they share, the rarest first, leaves enough others
    behind it.
    """
    cells = members.groupBy("hub", "n", "both").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    other = cells.select("hub", *[F.col(c).alias(f"{c}_b") for c in ("n", "both", "low", "high")])
    differ = F.col("n") - F.col("both") + F.col("n_b") - F.col("both_b") + F.abs(F.col("both") - F.col("both_b"))
    near = _close(differ, F.col("n") + F.col("n_b"), threshold) & (F.least("low", "low_b") < F.greatest("high", "high_b"))
    pairs = cells.join(other.hint("merge"), "hub").where(near & (F.struct("n", "both") <= F.struct("n_b", "both_b"))).select("hub", "n", "both", "n_b", "both_b")
    one = members.select("hub", "n", "both", F.col("node").alias("a"), F.col("root").alias("root_a"))
    two = members.select("hub", F.col("n").alias("n_b"), F.col("both").alias("both_b"), F.col("node").alias("b"), F.col("root").alias("root_b"))
    few = pairs.join(one.hint("merge"), ["hub", "n", "both"]).join(two.hint("merge"), ["hub", "n_b", "both_b"]).where("root_a <> root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    fresh = members.select("hub", "node", "n", "both", "root", F.explode("fresh").alias("element"))
    often = fresh.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    counted = fresh.join(often.hint("merge"), ["hub", "element"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    rest = F.count(F.lit(1)).over(Window.partitionBy("hub", "node").orderBy(F.desc("often"), F.desc("element")))  # it and those behind it
    ranked = counted.withColumn("rest", rest).where((F.col("often") > 1) & _close(F.col("n") - F.col("both") - F.col("rest"), F.col("n") + F.col("n") * 100 / threshold, threshold)).drop("often")
    again = ranked.select("hub", "element", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "both", "root", "rest")])
    left = _close(differ - 2 * F.least("rest", "rest_b"), F.col("n") + F.col("n_b"), threshold)
    shared = ranked.join(again.hint("merge"), ["hub", "element"]).where((F.col("root") < F.col("root_b")) & left).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
    return few.unionByName(shared).distinct()


def links(nodes: DataFrame, documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Edges ``(a, b)`` that connect just the nodes ``(node, rep, n, digest, keys)`` that a chain of links does."""
    held = nodes.select("node", F.explode("keys").alias("key"))
    met = held.groupBy("key").agg(F.count(F.lit(1)).alias("n_key")).where("n_key > 1")
    shared = materialize(held.join(met.hint("merge"), "key"), "bands")
    fame = shared.groupBy("node").agg(F.sum("n_key").alias("fame"))
    members = materialize(shared.join(fame.hint("merge"), "node").select("key", "node", "fame"), "bands", instead_of=shared)
    hubs = members.groupBy("key").agg(F.max(F.struct("fame", (-F.col("node")).alias("less"))).alias("hub")).select("key", (-F.col("hub.less")).alias("b"))
    pairs = materialize(members.join(hubs.hint("merge"), "key").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct(), "pairs", instead_of=members)

    # Texts of the nodes that share a band; a row that repeats an id counts by its set.
    wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge"), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), F.col("digest").alias("of_node"))
    found = marks(documents.where("doc_id IS NOT NULL").join(wanted.hint("merge"), "doc_id").select("node", "of_node", "text"), shingle, keys=False)
    texts = materialize(found.where("digest = of_node").select("node", "text").dropDuplicates(["node"]), "texts")
    compared = materialize(_compared(pairs, texts, shingle), "compared")
    first = materialize(_linked(compared, threshold), "links", instead_of=pairs)

    # Hubs whose members are not all of one class yet.
    roots = connected_components(first)
    itself = compared.select(F.col("b").alias("hub"), F.col("b").alias("node"), F.col("n_b").alias("n"), F.col("n_b").alias("both")).distinct()
    around = compared.select(F.col("b").alias("hub"), F.col("a").alias("node"), "n", "both", "fresh").unionByName(itself.withColumn("fresh", F.array().cast("array<long>")))
    rooted = materialize(around.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted", instead_of=compared)
    mixed = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hub")
    left = materialize(rooted.join(mixed.hint("merge"), "hub", "left_semi"), "mixed", instead_of=rooted)
    rest = materialize(_linked(_compared(_candidates(left, threshold), texts, shingle), threshold), "links")
    for gone in (left, texts):
        drop(gone)
    return first.unionByName(rest)


def components(documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row: the smallest ``doc_id`` that it reaches by links."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(marks(rows, shingle), "marks")
    one = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    nodes = materialize(one.where("rep IS NOT NULL").withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = connected_components(links(nodes, rows, shingle, threshold))
    rooted = nodes.select("node", "rep", "digest").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(low.hint("merge"), "root").select("digest", "component_id")
    some = signed.where("n > 0").select("doc_id", "n", "digest").join(named.hint("merge"), "digest", "left")
    none = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none)


def dedup(documents: DataFrame) -> DataFrame:
    """Rows of the document with the smallest id of each class, and rows without an id; columns as given."""
    gone = Names(documents).gone
    ids = components(documents).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    out = ids.where("NOT stays").select(F.col("doc_id").alias(gone))
    return documents.join(out.hint("merge"), F.col("doc_id") == F.col(gone), "left_anti").select(*columns(documents))
