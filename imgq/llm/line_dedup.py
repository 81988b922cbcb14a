"""Reversible line deduplication: exact reference counts, fronted by cuckoo filters.

A line's key is the line without blanks at its ends, in lower case (A-Z only).
The store keeps, in tables in a shared folder,

* postings ``(key, doc_id)``, from which everything can be counted again,
* the reference table ``(key, refs, first_doc)``: in how many documents a key
  stands and in which one first,
* for each shard of the key space one cuckoo filter of the keys that stand in
  two documents or more.

Inserting and deleting documents changes the counts exactly; a key that comes
to two references enters the filter of its shard, one that falls below leaves
it again. When documents are cleaned, the filters pass over all lines that
surely do not repeat; what they let through is looked up in the exact table, so
false positives cost time only.

Keys are compared by their MD5 digests (16 bytes).

Edge cases: a null or empty text is one empty line. Rows whose ``doc_id`` is
null are never counted and lose nothing. Rows that repeat a ``doc_id`` are one
document. Lines repeated inside one document only stay. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Names, materialize, quoted, shuffle_width
from .cuckoo import CuckooFilter, build

MIN_POINTS = 10
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Repeated keys of a shard, about, and postings that a task looks up at a time.
SHARD_KEYS, GROUP_ROWS = 500_000, 2_000_000
RESULTS = ("n_lines", "n_dropped", "kept")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _keys(text: Column, min_points: int) -> Column:
    keys = F.filter(F.transform(split_lines(text), line_key), lambda k: F.length(k) >= min_points)
    return F.array_distinct(F.transform(keys, digest))


class LineStore:
    """The store; a change writes what is new or touched and leaves older tables whole."""

    def __init__(self, spark: SparkSession, shards: int | None = None, min_points: int = MIN_POINTS):
        """``shards`` None: as many as the repeated keys need, more when they grow."""
        self.spark, self.min_points, self.fixed_shards, self.shards = spark, min_points, shards, shards or 0
        self.postings = spark.createDataFrame([], "key binary, doc_id long")
        self.refs = spark.createDataFrame([], "key binary, refs long, first_doc long")
        self.filters = spark.createDataFrame([], "shard int, filter binary")
        self._empty = True

    def _hash(self, key: str = "key") -> Column:
        return F.xxhash64(key)

    def _shard(self, h: Column) -> Column:
        return F.pmod(F.shiftright(h, 7), F.lit(self.shards)).cast("int")

    def insert(self, documents: DataFrame) -> None:
        """Add documents; those whose id the store has already are passed over."""
        rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
        if not self._empty:
            rows = rows.join(self.postings.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
        new = rows.select("doc_id", F.explode(_keys(F.col("text"), self.min_points)).alias("key")).select("key", "doc_id").distinct()
        new = materialize(new, "line-postings")
        added = new.groupBy("key").agg(F.count("doc_id").alias("refs"), F.min("doc_id").alias("first_doc"))
        if self._empty:
            self.postings = new
        else:
            self.postings = self.postings.unionByName(new)
            added = self.refs.unionByName(added).groupBy("key").agg(F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"))
        self._set_refs(added)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out again, as if they had never been inserted; only their keys are counted anew."""
        ids = doc_ids.select("doc_id").distinct()
        touched = materialize(self.postings.join(ids, "doc_id", "left_semi").select("key").distinct(), "line-touched")
        self.postings = materialize(self.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "line-postings")
        again = self.postings.join(touched.hint("merge"), "key", "left_semi").groupBy("key").agg(F.count("doc_id").alias("refs"), F.min("doc_id").alias("first_doc"))
        self._set_refs(self.refs.join(touched.hint("merge"), "key", "left_anti").unionByName(again))

    def _repeated(self, refs: DataFrame) -> DataFrame:
        return refs.where("refs >= 2").select(self._hash().alias("h"))

    def _set_refs(self, refs: DataFrame) -> None:
        """Write the new counts and bring the filters up to them."""
        before, self.refs = self.refs, materialize(refs, "line-refs")
        n = self.refs.where("refs >= 2").count()
        if not self.shards or (not self.fixed_shards and n > 2 * self.shards * SHARD_KEYS):
            self.shards = self.shards if self.fixed_shards else max(shuffle_width(self.spark), -(-n // SHARD_KEYS))
            self._empty = True
        if self._empty:
            self.filters = materialize(self._built(self._repeated(self.refs)), "line-filters")
            self._empty = False
            return
        now, was = self._repeated(self.refs), self._repeated(before)
        step = now.join(was.hint("merge"), "h", "left_anti").withColumn("up", F.lit(True))
        step = step.unionByName(was.join(now.hint("merge"), "h", "left_anti").withColumn("up", F.lit(False)))
        step = step.withColumn("shard", self._shard(F.col("h")))

        def update(key: tuple, old: pa.Table, changes: pa.Table) -> pa.Table:
            h = np.asarray(changes["h"].to_numpy(), dtype=np.int64)
            up = np.asarray(changes["up"].to_numpy(zero_copy_only=False), dtype=bool)
            f = CuckooFilter.from_bytes(old["filter"][0].as_py()) if old.num_rows else build(h[:0])
            f.delete(h[~up])
            if not old.num_rows:
                f = build(h[up])
            full = int((f.table != 0).sum()) + int(up.sum()) > 0.9 * f.table.size if old.num_rows else False
            fits = not old.num_rows or (not full and f.insert(h[up]))
            # One that has become too small is left empty here and built anew from the exact table.
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.to_bytes() if fits else b""], pa.binary())})

        changed = self.filters.groupBy("shard").cogroup(step.groupBy("shard")).applyInArrow(update, "shard int, filter binary")
        filters = materialize(changed, "line-filters")
        full = filters.where(F.length("filter") == 0).select("shard")
        if not full.isEmpty():
            anew = self._built(now.join(full, self._shard(F.col("h")) == F.col("shard"), "left_semi"))
            filters = materialize(filters.where(F.length("filter") > 0).unionByName(anew), "line-filters", instead_of=filters)
        self.filters = filters

    def _built(self, hashes: DataFrame) -> DataFrame:
        def make(key: tuple, rows: pa.Table) -> pa.Table:
            f = build(np.asarray(rows["h"].to_numpy(), dtype=np.int64))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})

        return hashes.withColumn("shard", self._shard(F.col("h"))).groupBy("shard").applyInArrow(make, "shard int, filter binary")

    def repeated(self, documents: DataFrame) -> DataFrame:
        """``(doc_id, keys)``: the digests of the lines each document has to lose."""
        lines = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(_keys(F.col("text"), self.min_points)).alias("key"))
        return self._losing(lines)

    def _losing(self, postings: DataFrame) -> DataFrame:
        h = self._hash()
        # Shards with more rows than others, as of a line that most documents have, are dealt
        # over more groups by document: one row here for each shard.
        load = self.refs.groupBy(self._shard(h).alias("shard")).agg(F.sum("refs").alias("rows"))
        mean = F.avg("rows").over(Window.partitionBy(F.lit(0)))
        salts = load.select("shard", F.greatest(F.ceil(2 * F.col("rows") / mean), F.ceil(F.col("rows") / GROUP_ROWS)).cast("int").alias("salts"))
        salts = F.broadcast(materialize(salts, "line-salts"))
        probe = postings.select("key", "doc_id", h.alias("h"), self._shard(h).alias("shard")).join(salts, "shard")
        probe = probe.select("key", "doc_id", "h", "shard", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"))
        salted = self.filters.join(salts, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

        def passing(held: pa.Table, rows: pa.Table) -> pa.Table:
            if not rows.num_rows or not held.num_rows:
                return rows.slice(0, 0).select(["key", "doc_id"])
            keep = CuckooFilter.from_bytes(held["filter"][0].as_py()).contains(rows["h"].to_numpy())
            return rows.filter(pa.array(keep)).select(["key", "doc_id"])

        through = salted.groupBy("shard", "salt").cogroup(probe.groupBy("shard", "salt")).applyInArrow(passing, "key binary, doc_id long")
        exact = self.refs.where("refs >= 2").select("key", "first_doc")
        losing = through.join(exact, "key").where(F.col("doc_id") != F.col("first_doc"))
        return losing.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def clean(self, documents: DataFrame) -> DataFrame:
        """All rows with ``n_lines``, ``n_dropped`` and ``kept``, the text without lost lines.

        A key loses its lines in all documents but the smallest ``doc_id``.
        ``documents`` must have been inserted before. Their columns may have any
        names; those called like a result give way to it.
        """
        n = Names(documents)
        losing = self._losing(self.postings).select(F.col("doc_id").alias(n.doc), F.col("keys").alias(n.keys))
        rows = documents.withColumn(n.lines, split_lines(F.col("text")))
        out = rows.join(losing, F.col("doc_id") == F.col(n.doc), "left")
        kept = F.when(F.col(n.keys).isNull(), F.col(n.lines)).otherwise(
            F.filter(n.lines, lambda x: (F.length(line_key(x)) < self.min_points) | ~F.array_contains(n.keys, digest(line_key(x))))
        )
        out = out.withColumn(n.kept, kept)
        return out.select(
            *[quoted(c) for c in documents.columns if c not in RESULTS],
            F.size(n.lines).cast("long").alias("n_lines"),
            (F.size(n.lines) - F.size(n.kept)).cast("long").alias("n_dropped"),
            F.array_join(n.kept, "\n").alias("kept"),
        )


def dedup_lines(documents: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Every document with the text it keeps, in one batch from an empty store."""
    store = LineStore(documents.sparkSession, min_points=min_points)
    store.insert(documents)
    return store.clean(documents)
