"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Only lengths decide how documents are packed, and there are at most
``max_tokens`` different ones. So the packing is planned on the histogram of
lengths, which has at most ``max_tokens`` rows whatever the input, as patterns
("a sequence of these lengths, so many times"); each piece then finds its own
place from its rank among the pieces of its length. Ranks are counted in
buckets of a hash, so that a length shared by many pieces is no hot key.

A pattern starts with the longest length left and takes the longest that still
fits until none does. Then its smallest member may give way to two unpacked
ones that fill its place and the gap more tightly.

Edge cases: a null or empty text has the end token only. Rows that repeat a
``doc_id`` are packed as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import Names, columns, materialize, shuffle_width
from .tokens import coder, vocabulary

MAX_TOKENS = 2048
END = (0).to_bytes(4, "little")


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: how often}, times)`` that use up the histogram."""
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    left = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in histogram.items():
        left[x] = n
    plan = []
    while left.any():
        bin_: dict[int, int] = {}
        spare = left.copy()

        def put(x: int, n: int = 1, bin_: dict[int, int] = bin_, spare: np.ndarray = spare) -> None:
            bin_[x] = bin_.get(x, 0) + n
            spare[x] -= n
            if not bin_[x]:
                del bin_[x]

        gap = capacity
        while gap and (fit := np.flatnonzero(spare[: gap + 1])).size:
            x = int(fit[-1])
            n = min(int(spare[x]), gap // x)
            put(x, n)
            gap -= n * x
        while gap:
            small = min(bin_)
            room = gap + small
            sizes = np.flatnonzero(spare[:room])
            if not len(sizes):
                break
            at = np.searchsorted(sizes, room - sizes, side="right") - 1
            other = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
            # Two of one length need two of it.
            same = (other == sizes) & (spare[sizes] < 2)
            other = np.where(same, np.where(at > 0, sizes[np.maximum(at - 1, 0)], 0), other)
            total = np.where(other > 0, sizes + other, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            put(small, -1)
            put(int(sizes[best]))
            put(int(other[best]))
            gap = room - int(total[best])
        times = min(int(left[x]) // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= times * n
        plan.append((bin_, times))
    return plan


class Places:
    """Where the piece of a given length and rank goes, by the plan."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows, taken, base = [], {}, 0
        for bin_, times in plan:
            offset = 0
            for x in sorted(bin_, reverse=True):
                n = bin_[x]
                rows.append((x, taken.get(x, 0), n, base, offset))
                taken[x] = taken.get(x, 0) + n * times
                offset += n * x
            base += times
        rows.sort()
        self.length, self.rank, self.each, self.base, self.offset = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(5))
        self.key = (self.length << 44) | self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) | rank, side="right") - 1
        d = rank - self.rank[at]
        return self.base[at] + d // self.each[at], self.offset[at] + d % self.each[at] * length


def tokenize(documents: DataFrame, max_tokens: int = MAX_TOKENS, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = path or vocabulary()

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in it:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(c.encode(text or "") + END)
                n = len(ids) // 4
                first = (n - 1) % max_tokens + 1
                for k, to in enumerate(range(first, n + 1, max_tokens)):
                    start = max(0, to - max_tokens) if k else 0
                    part = ids[4 * start : 4 * to]
                    out.append((doc_id, k, start, to - start, zlib.crc32(part), bytes(part) if keep_ids else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.int64()) for x in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = [StructField("doc_id", LongType()), StructField("piece", IntegerType())]
    fields += [StructField(c, LongType()) for c in ("start", "length", "ids_crc32")] + [StructField("ids", BinaryType())] * keep_ids
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, StructType(fields))


def place(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    ``pieces`` is read more than once: pass a table that has been written. Other
    columns may have any names but those two, which are an error.
    """
    spark, names = pieces.sparkSession, pieces.columns
    if clash := {"sequence_id", "offset"} & set(names):
        raise ValueError(f"the pieces already have {sorted(clash)}")
    n = Names(pieces)
    inner = pieces.withColumn(n.bucket, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_width(spark))).cast("int"))
    counts = inner.groupBy("length", n.bucket).agg(F.count(F.lit(1)).alias(n.count))
    # At most max_tokens rows.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum(n.count)).collect()}
    places = spark.sparkContext.broadcast(Places(best_two_fit(histogram, max_tokens)))
    before = Window.partitionBy("length").orderBy(n.bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", n.bucket, F.coalesce(F.sum(n.count).over(before), F.lit(0)).alias(n.first))
    within = Window.partitionBy("length", n.bucket).orderBy("doc_id", "piece", "start")
    ranked = inner.join(starts, ["length", n.bucket]).withColumn(n.rank, F.col(n.first) + F.row_number().over(within) - 1)
    ranked = ranked.select(*columns(pieces), n.rank)

    def seat(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seq, offset = places.value.find(batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(seat, schema)


def pack(documents: DataFrame, max_tokens: int = MAX_TOKENS, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents; one row for each piece.

    Of the documents only doc_id (which may be null or repeated) and text are read.
    """
    return place(materialize(tokenize(documents, max_tokens, path, keep_ids), "pieces"), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, its pieces in order and their ids.

    ``packed`` must have been made with ``keep_ids``; a sequence is at most
    ``max_tokens`` ids, so no group is large.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    return out.select(
        "sequence_id",
        F.transform("rows", lambda r: F.struct(r["doc_id"], r["piece"], r["offset"], r["length"])).alias("pieces"),
        F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids"),
    )
