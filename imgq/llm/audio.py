"""Chroma fingerprints of recordings, and search by offset histograms.

A recording is cut into overlapping frames; each frame's spectrum is folded to
twelve pitch classes. Filters compare rectangles of that picture (time by pitch
class), whose sums come from its integral image; every filter's answer is cut
to two bits, and the bits of all filters at one time are packed into one
32-bit integer.

Two recordings meet where they share two thirds of an integer's bits (any two of
three pieces), at the place where such a key begins; a held note or silence has
one beginning however long it lasts. The offset of the two places is a candidate
if a few integers before and after it agree too, and the share of differing bits in the whole
overlap decides. Recordings with equal fingerprints are one class, so that
copies are neither indexed nor searched twice. The stated queries stand against
all classes; a key that many recordings share is split by Spark as any skewed join.

Edge cases: null, empty or short recordings (less than ``FILTER_FRAMES``
frames) have an empty fingerprint and match nothing; silence gives integers of
zero bits and matches silence. Rows that repeat an id are members of their
classes each. Ties between offsets go to the smallest error, then the smallest
offset. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATE, FRAME, HOP = 4000, 1024, 256
FILTER_FRAMES = 16
#: Bits of answers: ratios of the two areas' sums, in logarithms.
STEPS = (-0.25, 0.0, 0.25)
MAX_ERROR = 0.2
#: Integers around a shared key (their distances) that are compared first, and the error
#: they may have. Neighbours share most of their frames; those further apart say more.
CONTEXT, CONTEXT_ERROR = range(-12, 13, 3), 0.24
#: The shorter overlap that still counts, as a share of the shorter fingerprint.
MIN_OVERLAP = 0.25


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters.

    Kinds: 0 lower against upper half, 1 earlier against later half, 2 outer
    against middle third in pitch, 3 the same in time. Sizes follow one rule.
    """
    out = []
    for k in range(16):
        height = 3 * (1 + k // 4) if k % 4 in (0, 2) else 2 * (1 + k // 4)
        out.append((k % 4, (5 * k) % (12 - height + 1), height, FILTER_FRAMES if k % 4 == 3 else 4 * (1 + k // 4)))
    return out


def pcm16(value: bytes | None) -> np.ndarray:
    """Samples of little-endian 16-bit PCM."""
    return np.frombuffer(value or b"", dtype="<i2").astype(np.float32) / 32768


def melody(vector: list[float] | None, note: int = 256) -> np.ndarray:
    """A vector played as notes, one for each element, two octaves up and down from 440 Hz."""
    v = np.nan_to_num(np.asarray(vector if vector is not None else [], dtype=np.float64))
    if not len(v):
        return np.zeros(0, dtype=np.float32)
    steps = np.clip(np.rint(v * 48), -24, 24)
    phase = np.cumsum(np.repeat(440.0 * 2 ** (steps / 12) / RATE, note)) * 2 * np.pi
    return (0.7 * np.sin(phase) + 0.3 * np.sin(2 * phase)).astype(np.float32)


def _pitch_classes() -> np.ndarray:
    """Weights of spectrum bins in pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), dtype=np.float32)
    used = (hz >= 55) & (hz <= 1800)
    out[np.flatnonzero(used), np.rint(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    return out


class Fingerprinter:
    def __init__(self):
        self.window, self.fold, self.filters = np.hanning(FRAME).astype(np.float32), _pitch_classes(), filters()

    def chroma(self, samples: np.ndarray) -> np.ndarray:
        n = (len(samples) - FRAME) // HOP + 1
        if n < 1:
            return np.zeros((0, 12))
        frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
        out = np.empty((len(frames), 12))
        for at in range(0, len(frames), 512):  # bounded memory for long recordings
            power = np.abs(np.fft.rfft(frames[at : at + 512] * self.window, axis=1)) ** 2
            out[at : at + 512] = power.astype(np.float32) @ self.fold
        total = out.sum(axis=1, keepdims=True)
        return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 0.0)

    def integers(self, samples: np.ndarray) -> np.ndarray:
        picture = self.chroma(samples)
        n = len(picture) - FILTER_FRAMES + 1
        if n < 1:
            return np.zeros(0, dtype=np.int32)
        area = np.zeros((len(picture) + 1, 13))
        area[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
        t = np.arange(n)

        def box(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
            return area[t + t1, y1] - area[t + t0, y1] - area[t + t1, y0] + area[t + t0, y0]

        packed = np.zeros(n, dtype=np.uint32)
        for kind, y, h, w in self.filters:
            if kind == 0:
                a, b = box(0, w, y, y + h // 2), box(0, w, y + h // 2, y + h)
            elif kind == 1:
                a, b = box(0, w // 2, y, y + h), box(w // 2, w, y, y + h)
            elif kind == 2:
                b = box(0, w, y + h // 3, y + 2 * h // 3)
                a = (box(0, w, y, y + h) - b) / 2
            else:
                b = box(w // 4, 3 * w // 4, y, y + h)
                a = box(0, w, y, y + h) - b
            answer = np.log((1 + 50 * a) / (1 + 50 * b))
            level = np.searchsorted(STEPS, answer, side="left").astype(np.uint32)
            packed = (packed << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbours differ by a bit
        return packed.view(np.int32)


def fingerprints(recordings: DataFrame, media: str, decode: Callable[[object], np.ndarray] = pcm16) -> DataFrame:
    """``(rec_id, prints)``: the integers of every recording.

    ``recordings`` has rec_id and the column ``media``, which ``decode`` turns
    into samples at ``RATE``.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter()
        for batch in it:
            made = [f.integers(decode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["rec_id", "prints"])

    return recordings.select(F.col("rec_id").cast("long"), media).mapInArrow(run, "rec_id long, prints array<int>")


def heard_again(vector: list[float] | None) -> np.ndarray:
    """The melody of a vector as another recording has it: begun late and with noise."""
    samples = melody(vector)[2 * 256 + 100 :]
    seed = zlib.crc32(np.asarray(vector if vector is not None else [], dtype=np.float64).tobytes())
    return samples + 0.2 * np.random.default_rng(seed).standard_normal(len(samples)).astype(np.float32)


def _differing(a: Column, b: Column) -> Column:
    """Differing bits of two integers; a negative one would count 32 bits more."""
    return F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def _classes(prints: DataFrame, name: str) -> DataFrame:
    made = prints.groupBy("prints").agg(F.min("rec_id").alias(name), F.count(F.lit(1)).alias("copies"))
    return materialize(made, "audio-classes")


def _places(classes: DataFrame, name: str) -> DataFrame:
    """A row for each beginning of a key: name, at, key, and the integers around it (null beyond the ends)."""
    rows = classes.select(name, "prints", F.posexplode("prints").alias("at", "h"))
    keys = lambda h: [h.bitwiseAND(0x3FFFFF), F.shiftrightunsigned(h, 11) + (1 << 22), h.bitwiseAND(0x7FF) + F.shiftleft(F.shiftrightunsigned(h, 22), 11) + (1 << 23)]
    before = F.when(F.col("at") > 0, F.get("prints", F.col("at") - 1))
    begun = [F.when(before.isNull() | (k != b), k) for k, b in zip(keys(F.col("h")), keys(before), strict=True)]
    around = [F.get("prints", F.col("at") + k).alias(f"h{i}") for i, k in enumerate(CONTEXT)]
    return rows.select(name, "at", *around, F.explode(F.array_compact(F.array(*begun))).alias("key"))


def search(prints: DataFrame, queries: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """What matches each query: rec_id, query_class, class_id, copies, offset, overlap, bit_error.

    ``prints`` and ``queries`` are written tables of (rec_id, prints). A query
    class is the smallest rec_id of the queries with one fingerprint: its row
    stands for all of them. That recording has a row for each class of
    ``prints`` that matches it (class_id: the smallest id with that fingerprint,
    copies: how many rows have it, offset: the place in the class's fingerprint
    where the query's begins), or one with nulls; others have one with nulls.
    """
    classes, asked = _classes(prints, "class_id"), _classes(queries, "query_class")
    held = _places(classes, "class_id")
    wanted = _places(asked, "query_class").withColumnsRenamed({"at": "q_at", **{f"h{i}": f"q{i}" for i in range(len(CONTEXT))}})
    differ = [_differing(F.col(f"h{k}"), F.col(f"q{k}")) for k in range(len(CONTEXT))]
    wrong = sum((F.coalesce(x, F.lit(0)) for x in differ[1:]), F.coalesce(differ[0], F.lit(0)))
    seen = sum((x.isNotNull().cast("int") for x in differ[1:]), differ[0].isNotNull().cast("int"))
    near = wanted.join(held.hint("merge"), "key").where(wrong <= CONTEXT_ERROR * 32 * seen)
    offsets = near.select("query_class", "class_id", (F.col("at") - F.col("q_at")).alias("offset")).distinct()
    pair = offsets.join(asked.select("query_class", F.col("prints").alias("p")).hint("merge"), "query_class").join(classes.select("class_id", "copies", F.col("prints").alias("r")).hint("merge"), "class_id")
    first = F.greatest(F.lit(0), -F.col("offset"))
    last = F.least(F.size("p"), F.size("r") - F.col("offset"))
    errors = F.aggregate(F.sequence(first, last - 1), F.lit(0), lambda a, i: a + _differing(F.col("p")[i], F.col("r")[i + F.col("offset")]))
    scored = pair.select("query_class", "class_id", "copies", "offset", (last - first).alias("overlap"), F.least(F.size("p"), F.size("r")).alias("shorter"), (errors / (32 * (last - first))).alias("bit_error"))
    good = scored.where((F.col("bit_error") <= max_error) & (F.col("overlap") >= MIN_OVERLAP * F.col("shorter")))
    best = good.groupBy("query_class", "class_id").agg(F.min(F.struct("bit_error", "offset", "overlap", "copies")).alias("b"))
    best = best.select(F.col("query_class").alias("_class"), "class_id", "b.copies", F.col("b.offset").cast("long").alias("offset"), F.col("b.overlap").cast("long").alias("overlap"), "b.bit_error")
    members = queries.join(asked.select("prints", "query_class"), "prints").select("rec_id", "query_class")
    # Of rows that repeat the id of a class's first recording, each has the matches.
    heads = members.where(F.col("rec_id") == F.col("query_class")).join(best, F.col("query_class") == F.col("_class"), "left").drop("_class")
    none = [F.lit(None).cast(t).alias(c) for c, t in heads.dtypes if c not in ("rec_id", "query_class")]
    return heads.unionByName(members.where(~F.coalesce(F.col("rec_id") == F.col("query_class"), F.lit(False))).select("rec_id", "query_class", *none))
