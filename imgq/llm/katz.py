"""A Katz backoff bigram model with Good-Turing discounts, trained and evaluated on Spark.

Tokens are words and one end for each text. With ``c`` the counts and ``d`` the
discounts of one order, and z(v) = c(v),

    P(w | v) = d c(v, w) / z(v)                if c(v, w) > 0
             = alpha(v) P(w)                   otherwise
    P(w)     = d c(w) / N,  P(unseen) = what is left

alpha(v) is exactly what makes P(. | v) add up to one; words never seen in
training are one class of their own, and after a word never seen alpha is one.
Only where no follower of v has a discounted count, so that nothing would be
left to back off with, z(v) = c(v) + 1. Every training word has bigrams of its
own, however rare it is.

How it runs. Words that make up at least one token in ``share`` have short codes,
which are sent along (there are ``share`` of them at most); others go by 63-bit
hashes. Chunks of documents send their distinct bigrams with counts to parts. A
bigram's part follows from its history, and also from the follower where the
history is so frequent that one part could not hold it. Rare followers' counts are
then fetched from the parts of the unigram table, and alpha follows. Scoring sends
the chunks' bigrams to the parts of the model, and sums by document back. Bigrams
that make up one in ``share`` or more are sent along with the codes. Codes and
hashes only say where a number is kept; no score depends on ``share``.

Edge cases: null and empty texts are the end token alone. With no training row
every token is of the unseen class, whose probability is then one. Rows that
repeat a ``doc_id`` are scored each, and those without one too. Columns besides
doc_id and text do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize

BEGIN, END, FIRST = 0, 1, 2
SHIFT = 21  # codes fit in so many bits
RARE = np.uint64(1 << 63)  # set in the number of a word without a code
#: Good-Turing holds for counts up to K.
K = 5


@dataclass(frozen=True)
class Settings:
    """How the work is cut; results do not depend on it."""

    share: int = 1 << (SHIFT - 1)
    part_tokens: int = 2_000_000
    chunk_tokens: int = 1_000_000
    chunk_docs: int = 60_000


_END_WORD = b""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# -- Good-Turing ---------------------------------------------------------------


class Discounts:
    """Katz's discounts from counts of counts ``n[r]``, r from 1 to K + 1.

    Where they are not defined, as in very small corpora, half a count is taken
    from each kind instead.
    """

    def __init__(self, n: list[int]):
        self.d: list[float] | None = None
        if all(n[: K + 1]):
            a = (K + 1) * n[K] / n[0]
            d = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if a != 1 else 0.0 for r in range(1, K + 1)]
            if all(0 < x <= 1 for x in d):
                self.d = d

    def discounted(self, c: np.ndarray) -> np.ndarray:
        """``d c`` for counts of at least one."""
        c = np.asarray(c, dtype=np.float64)
        if self.d is None:
            return c - 0.5
        return np.where(c <= K, c * np.array([1.0, *self.d])[np.minimum(c, K).astype(np.int64)], c)


# -- packed arrays ---------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as one compressed value, byte planes apart."""
    head = np.array([x for a in arrays for x in (a.dtype.itemsize, len(a))], dtype="<i8")
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return len(arrays).to_bytes(1, "little") + zstandard.compress(head.tobytes() + body, 3)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n = data[0]
    raw = zstandard.decompress(data[1:])
    head = np.frombuffer(raw, dtype="<i8", count=2 * n).reshape(n, 2)
    out, at = [], 16 * n
    for (width, size), kind in zip(head.tolist(), kinds, strict=True):
        planes = np.frombuffer(raw, dtype=np.uint8, count=width * size, offset=at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if size else np.zeros(0, kind))
        at += width * size
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """A sorted array by its differences, which compress better."""
    return np.diff(keys, prepend=keys.dtype.type(0))


# -- vocabulary -----------------------------------------------------------------


def word_counts(training: DataFrame) -> DataFrame:
    """``(word, c)`` of all training tokens; the empty word is the end."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

        for batch in it:
            for text in batch.column(0).to_pylist():
                c.update(tokens(text))
                c[_END_WORD] += 1
            if len(c) > 600_000:
                yield out()
                c.clear()
        yield out()

    return training.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Codes of the common words, and what is known of unigrams without asking."""

    def __init__(self, common: list[tuple[bytes, int]], total: int, kinds: int, n_r: list[int], settings: Settings):
        self.total, self.kinds, self.discounts, self.settings = total, kinds, Discounts(n_r), settings
        common = sorted(common, key=lambda x: (-x[1], x[0]))
        ends = dict(common).get(_END_WORD, 0)
        named = [(w, c) for w, c in common if w != _END_WORD]
        self.code = {w: FIRST + i for i, (w, _) in enumerate(named)}
        self.count = np.array([ends, ends, *(c for _, c in named)], dtype=np.int64)
        d = self.discounts.d
        kept = total - (0.5 * kinds if d is None else sum((1 - x) * r * n for r, (x, n) in enumerate(zip(d, n_r, strict=False), 1)))
        self.p_unseen = 1 - kept / max(total, 1)
        self.p = np.where(self.count > 0, self.probability(np.maximum(self.count, 1)), 0.0)
        self.p[BEGIN] = 0.0
        self.parts = max(1, -(-total // settings.part_tokens))
        #: Over how many parts a history's followers are dealt.
        self.splits = 1 + 4 * self.count // settings.part_tokens

    def probability(self, count: np.ndarray) -> np.ndarray:
        """P of words with these counts, of at least one."""
        return self.discounts.discounted(count) / max(self.total, 1)

    def log_p(self, count: np.ndarray) -> np.ndarray:
        """log10 P, where a count of zero is the unseen class."""
        p = np.where(count > 0, self.probability(np.maximum(count, 1)), self.p_unseen)
        return np.log10(np.where(p > 0, p, 1.0))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.total + self.kinds + 1))

    def part_of(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The part of bigrams, by the numbers of both words."""
        splits = np.where(v < RARE, self.splits[np.where(v < RARE, v, 0).astype(np.int64)], 1).astype(np.uint64)
        return (_mix(v ^ ((_mix(w) % splits) << np.uint64(40))) % np.uint64(self.parts)).astype(np.int64)


def build_vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """From a written table of word counts."""
    small = [F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2)]
    s = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds"), *small).first()
    total = int(s["total"])
    # At most ``share`` rows have so large a share; the end has a code in any case.
    rows = counts.where((F.col("c") >= total / settings.share) | (F.col("word") == _END_WORD)).toPandas()
    common = list(zip(map(bytes, rows["word"]), map(int, rows["c"]), strict=True))
    return Vocabulary(common, total, int(s["kinds"]), [s[f"n{r}"] for r in range(1, K + 2)], settings)


# -- parts -------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit number for a bigram."""
    return _mix(_mix(v) ^ w)


def word_part(h: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(h) % np.uint64(parts)).astype(np.int64)


class Chunk:
    """Some documents with their tokens, one after the other, as numbers."""

    def __init__(self, ids: list, texts: list[list[bytes]], vocabulary: Vocabulary):
        self.ids, self.sizes = ids, np.array([len(t) + 1 for t in texts], dtype=np.int64)
        words = [w for t in texts for w in (*t, _END_WORD)]
        code = np.fromiter(map(vocabulary.code.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        last = np.cumsum(self.sizes) - 1
        code[last] = END
        self.w = code.astype(np.uint64)
        rare = np.flatnonzero(code < 0)
        self.w[rare] = np.fromiter((xxh64_intdigest(words[i]) for i in rare.tolist()), dtype=np.uint64, count=len(rare)) | RARE
        self.v = np.empty_like(self.w)
        self.v[1:] = self.w[:-1]
        self.v[np.concatenate([[0], last[:-1] + 1])] = BEGIN
        self.doc = np.repeat(np.arange(len(ids)), self.sizes).astype(np.uint16)
        self.coded = (self.v < RARE) & (self.w < RARE)

    def keys(self) -> np.ndarray:
        """Numbers of the bigrams of two common words."""
        return ((self.v[self.coded] << np.uint64(SHIFT)) | self.w[self.coded]).astype(np.int64)


def chunks(it: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[Chunk]:
    """The rows (doc_id, text) of a task in chunks of bounded size (but for single long texts)."""
    most = vocabulary.settings
    ids, texts, n = [], [], 0
    for batch in it:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = tokens(text)
            if ids and (n + len(words) >= most.chunk_tokens or len(ids) >= most.chunk_docs):
                yield Chunk(ids, texts, vocabulary)
                ids, texts, n = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            n += len(words) + 1
    if ids:
        yield Chunk(ids, texts, vocabulary)


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of bigrams of two common words."""
    k = key.astype(np.uint64)
    return k >> np.uint64(SHIFT), k & np.uint64((1 << SHIFT) - 1)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]]) if len(sorted_values) else np.zeros(1, np.int64)


def _spans(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted parts."""
    at = _runs(part).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(part[a]), a, b


def _summed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with the sums of ``n``."""
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    if not len(v):
        return v, w, n
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    return v[new], w[new], np.add.reduceat(n, new)


# -- training -----------------------------------------------------------------------

#: Kinds of rows: bigrams of coded words; other bigrams; sums of a coded history;
#: frequent bigrams; counts of counts; counts of rare words; rare histories.
BIGRAMS, PAIRS, HISTORY, FREQUENT, SIZES, RARE_WORDS, RARE_HISTORIES = range(7)
_SUMS = [*[f"n{r}" for r in range(1, K + 1)], "kinds_more", "more", "six"]
_COUNTED = "kind int, part int, blob binary, v long, " + ", ".join(f"{x} long" for x in _SUMS) + ", p double"


def count_bigrams(it: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, blob) of the chunks' distinct bigrams."""
    for c in chunks(it, voc):
        rows = []
        keys, n = np.unique(c.keys(), return_counts=True)
        part = voc.part_of(*_split(keys))
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order].astype(np.uint32), part[order]
        rows += [(p, BIGRAMS, pack(steps(keys[a:b]), n[a:b])) for p, a, b in _spans(part)]
        v, w = c.v[~c.coded], c.w[~c.coded]
        v, w, n = _summed(v, w, np.ones(len(v), np.int64))
        part = voc.part_of(v, w)
        order = np.argsort(part, kind="stable")
        v, w, n, part = v[order], w[order], n[order].astype(np.uint32), part[order]
        rows += [(p, PAIRS, pack(steps(v[a:b]), w[a:b], n[a:b])) for p, a, b in _spans(part)]
        yield _batch(rows, (pa.int32(), pa.int32(), pa.binary()), ("part", "kind", "blob"))


def _batch(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _sums_by(v: np.ndarray, c: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of small counts, and what larger ones add up to, by history."""
    own, at = np.unique(v, return_inverse=True)
    add = lambda x: np.bincount(at, weights=x, minlength=len(own))
    out = {f"n{r}": add(c == r) for r in range(1, K + 1)}
    out |= {"kinds_more": add(c > K), "more": add(np.where(c > K, c, 0)), "six": add(c == K + 1)}
    return {"v": own} | {k: x.astype(np.int64) for k, x in out.items()} | {"p": add(p)}


def merge_counts(part: int, kinds: list[int], blobs: list[bytes], voc: Vocabulary) -> pa.Table:
    """The chunks' bigrams of one part, added up."""
    coded = [unpack(b, "<i8", "<u4") for k, b in zip(kinds, blobs, strict=True) if k == BIGRAMS]
    if coded:
        keys, at = np.unique(np.concatenate([np.cumsum(k) for k, _ in coded]), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([n for _, n in coded])).astype(np.int64)
    else:
        keys, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = [unpack(b, "<u8", "<u8", "<u4") for k, b in zip(kinds, blobs, strict=True) if k == PAIRS]
    join = lambda i, kind: np.concatenate([x[i] for x in other]) if other else np.zeros(0, kind)
    v2 = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in other]) if other else np.zeros(0, np.uint64)
    v2, w2, c2 = _summed(v2, join(1, np.uint64), join(2, np.int64).astype(np.int64))
    v1, w1 = _split(keys)
    own = v2 < RARE  # rare followers of coded histories; their probabilities come later
    sums = _sums_by(np.concatenate([v1, v2[own]]).astype(np.int64), np.concatenate([c, c2[own]]), np.concatenate([voc.p[w1.astype(np.int64)], np.zeros(int(own.sum()))]))
    rest = _sums_by(np.zeros(int((~own).sum()), np.int64), c2[~own], np.zeros(int((~own).sum())))
    often = c >= voc.total / voc.settings.share
    n, m = len(sums["v"]), len(rest["v"])
    cols = {
        "kind": pa.array([BIGRAMS, PAIRS, FREQUENT, *[HISTORY] * n, *[SIZES] * m], pa.int32()),
        "part": pa.array([part] * (3 + n + m), pa.int32()),
        "blob": pa.array([pack(steps(keys), c), pack(steps(v2), w2, c2), pack(keys[often], c[often]), *[None] * (n + m)], pa.binary()),
        "v": pa.array(np.concatenate([[-1] * 3, sums["v"], [-1] * m]).astype(np.int64)),
    }
    for x in (*_SUMS, "p"):
        values = np.concatenate([np.zeros(3), sums[x], rest[x]])
        cols[x] = pa.array(values if x == "p" else values.astype(np.int64))
    return pa.table(cols)


def ask_counts(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The rare followers of each part, for the parts of the unigram table."""
    for batch in it:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = np.unique(unpack(blob, "<u8", "<u8", "<i8")[1])
            w = w[w >= RARE]
            to = word_part(w, parts)
            order = np.argsort(to, kind="stable")
            w, to = w[order], to[order]
            yield _batch([(p, part, pack(steps(w[a:b]))) for p, a, b in _spans(to)], (pa.int32(), pa.int32(), pa.binary()), ("at", "part", "blob"))


def _unigrams(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [unpack(b, "<u8", "<i8") for b in blobs]
    h = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in got]) if got else np.zeros(0, np.uint64)
    c = np.concatenate([x for _, x in got]) if got else np.zeros(0, np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def normalise(pairs: list[bytes], answers: list[bytes], voc: Vocabulary, d: Discounts) -> list[tuple[int, bytes | None, int, float]]:
    """Rows (kind, blob, v, p) of a part: its other bigrams, its rare histories, and sums for coded ones."""
    got = [unpack(b, "<u8", "<u8", "<i8") for b in pairs]
    if not got:
        return []
    v, w, c = (np.concatenate([x[i] if i else np.cumsum(x[0], dtype=np.uint64) for x in got]) for i in range(3))
    h, n = _unigrams(answers)
    rare = w >= RARE
    cw = np.zeros(len(w), dtype=np.int64)
    cw[rare] = _look_up(h, n, w[rare])
    p = np.empty(len(w))
    p[rare] = voc.probability(cw[rare])
    p[~rare] = voc.p[w[~rare].astype(np.int64)]
    coded = v < RARE
    at, where = np.unique(v[coded], return_inverse=True)
    added = np.bincount(where, weights=p[coded], minlength=len(at))
    out: list[tuple[int, bytes | None, int, float]] = [(HISTORY, None, int(x), float(y)) for x, y in zip(at, added, strict=True)]
    at, where = np.unique(v[~coded], return_inverse=True)
    add = lambda x: np.bincount(where, weights=x, minlength=len(at))
    log_z, log_alpha = weights(add(c[~coded]), add(d.discounted(c[~coded])), add(p[~coded]))
    out.append((RARE_HISTORIES, pack(steps(at), log_z, log_alpha), -1, 0.0))
    key = pair_key(v, w)
    order = np.argsort(key)
    out.append((PAIRS, pack(steps(key[order]), c[order], cw[order]), -1, 0.0))
    return out


def weights(c: np.ndarray, kept: np.ndarray, seen_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of z and alpha of histories, from their counts, kept counts and their followers' probabilities."""
    z = c + (kept > c - 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(c > 0, (1 - kept / z) / np.maximum(1 - seen_p, 1e-300), 1.0)
        return np.log10(np.maximum(z, 1)), np.log10(alpha)


class Model:
    """The trained model: bounded arrays by code, and tables of parts."""

    def __init__(self, vocabulary: Vocabulary, discounts: Discounts, tables: DataFrame | None, sums: dict[str, np.ndarray], frequent: tuple[np.ndarray, np.ndarray]):
        self.vocabulary, self.discounts, self.tables = vocabulary, discounts, tables
        size = len(vocabulary.count)
        c, kept, seen_p = np.zeros(size), np.zeros(size), np.zeros(size)
        v = sums["v"]
        for r in range(1, K + 1):
            c[v] += r * sums[f"n{r}"]
            kept[v] += discounts.discounted(np.array([r]))[0] * sums[f"n{r}"]
        c[v] += sums["more"]
        kept[v] += sums["more"] if discounts.d is not None else sums["more"] - 0.5 * sums["kinds_more"]
        seen_p[v] = sums["p"]
        self.log_z, self.log_alpha = weights(c, kept, seen_p)
        self.frequent = frequent


def train(training: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Count, discount and normalise over ``training`` (doc_id, text)."""
    spark = training.sparkSession
    counts = materialize(word_counts(training), "katz-words")
    voc = build_vocabulary(counts, settings)
    sent = spark.sparkContext.broadcast(voc)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        return merge_counts(key[0].as_py(), rows["kind"].to_pylist(), rows["blob"].to_pylist(), sent.value)

    sent_rows = training.select("doc_id", "text").mapInArrow(lambda it: count_bigrams(it, sent.value), "part int, kind int, blob binary")
    merged = materialize(sent_rows.groupBy("part").applyInArrow(merge, _COUNTED), "katz-bigrams")

    rare = counts.where((F.col("c") < voc.total / settings.share) & (F.col("word") != _END_WORD))

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value.parts
        for batch in it:
            h = np.fromiter(map(xxh64_intdigest, batch.column(0).to_pylist()), dtype=np.uint64, count=batch.num_rows) | RARE
            c, part = batch.column(1).to_numpy(), word_part(h, parts)
            order = np.lexsort((h, part))
            h, c, part = h[order], c[order], part[order]
            yield _batch([(RARE_WORDS, p, pack(steps(h[a:b]), c[a:b])) for p, a, b in _spans(part)], (pa.int32(), pa.int32(), pa.binary()), ("kind", "part", "blob"))

    words = materialize(rare.mapInArrow(hashed, "kind int, part int, blob binary"), "katz-rare-words", instead_of=counts)

    sizes = merged.where(F.col("kind").isin(HISTORY, SIZES)).agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, K + 1)], F.coalesce(F.sum("six"), F.lit(0))).first()
    d = Discounts([int(x) for x in sizes])
    others = merged.where(F.col("kind") == PAIRS).select("part", "blob")
    asked = others.mapInArrow(lambda it: ask_counts(it, sent.value.parts), "at int, part int, blob binary")

    def fetch(held: pa.Table, asks: pa.Table) -> pa.Table:
        h, c = _unigrams(held["blob"].to_pylist())
        wanted = [(p, np.cumsum(unpack(b, "<u8")[0], dtype=np.uint64)) for p, b in zip(asks["part"].to_pylist(), asks["blob"].to_pylist(), strict=True)]
        return pa.table({"part": pa.array([p for p, _ in wanted], pa.int32()), "blob": pa.array([pack(steps(w), _look_up(h, c, w)) for _, w in wanted], pa.binary())})

    fetched = words.groupBy("part").cogroup(asked.groupBy("at")).applyInArrow(fetch, "part int, blob binary")

    def settle(held: pa.Table, answers: pa.Table) -> pa.Table:
        part = held["part"][0].as_py() if held.num_rows else -1
        rows = normalise(held["blob"].to_pylist(), answers["blob"].to_pylist(), sent.value, d)
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "blob": pa.array(cols[1], pa.binary()), "v": pa.array(cols[2], pa.int64()), "p": pa.array(cols[3], pa.float64())})

    settled = materialize(others.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(settle, "kind int, part int, blob binary, v long, p double"), "katz-pairs")
    # One row for each code, of which there are few more than ``share``.
    none = [F.lit(0).cast("long").alias(x) for x in _SUMS]
    by_code = merged.where(F.col("kind") == HISTORY).select("v", *_SUMS, "p").unionByName(settled.where(F.col("kind") == HISTORY).select("v", *none, "p"))
    rows = by_code.groupBy("v").agg(*[F.sum(x).alias(x) for x in (*_SUMS, "p")]).toPandas()
    # At most ``share`` bigrams make up so large a part of all.
    often = [unpack(bytes(b), "<i8", "<i8") for b in merged.where(F.col("kind") == FREQUENT).select("blob").toPandas()["blob"]]
    keys = np.concatenate([k for k, _ in often]) if often else np.zeros(0, np.int64)
    order = np.argsort(keys)
    often_counts = np.concatenate([c for _, c in often])[order] if often else keys
    tables = merged.where(F.col("kind") == BIGRAMS).select("kind", "part", "blob").unionByName(settled.where(F.col("kind") != HISTORY).select("kind", "part", "blob")).unionByName(words)
    return Model(voc, d, tables, {x: rows[x].to_numpy() for x in ("v", *_SUMS, "p")}, (keys[order], often_counts))


# -- scoring ------------------------------------------------------------------------


class _Sent:
    """What scoring tasks need of a model; its size is bounded by ``share``."""

    def __init__(self, m: Model):
        self.vocabulary, self.discounts, self.log_z, self.log_alpha, self.frequent = m.vocabulary, m.discounts, m.log_z, m.log_alpha, m.frequent
        self.log_p = m.vocabulary.log_p(m.vocabulary.count)

    def seen(self, c: np.ndarray) -> np.ndarray:
        """log10 of d c, for counts of at least one."""
        return np.log10(self.discounts.discounted(np.maximum(c, 1)))

    def coded(self, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(w | v) of coded words with these counts of bigrams."""
        v, w = v.astype(np.int64), w.astype(np.int64)
        return np.where(c > 0, self.seen(c) - self.log_z[v], self.log_alpha[v] + self.log_p[w])


HEAD, ASK_BIGRAMS, ASK_PAIRS, ASK_WORDS = 10, 11, 12, 13
_ROW = "part int, kind int, chunk long, blob binary"


def _ask(c: Chunk, s: _Sent, chunk: int) -> list[tuple[int, int, int, bytes]]:
    """Rows (part, kind, chunk, blob) for one chunk: what is known here, and what is asked."""
    n, voc = len(c.ids), s.vocabulary
    add = lambda doc, x: np.bincount(doc, weights=x, minlength=n)
    own = c.w < RARE
    count = voc.count[c.w[own].astype(np.int64)]
    known, base = add(c.doc[own], count > 0), add(c.doc[own], voc.base(count))
    keys, doc = c.keys(), c.doc[c.coded]
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    held = _look_up(*s.frequent, keys)
    here = held > 0
    score = add(doc[here], s.coded(*_split(keys[here]), held[here]))
    ids = np.array([x if x is not None else 0 for x in c.ids], dtype=np.int64)
    null = np.array([x is None for x in c.ids], dtype=np.uint8)
    rows = [(int(word_part(np.array([chunk]), voc.parts)[0]), HEAD, chunk, pack(ids, null, c.sizes, known.astype(np.int64), base, score))]

    keys, doc = keys[~here], doc[~here]
    part = voc.part_of(*_split(keys))
    order = np.argsort(part, kind="stable")
    keys, doc, part = keys[order], doc[order], part[order]
    rows += [(p, ASK_BIGRAMS, chunk, pack(steps(keys[a:b]), doc[a:b])) for p, a, b in _spans(part)]

    v, w, doc = c.v[~c.coded], c.w[~c.coded], c.doc[~c.coded]
    part = voc.part_of(v, w)
    order = np.lexsort((v, part))
    v, w, doc, part = v[order], w[order], doc[order], part[order]
    rows += [(p, ASK_PAIRS, chunk, pack(steps(v[a:b]), w[a:b], doc[a:b])) for p, a, b in _spans(part)]

    w, doc = c.w[~own], c.doc[~own]
    part = word_part(w, voc.parts)
    order = np.lexsort((w, part))
    w, doc, part = w[order], doc[order], part[order]
    rows += [(p, ASK_WORDS, chunk, pack(steps(w[a:b]), doc[a:b])) for p, a, b in _spans(part)]
    return rows


def _look_up(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The counts of what is asked, 0 for what is not there; keys are sorted."""
    if not len(keys):
        return np.zeros(len(asked), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0).astype(np.int64)


def _answer(s: _Sent, model: pa.Table, asked: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """Rows (kind, chunk, blob): what each chunk's asks add to its documents."""
    voc = s.vocabulary
    held: dict[int, list[bytes]] = {}
    for kind, blob in zip(model["kind"].to_pylist(), model["blob"].to_pylist(), strict=True):
        held.setdefault(kind, []).append(blob)
    h, n = _unigrams(held.get(RARE_WORDS, []))
    bigrams = [unpack(b, "<i8", "<i8") for b in held.get(BIGRAMS, [])] or [[np.zeros(0, np.int64)] * 2]
    keys, counts = np.cumsum(bigrams[0][0]), bigrams[0][1]
    pairs = [unpack(b, "<u8", "<i8", "<i8") for b in held.get(PAIRS, [])] or [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2]]
    pair_keys, pair_counts, pair_words = np.cumsum(pairs[0][0], dtype=np.uint64), pairs[0][1], pairs[0][2]
    past = [unpack(b, "<u8", "<f8", "<f8") for b in held.get(RARE_HISTORIES, [])] or [[np.zeros(0, np.uint64), *[np.zeros(0)] * 2]]
    past_v, past_z, past_alpha = np.cumsum(past[0][0], dtype=np.uint64), past[0][1], past[0][2]
    for kind, chunk, blob in zip(asked["kind"].to_pylist(), asked["chunk"].to_pylist(), asked["blob"].to_pylist(), strict=True):
        if kind == HEAD:
            yield kind, chunk, blob
            continue
        extra: tuple[np.ndarray, ...] = ()
        if kind == ASK_BIGRAMS:
            k, doc = unpack(blob, "<i8", "<u2")
            k = np.cumsum(k)
            score = s.coded(*_split(k), _look_up(keys, counts, k))
        elif kind == ASK_WORDS:
            w, doc = unpack(blob, "<u8", "<u2")
            c = _look_up(h, n, np.cumsum(w, dtype=np.uint64))
            score = voc.log_p(c)
            extra = (c > 0, voc.base(c))
        else:
            v, w, doc = unpack(blob, "<u8", "<u8", "<u2")
            v = np.cumsum(v, dtype=np.uint64)
            at = np.minimum(np.searchsorted(pair_keys, k := pair_key(v, w)), max(len(pair_keys) - 1, 0))
            there = pair_keys[at] == k if len(pair_keys) else np.zeros(len(k), bool)
            coded = v < RARE
            log_z, log_alpha = np.zeros(len(v)), np.zeros(len(v))
            log_z[coded], log_alpha[coded] = s.log_z[v[coded].astype(np.int64)], s.log_alpha[v[coded].astype(np.int64)]
            if len(past_v):
                row = np.minimum(np.searchsorted(past_v, v[~coded]), len(past_v) - 1)
                known = past_v[row] == v[~coded]
                log_z[~coded], log_alpha[~coded] = np.where(known, past_z[row], 0.0), np.where(known, past_alpha[row], 0.0)
            rare = w >= RARE
            # A rare follower's own probability comes with its word; where the bigram is known it is taken back.
            follower = np.zeros(len(w))
            follower[~rare] = s.log_p[w[~rare].astype(np.int64)]
            score = log_alpha + follower
            if there.any():
                own = voc.log_p(pair_words[at[there]])
                score[there] = s.seen(pair_counts[at[there]]) - log_z[there] - np.where(rare[there], own, 0.0)
        docs, at = np.unique(doc, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(docs)) for x in (score, *extra)]
        yield kind, chunk, pack(docs, *sums)


def _finish(rows: pa.Table) -> pa.Table:
    """The documents of a chunk from its head and the answers."""
    kinds, blobs = rows["kind"].to_pylist(), rows["blob"].to_pylist()
    ids, null, sizes, known, base, score = unpack(blobs[kinds.index(HEAD)], "<i8", "u1", "<i8", "<i8", "<f8", "<f8")
    known, base, score = known.copy(), base.copy(), score.copy()
    for kind, blob in zip(kinds, blobs, strict=True):
        if kind == ASK_WORDS:
            docs, own, have, plain = unpack(blob, "<u2", "<f8", "<f8", "<f8")
            known[docs] += have.astype(np.int64)
            base[docs] += plain
            score[docs] += own
        elif kind != HEAD:
            docs, own = unpack(blob, "<u2", "<f8")
            score[docs] += own
    return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score for every row (doc_id, text)."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(_Sent(model))

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        first = TaskContext.get().partitionId() << 32
        for i, c in enumerate(chunks(it, s.vocabulary)):
            yield _batch(_ask(c, s, first + i), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), ("part", "kind", "chunk", "blob"))

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        cols = list(zip(*_answer(sent.value, held, asked), strict=True)) or [()] * 3
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()), "blob": pa.array(cols[2], pa.binary())})

    asked = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(ask, _ROW)
    answers = model.tables.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "kind int, chunk long, blob binary")
    return answers.groupBy("chunk").applyInArrow(_finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def train_and_score(documents: DataFrame, held_out: Callable[[Column], Column], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Train on the rows that are not held out, score all."""
    out = held_out(F.col("doc_id"))
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    model = train(rows.where(~F.coalesce(out, F.lit(False))), settings)
    scored = score(rows, model)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
