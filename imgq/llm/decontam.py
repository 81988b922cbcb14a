"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of the benchmark's items are counted over the corpus, in documents.
Seeds of an item are its n-grams that at most one document in ``COMMON`` has, and
in any case the rarer half of its n-grams: what is common is judged by item, so a
passage that leaked into most documents is still found. A document that shares a
seed with an item is aligned with it, word by word, around the place where the
seed stands in both. The alignment lets words be replaced, dropped and added, and
its score as a share of the item's own decides.

The seeds of at most ``BLOCK_WORDS`` words of items are sent to all tasks and
joined there, in passes over the corpus if the benchmark is larger.

Edge cases: null or empty texts match nothing. Items shorter than the n-gram
are one n-gram themselves. Rows that repeat a ``doc_id`` or ``item_id`` are
matched each on its own; ``leaks`` returns the best row for each pair of ids (a
null doc_id is one of these), ``drop_contaminated`` judges each row by its own
text and keeps all columns, whatever their names. An empty table on either side
gives no pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NGRAM = 3
#: An n-gram is rare that at most one document in so many has.
COMMON = 1000
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: An aligned run of so many points is a leak even of a longer item.
MIN_POINTS = 40
BLOCK_WORDS = 1_000_000

_PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))

PAIRS = "doc_id long, item_id long, start_word long, end_word long, n_seeds long, points long, score double"


def words(text: str | None) -> list[bytes]:
    """Words in lower case; ASCII marks separate them, other characters do not."""
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: points, and first and end position in ``text``."""
    n = len(text)
    best, best_at = 0, (0, 0)
    row = np.zeros(n + 1, dtype=np.int64)
    came = np.arange(n + 1)  # where the alignment that ends here began
    steps = np.arange(n + 1) * GAP
    where = np.arange(n + 1)
    for w in item.tolist():
        diagonal = np.zeros(n + 1, dtype=np.int64)
        diagonal[1:] = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        origin = where.copy()
        origin[1:] = came[:-1]
        up = row + GAP
        take = up > diagonal
        here, origin = np.where(take, up, diagonal), np.where(take, came, origin)
        fresh = here <= 0
        here, origin = np.where(fresh, 0, here), np.where(fresh, where, origin)
        # A gap in the item: the best of all cells to the left, each step costing GAP.
        lifted = here - steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, where, 0))
        row, came = np.maximum(top + steps, 0), origin[source]
        came = np.where(row > 0, came, where)
        j = int(row.argmax())
        if row[j] > best:
            best, best_at = int(row[j]), (int(came[j]), j)
    return best, *best_at


class Block:
    """A bounded part of the benchmark, with its words numbered."""

    def __init__(self, rows: list[tuple[int, str]], ngram: int = NGRAM):
        self.ngram = ngram
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in rows:
            w = words(text)
            if w:
                self.items.append((item_id, np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], dtype=np.int64)))
        self._index([(tuple(ids[i : i + (n := min(ngram, len(ids)))].tolist()), k, i) for k, (_, ids) in enumerate(self.items) for i in range(len(ids) - min(ngram, len(ids)) + 1)])

    def _index(self, grams: list[tuple[tuple[int, ...], int, int]]) -> None:
        """The n-grams to look for: (n-gram, item, place in the item)."""
        self.grams = grams
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for g, k, i in grams:
            self.seeds[g].append((k, i))
        self.sizes = sorted({len(g) for g in self.seeds})
        self.codes = {n: np.unique([self._code(g) for g in self.seeds if len(g) == n]) for n in self.sizes}

    def choose_seeds(self, counts: dict[int, int], documents: int) -> None:
        """Keep the rare n-grams, by the documents that have them (``counts`` by place in ``numbers``)."""
        number = self.numbers()
        own = defaultdict(list)
        for g, k, i in self.grams:
            own[k].append((counts.get(number[g], 0), g, i))
        kept = []
        for k, found in own.items():
            half = sorted(n for n, _, _ in found)[(len(found) - 1) // 2]
            kept += [(g, k, i) for n, g, i in found if n <= max(half, documents / COMMON)]
        self._index(kept)

    def numbers(self) -> dict[tuple[int, ...], int]:
        return {g: j for j, g in enumerate(sorted(self.seeds))}

    def _code(self, gram: tuple[int, ...]) -> int:
        out = 0
        for x in gram:
            out = (out * (len(self.vocab) + 1) + x + 1) % (1 << 62)
        return out

    def ids(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.vocab.get, w, repeat(-1)), dtype=np.int64, count=len(w))

    def places(self, ids: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Where in the text which of the n-grams stand."""
        width = len(self.vocab) + 1
        for n in self.sizes:
            if len(ids) < n:
                continue
            code, known = np.zeros(len(ids) - n + 1, dtype=np.int64), np.ones(len(ids) - n + 1, dtype=bool)
            for k in range(n):
                part = ids[k : k + len(code)]
                code = (code * width + part + 1) % (1 << 62)
                known &= part >= 0
            at = np.flatnonzero(known)
            if not len(at):
                continue
            codes = self.codes[n]
            found = codes[np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)] == code[at]
            for j in at[found].tolist():
                gram = tuple(ids[j : j + n].tolist())
                if gram in self.seeds:
                    yield j, gram

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Places (in the text, in the item) of shared seeds, by item."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for j, gram in self.places(ids):
            for k, i in self.seeds[gram]:
                out[k].append((j, i))
        return out

    def match(self, text: str | None, memory: dict) -> Iterator[tuple]:
        """``(item_id, start, end, seeds, points, score)`` for each item that has a seed here."""
        ids = self.ids(text)
        for k, places in self.hits(ids).items():
            item_id, item = self.items[k]
            slack = max(5, len(item) // 2)
            spans: list[list[int]] = []
            for j, i in sorted(places, key=lambda p: p[0] - p[1]):
                a, b = max(0, j - i - slack), min(len(ids), j - i + len(item) + slack)
                if spans and a <= spans[-1][0] + slack:
                    spans[-1][1] = max(spans[-1][1], b)
                    spans[-1][2] += 1
                else:
                    spans.append([a, b, 1])
            best = (0, 0, 0, 0)
            for a, b, n in spans:
                window = ids[a:b]
                key = (k, window.tobytes())
                if key not in memory:
                    if len(memory) > 20_000:
                        memory.clear()
                    memory[key] = align(item, window)
                points, first, end = memory[key]
                best = max(best, (points, -(a + first), a + end, n))
            points, first, end, n = best
            yield item_id, -first, end, n, points, points / (MATCH * len(item))


def _is_leak(points: int, score: float, min_score: float) -> bool:
    return score >= min_score or points >= MIN_POINTS


def _blocks(documents: DataFrame, benchmark: DataFrame, block_words: int) -> Iterator[Broadcast]:
    """The benchmark in blocks of bounded size with their seeds chosen, sent to all tasks."""
    spark = documents.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_words))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = Block([(r["item_id"], r["text"]) for r in part])
        sent = spark.sparkContext.broadcast(block)

        def count(it: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            number = b.numbers()
            seen, total = np.zeros(len(number), dtype=np.int64), 0
            for batch in it:
                total += batch.num_rows
                for text in batch.column(0).to_pylist():
                    own = {number[g] for _, g in b.places(b.ids(text))}
                    seen[list(own)] += 1
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], names=["gram", "n"])

        rows = documents.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        counts = {r["gram"]: r["n"] for r in rows}  # as many as the block has words, at most
        block.choose_seeds(counts, counts.pop(-1, 0))
        yield spark.sparkContext.broadcast(block)


def leaks(documents: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of a document and a benchmark item that it has a copy of, exact or edited.

    ``start_word`` and ``end_word`` bound the aligned words of the document.
    """
    texts = documents.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    out = None
    for sent in _blocks(documents, benchmark, block_words):

        def match(it: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            b, memory = sent.value, {}
            for batch in it:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item_id, start, end, n, points, score in b.match(text, memory):
                        if _is_leak(points, score, min_score):
                            out.append((doc_id, item_id, start, end, n, points, score))
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], names=["doc_id", "item_id", "start_word", "end_word", "n_seeds", "points", "score"])

        found = texts.mapInArrow(match, PAIRS)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("start_word", "end_word", "n_seeds", "points", "score"), F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows whose text has no copy of any item; columns as given."""
    names = documents.columns
    at, out = names.index("text"), documents.toDF(*[f"c{i}" for i in range(len(names))])
    for sent in _blocks(documents, benchmark, block_words):

        def clean(it: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            b, memory = sent.value, {}
            for batch in it:
                keep = [not any(_is_leak(points, score, min_score) for *_, points, score in b.match(text, memory)) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, out.schema)
    return out.toDF(*names)
