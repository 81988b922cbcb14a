r"""Groups of spelling variants: words that one edit parts, hung on the more frequent one.

Words that begin alike lie together in sorted order, words that end alike lie
together in the order of their reversals. An edit of a word at a place leaves
what stands before and behind it, so its near words by that edit are the points
of a rectangle: forward ranks of the prefix by backward ranks of the suffix. A
wavelet tree (laid out level by level) over the backward ranks in forward order
reports the points of many rectangles at once.

One index of all words would be one task. A word and its near words agree on all
but a short stretch around the edit, so words are dealt by what stands outside
of a stretch: first either half, and where more than ``GROUP`` words agree on
the rest, the halves of that stretch, and so on. Each place of each word is in
just one stretch, and an inserted letter counts at the first place of its run,
so every pair is found once.

Edge cases: null and empty texts have no words; a null ``doc_id`` counts as an
empty string; rows that repeat an id and a text count again. Ties between near
words go to the smallest in code-point order. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST = 7
LEAST = 2
#: A form has at least so many times the occurrences of its variant.
FACTOR = 10
#: Words that are indexed together at most, and on average; stretches of one place have fewer by the alphabet.
GROUP = 1 << 13
#: Rectangles that are looked up at once.
_BATCH = 1 << 13


def damaged_words(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``(word)`` for each run of letters in each text: A-Z lower-cased, one letter lost where the CRC of id and word says so."""
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.expr(rf"regexp_extract_all(text, r'{LETTERS}{{{shortest},}}', 0)")).alias("w"))
    low = runs.select("d", F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"))
    h = low.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    lost = F.expr("concat(substring(w, 1, cast(h % length(w) AS int)), substring(w, cast(h % length(w) AS int) + 2))")
    return h.select(F.when(F.col("h") % 31 == 0, lost).otherwise(F.col("w")).alias("word")).where(F.length("word") >= shortest)


def count_words(words: DataFrame, least: int = LEAST) -> DataFrame:
    """``(word, n)`` of the words with at least ``least`` occurrences; counted map-side first."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


#: What stands outside of the stretch [a, b) of a word of ``size`` letters; a longer word has one letter more inside.
_KEY = "xxhash64(size, a, b, substring(word, 1, a), substring(word, b + 1 + cast(longer AS int)))"


def _stretches(words: DataFrame, group: int) -> DataFrame:
    """``(word, n, size, longer, a, b, key)``: all words that agree on a key are one group, of ``group`` rows at most where it can be split.

    ``size`` is the length of the shorter word of a pair, so each word comes as
    the shorter one of its own length and the longer one of the length before.
    """
    roles = words.withColumn("role", F.explode(F.array(F.struct(F.length("word").alias("size"), F.lit(False).alias("longer")), F.struct((F.length("word") - 1).alias("size"), F.lit(True).alias("longer")))))
    whole = roles.select("word", "n", "role.size", "role.longer", F.lit(0).alias("a"), (F.col("role.size") + 1).alias("b"))
    halves = lambda df: df.withColumn("half", F.explode(F.expr("array(struct(a AS a, (a + b) div 2 AS b), struct((a + b) div 2 AS a, b AS b))"))).select(
        "word", "n", "size", "longer", F.col("half.a").cast("int").alias("a"), F.col("half.b").cast("int").alias("b")
    ).withColumn("key", F.expr(_KEY))
    now, ready = materialize(halves(whole), "stretches"), []
    while True:
        # Only few keys are large: at most the rows over the size of a group.
        large = materialize(now.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("b") - F.col("a")).alias("span")).where((F.col("rows") > group) & (F.col("span") > 1)).select("key"), "large")
        if large.isEmpty():
            break
        ready.append(materialize(now.join(large.hint("merge"), "key", "left_anti").select(now.columns), "stretches"))
        now = materialize(halves(now.join(large.hint("merge"), "key", "left_semi")), "stretches", instead_of=now)
        drop(large)
    for part in ready:
        now = now.unionByName(part)
    return now


class WaveletTree:
    """A permutation whose points in rectangles can be reported."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.below, self.zeros = [], []  # zeros before each place, and zeros in all, level by level
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            self.below.append(np.concatenate([[0], np.cumsum(1 - ones)]))
            self.zeros.append(int(self.below[-1][-1]))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (rectangle, value) with the place of the value in [x0, x1) and the value in [y0, y1)."""
        q = np.flatnonzero((x1 > x0) & (y1 > y0))
        lo, hi, base = x0[q], x1[q], np.zeros(len(q), dtype=np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            below, zeros = self.below[level], self.zeros[level]
            low, high = below[lo], below[hi]
            q, base = np.concatenate([q, q]), np.concatenate([base, base + (1 << bit)])
            lo, hi = np.concatenate([low, zeros + lo - low]), np.concatenate([high, zeros + hi - high])
            meets = (hi > lo) & (base < y1[q]) & (base + (1 << bit) > y0[q])
            q, lo, hi, base = q[meets], lo[meets], hi[meets], base[meets]
        return q, base


class _Order:
    """Words in sorted order, with the interval of those that share their first k letters with each."""

    def __init__(self, letters: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
        self.rank = np.empty(len(letters), dtype=np.int64)
        self.rank[self.order] = np.arange(len(letters))
        s = letters[self.order]
        differs = s[1:] != s[:-1]
        self.shared = np.where(differs.any(axis=1), differs.argmax(axis=1), letters.shape[1])

    def intervals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the ranks [from, to) of the words with the same first ``k`` letters."""
        edges = np.concatenate([[0], np.flatnonzero(self.shared < k) + 1, [len(self.order)]])
        which = np.searchsorted(edges, self.rank, side="right") - 1
        return edges[which], edges[which + 1]


class _Side:
    """The words of one length among those of an index: their tree, and ranks among all turned into ranks among them."""

    def __init__(self, member: np.ndarray, forward: _Order, backward: _Order):
        self.forward = np.concatenate([[0], np.cumsum(member[forward.order])])
        self.backward = np.concatenate([[0], np.cumsum(member[backward.order])])
        mine = forward.order[member[forward.order]]
        self.tree = WaveletTree(self.backward[backward.rank[mine]])
        self.by_value = backward.order[member[backward.order]]

    def near(self, asks: np.ndarray, before: tuple, behind: tuple, alone: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word that asks, word found), where more than ``alone`` words share either side."""
        x0, x1, y0, y1 = self.forward[before[0][asks]], self.forward[before[1][asks]], self.backward[behind[0][asks]], self.backward[behind[1][asks]]
        worth = np.flatnonzero((x1 - x0 > alone) & (y1 - y0 > alone))
        for at in range(0, len(worth), _BATCH):
            w = worth[at : at + _BATCH]
            q, value = self.tree.report(x0[w], x1[w], y0[w], y1[w])
            yield asks[w[q]], self.by_value[value]


def near_in_stretch(words: list[str], n: np.ndarray, longer: np.ndarray, size: int, a: int, b: int) -> tuple[list[str], list[int], list[int], list[str]]:
    """The columns word, n_near, best_n, best of the words with near ones by an edit in [a, b)."""
    raw = [w.encode("latin-1") for w in words]
    pad = lambda rows: np.frombuffer(b"".join(r.ljust(size + 1, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), size + 1)
    letters = pad(raw)
    forward, backward = _Order(letters), _Order(pad([r[::-1] for r in raw]))
    shorts = np.flatnonzero(~longer)
    same, more = _Side(~longer, forward, backward), _Side(longer, forward, backward)
    better = np.lexsort((forward.rank, -n))  # the best word first
    place = np.empty(len(words), dtype=np.int64)
    place[better] = np.arange(len(words))
    count, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words))

    def add(word: np.ndarray, other: np.ndarray) -> None:
        np.add.at(count, word, 1)
        np.minimum.at(best, word, place[other])

    for i in range(a, b):
        before = forward.intervals(i)
        if i < size:
            for word, other in same.near(shorts, before, backward.intervals(size - i - 1), 1):
                add(word[word != other], other[word != other])
        for word, other in more.near(shorts, before, backward.intervals(size - i), 0):
            first = np.ones(len(other), dtype=bool) if i == 0 else letters[other, i - 1] != letters[other, i]
            add(word[first], other[first])
            add(other[first], word[first])
    has = np.flatnonzero(count)
    top = better[best[has]]
    return [words[k] for k in has], count[has].tolist(), n[top].tolist(), [words[k] for k in top]


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``(word, n_near, best_n, best)``: for each word with near words their number, and the most frequent one."""
    rows = _stretches(words, group)
    buckets = rows.count() // group + 1

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, ...] = ([], [], [], [])
        for k, g in pdf.groupby(["size", "a", "b"]):
            if len(g) > 1 and not g["longer"].all():
                for column, values in zip(out, near_in_stretch(g["word"].tolist(), g["n"].to_numpy(), g["longer"].to_numpy(), *map(int, k)), strict=True):
                    column.extend(values)
        return pd.DataFrame({c: pd.Series(v, dtype=kind) for c, v, kind in zip(("word", "n_near", "best_n", "best"), out, ("object", "int64", "int64", "object"), strict=True)})

    # Groups of one bucket share an index for each stretch: words that meet there at a place agree on the key anyway.
    found = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInPandas(index, "word string, n_near long, best_n long, best string")
    top = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return top.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def variant_groups(words: DataFrame, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each row ``(word, n)`` of distinct words.

    A word's form is its most frequent near word, if that has ``factor`` times
    its occurrences; the root is the last of the forms from it on. Each form has
    more occurrences than the word before it, so chains end, after as many steps
    as the counts have digits.
    """
    words = materialize(words, "words")
    near = words.join(near_words(words, group).hint("merge"), "word", "left")
    strong = F.col("best_n") >= factor * F.col("n")
    named = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    ways = materialize(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = ways.join(on.hint("merge"), F.col("root") == F.col("at"), "left")
        new = materialize(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways", instead_of=ways)
        ways, moved = new, new.where("moved").limit(1).count()
        if not moved:
            break
    return named.join(ways.select("word", F.col("root").alias("last")).hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("last", "word").alias("root"))
