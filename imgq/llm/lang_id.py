"""Language identification by cross-parsing entropy.

For each language one suffix automaton is built from a bounded sample of
labelled text. A document is cut greedily into the longest pieces that occur in
the sample of a language (Ziv-Merhav cross-parsing); the language that needs
the fewest phrases per letter wins. Whole texts are parsed: they are laid out in
windows of ``WINDOW`` symbols, which are walked side by side with numpy and then
stitched, so that the phrases are those of one walk from end to end.

Edge cases: a null text, an empty one or one without any letter (combining marks
alone are none) gets ``und`` and score 0. With no labelled row at all every document gets ``und``. Ties go
to the language that sorts first. Repeated rows are predicted alike, one row
for each input row. Further columns of the input do not matter.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc32_mod, quoted

#: The sample: this many documents of a language at most, with the smallest
#: hashes of their ids, and this many symbols of their whole texts at most.
SAMPLE_DOCS = 400
SAMPLE_SYMBOLS = 60_000
WINDOW = 2048
#: Breaks between phrases for each letter from which on a text is in no learned language.
MAX_BREAKS = 0.75
UNKNOWN = "und"


def suffix_automaton(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton: ``[state, symbol]`` to a state or -1.

    State 0 is the root. Blumer's online construction.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), n_symbols), -1, dtype=np.int32)
    for s, row in enumerate(nxt):
        if row:
            out[s, list(row)] = list(row.values())
    return out


def _lower_letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, everything but letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.unique(points)
    letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in kinds.tolist()], dtype=bool)
    points = np.where(letter[np.searchsorted(kinds, points)], points, 32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


class CrossParser:
    """The automata of all languages over one alphabet, stacked in one array."""

    def __init__(self, samples: dict[str, list[str]], max_symbols: int = SAMPLE_SYMBOLS):
        self.langs = sorted(samples)
        parts = {}
        for lang in self.langs:
            got, n = [], 0
            for text in samples[lang]:
                points = _lower_letters(text)[: max_symbols - n]
                got.append(points)
                n += len(points)
                if n >= max_symbols:
                    break
            parts[lang] = np.concatenate(got) if got else np.zeros(0, np.uint32)
        points = np.unique(np.concatenate([*parts.values(), np.array([32], np.uint32)]))
        #: Symbol 0 stands for letters that no sample has; it breaks any phrase.
        self.alphabet = points
        self.width = len(points) + 1
        tables, base, self.roots = [], 0, []
        for lang in self.langs:
            t = suffix_automaton(np.searchsorted(points, parts[lang]) + 1, self.width)
            # A missing step ends the phrase; the next one begins with this
            # symbol. It is kept as the negative of (target + 1).
            t = np.where(t >= 0, t + base, -(np.where(t[0] >= 0, t[0], 0) + base) - 1)
            self.roots.append(base)
            base += len(t)
            tables.append(t.astype(np.int32))
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and letters by text."""
        n, k = len(texts), len(self.langs)
        lowered = [(t or "").lower() for t in texts]
        sizes = np.array([len(t) for t in lowered], dtype=np.int64)
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(n), sizes)
        ascii_map = np.zeros(0x250, dtype=np.int16)
        ascii_letter = np.zeros(0x250, dtype=bool)
        for c in range(0x250):
            if unicodedata.category(chr(c))[0] in "LM":
                ascii_letter[c] = True
                j = int(np.searchsorted(self.alphabet, c))
                known = j < len(self.alphabet) and self.alphabet[j] == c
                ascii_map[c] = j + 1 if known else 0
            else:
                ascii_map[c] = int(np.searchsorted(self.alphabet, 32)) + 1
        low = points < 0x250
        index = np.where(low, points, 0)
        sym, letter = ascii_map[index], ascii_letter[index]
        if not low.all():
            high = points[~low]
            kinds, inverse = np.unique(high, return_inverse=True)
            is_letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in kinds.tolist()])
            j = np.minimum(np.searchsorted(self.alphabet, kinds), len(self.alphabet) - 1)
            code = np.where(self.alphabet[j] == kinds, j + 1, 0)
            space = int(np.searchsorted(self.alphabet, 32)) + 1
            sym[~low] = np.where(is_letter, code, space)[inverse]
            letter[~low] = is_letter[inverse]
        proper = letter.copy()  # marks go with letters, but a text of marks alone has no letter
        if not low.all():
            proper[~low] = np.array([unicodedata.category(chr(c))[0] == "L" for c in kinds.tolist()])[inverse]
        letters = np.bincount(owner, weights=letter, minlength=n).astype(np.int64)
        letters[np.bincount(owner, weights=proper, minlength=n) == 0] = 0
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
        sym, owner = sym[keep], owner[keep]
        return self._parse(sym, np.bincount(owner, minlength=n)), letters

    def _parse(self, sym: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Phrases by text and language; ``sym`` holds the texts' symbols one after the other.

        All windows are walked side by side, each as if a phrase began with it.
        A window is then walked again with the state that the one before ends
        in, until both walks break at one symbol: from there on they are the
        same. That is repeated while ends change, so windows leave no trace.
        """
        n, k = len(counts), len(self.langs)
        windows = -(-counts // WINDOW)
        m = int(windows.sum())
        out = np.zeros((n, k), dtype=np.int64)
        if not m or not k:
            return out
        w_owner = np.repeat(np.arange(n), windows)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        w_index = np.arange(m) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
        start = first[w_owner] + w_index * WINDOW
        size = np.minimum(WINDOW, counts[w_owner] - w_index * WINDOW)
        order = np.argsort(-size, kind="stable")  # those still running stay in front
        lane = np.empty(m, dtype=np.int64)  # where a window runs
        lane[order] = np.arange(m)
        start, size = start[order], size[order]
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], m, axis=1)
        later = w_index[order] > 0
        breaks = np.zeros((k, m), dtype=np.int64)
        breaks[:, ~later] = 1  # a text's first phrase
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        broken = []  # by step, of windows that aren't their texts' only ones
        kept = np.flatnonzero(np.isin(w_owner[order], np.flatnonzero(windows > 1)))
        for step in range(int(size[0])):
            a = int(live[step])
            nxt = self.table[state[:, :a] * self.width + sym[start[:a] + step]]
            broke = nxt < 0
            state[:, :a] = np.where(broke, -nxt - 1, nxt)
            if not step:
                broke |= later
            breaks[:, :a] += broke
            if len(kept):
                broken.append(broke[:, kept[: np.searchsorted(kept, a)]])
        # Pairs of windows that follow each other in a text, as lanes.
        after = np.flatnonzero(w_index > 0)
        this, before = lane[after], lane[after - 1]
        row = np.full(m, -1, dtype=np.int64)
        row[kept] = np.arange(len(kept))
        entered = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], m, axis=1)
        fresh = np.ones((k, m), dtype=bool)  # whether a phrase was taken to begin with the window
        while True:
            j, i = np.nonzero(fresh[:, this] | (entered[:, this] != state[:, before]))
            if not len(j):
                break
            at, s = this[i], state[j, before[i]].copy()
            fresh[j, at], entered[j, at] = False, s
            gained = np.zeros(len(j), dtype=np.int64)
            for step in range(WINDOW):
                nxt = self.table[s * self.width + sym[start[at] + step]]
                broke = nxt < 0
                s = np.where(broke, -nxt - 1, nxt)
                old = broken[step][j, row[at]]
                broken[step][j, row[at]] = broke
                gained += broke.astype(np.int64) - old
                ends = size[at] == step + 1
                done = (broke & old) | ends
                if done.any():
                    breaks[j[done], at[done]] += gained[done]
                    state[j[ends], at[ends]] = s[ends]
                    j, at, s, gained = j[~done], at[~done], s[~done], gained[~done]
                    if not len(j):
                        break
        for x in range(k):
            out[:, x] = np.bincount(w_owner[order], weights=breaks[x], minlength=n)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and how many breaks between phrases the language needs for a letter."""
        phrases, letters = self.phrases(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf)
        per_letter = phrases / np.maximum(letters, 1)[:, None]
        best = per_letter.argmin(axis=1)
        # Posterior under codes of equal cost for each phrase: 2^-(extra bits),
        # tempered so that long texts do not all read 1.
        gap = per_letter - per_letter.min(axis=1, keepdims=True)
        share = np.exp2(-gap * np.minimum(letters, 400)[:, None])
        score = 1 / share.sum(axis=1)
        ok = letters > 0
        breaks = (phrases.min(axis=1) - 1) / np.maximum(letters, 1)
        return [self.langs[b] if y else UNKNOWN for b, y in zip(best.tolist(), ok.tolist(), strict=True)], np.where(ok, score, 0.0), np.where(ok, breaks, np.inf)


def learn(documents: DataFrame, train: Column | None = None, sample_docs: int = SAMPLE_DOCS, max_symbols: int = SAMPLE_SYMBOLS) -> CrossParser:
    """Fit on whole texts of each language, in the order of their ids' hashes.

    Texts are taken until ``max_symbols`` symbols or ``sample_docs`` documents
    are met, so that each language with enough text teaches the same number of
    symbols. Only the text at which the symbols are met is cut there.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    if train is not None:
        rows = rows.where(train)
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # One row for each language, as the parser has an automaton for each.
    sizes = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_least"))
    # The part of the hashes' range that holds twice the sample and more, so
    # that no task ranks a language's rows; the smallest hash is always in it.
    part = F.greatest((2 * sample_docs + 200) / F.col("_n"), F.col("_least") / 2.0**64 + 0.5)
    near = hashed.join(F.broadcast(sizes), "lang").where(F.col("_h") / 2.0**64 + 0.5 <= part)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample_docs)
    # At most sample_docs ids for each language: small enough to send along.
    ids = ids.groupBy("doc_id", "lang").agg(F.min("_rank").alias("_rank"))
    taken = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])

    def symbols(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            points = [_lower_letters(t)[:max_symbols] for t in batch.column(2).to_pylist()]
            sizes = pa.array([len(x) for x in points], pa.int64())
            blobs = pa.array([x.tobytes() for x in points], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, blobs], names=["lang", "_rank", "_size", "_symbols"])

    cut = taken.select("lang", "_rank", "text").mapInArrow(symbols, "lang string, _rank int, _size long, _symbols binary")
    order = Window.partitionBy("lang").orderBy("_rank", "_symbols")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.select("lang", "_symbols", before.alias("_before"), F.row_number().over(order).alias("_rank"))
    samples: dict[str, list[tuple[int, str]]] = {}
    # Less than twice max_symbols for each language.
    for r in cut.where((F.col("_before") < max_symbols) & (F.col("_rank") <= sample_docs)).collect():
        samples.setdefault(r["lang"], []).append((r["_rank"], bytes(r["_symbols"]).decode("utf-32-le", "surrogatepass")))
    return CrossParser({lang: [t for _, t in sorted(v)] for lang, v in samples.items()}, max_symbols)


#: Texts that are parsed together, in code points times languages at most.
BATCH_POINTS = 6_000_000


def predict(documents: DataFrame, parser: CrossParser) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``breaks``; every row stays, and so do columns of any names besides these."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(parser)
    names = documents.columns
    added = ["lang_pred", "score", "breaks"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        most = BATCH_POINTS // max(len(p.langs), 1)
        for batch in it:
            texts = batch.column(names.index("text")).to_pylist()
            langs: list[str] = []
            numbers: list[np.ndarray] = [np.zeros((2, 0))]
            at = 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and (to == at or n + len(texts[to] or "") <= most):
                    n += len(texts[to] or "")
                    to += 1
                got, s, rate = p.predict(texts[at:to])
                langs += got
                numbers.append(np.stack([s, rate]))
                at = to
            s, rate = np.concatenate(numbers, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(s), pa.array(rate)], names=[*names, *added])

    clash = [c for c in added if c in names]
    if clash:
        raise ValueError(f"the input already has {clash}")
    schema = StructType([*documents.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("breaks", DoubleType())])
    return documents.mapInArrow(batches, schema)


def identify(documents: DataFrame, fold: int = 4, held_out: int = 2) -> DataFrame:
    """Predict the language of every document, learning from the training fold."""
    parser = learn(documents, crc32_mod(F.col("doc_id"), fold) != held_out)
    rows = documents.select("doc_id", "text")
    return predict(rows, parser).select("doc_id", (crc32_mod(F.col("doc_id"), fold) == held_out).alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, max_breaks: float = MAX_BREAKS) -> DataFrame:
    """The documents that are in one of the learned languages, with their own columns.

    Rejected are texts without a letter and texts that even the language that
    fits best cannot parse: over ``max_breaks`` breaks between phrases for each
    letter, as of random letters or of scripts that no language has.
    """
    parser = learn(documents, crc32_mod(F.col("doc_id"), 4) != 2)
    names = documents.columns
    inner = documents.select([quoted(c).alias(f"c{i}" if c != "text" else "text") for i, c in enumerate(names)])
    out = predict(inner, parser).where((F.col("lang_pred") != UNKNOWN) & (F.col("breaks") <= max_breaks))
    return out.select([F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])


assert sys.byteorder == "little"
