"""Toxicity by a weighted finite-state grammar of clauses.

Words are read as symbols (insult, threat, target, negation, reporting verb,
clause end, or a gap of other words). Small transducers rewrite that stream:
one marks what stands under a negation, one what is reported speech, one what
is aimed at a target. They are composed into one table, which is run over each
clause; what it puts out (a targeted insult, a negated threat, ...) is counted
for each document, and a logistic model weighs the counts.

The word lists are fixed; insults are added to them from labelled texts: words
that stand in toxic documents in many different contexts and hardly anywhere in
others. Contexts are counted, not documents, so the words of one text that was
copied often do not become insults.

Learning uses a sample of at most ``SAMPLE`` labelled rows of the training fold,
those with the smallest hashes of their ids; the model never sees language,
source or id.

Edge cases: null and empty texts match nothing and get the score of texts
without matches. Without any labelled row the score is 0. Rows that repeat a
``doc_id`` are scored each. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod

SAMPLE = 20_000
#: A learned insult: contexts in toxic texts at least, share of its toxic
#: documents that bring a context of their own, and odds against other texts.
MIN_CONTEXTS, MIN_VARIETY, MIN_ODDS = 8, 0.3, 15.0
#: Other words after which a negation no longer holds.
SCOPE = 4

# Words of the grammar in English, German, French and Spanish.
INSULTS = """idiot idiots moron morons stupid clown loser losers scum trash pathetic worthless disgusting imbecile dumb
idiotisch dumm dummkopf trottel abschaum ekelhaft wertlos crétin débile minable ordure pathétique stupide
imbécil estúpido basura escoria inútil asqueroso""".split()
THREATS = "kill hurt destroy murder strangle töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours yourself u they them he she du dich dir dein ihr euch sie tu te toi vous ton votre tú ti usted ustedes ellos".split()
NEGATIONS = "not no never n't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún sin".split()
REPORTS = "said says say wrote called calls claimed quoted reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()

GAP, STOP, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
INSULT_AIMED, INSULT_DENIED, INSULT_QUOTED, THREAT_AIMED, THREAT_DENIED, THREAT_QUOTED, AIMED_LATER = range(7, 14)
#: What is counted, in the order of the model's weights.
COUNTED = (INSULT, INSULT_AIMED, INSULT_DENIED, INSULT_QUOTED, THREAT, THREAT_AIMED, THREAT_DENIED, THREAT_QUOTED, AIMED_LATER)
N_SYMBOLS = 14

_ENDS = bytes(1 if chr(c) in ".!?;:\n" else 32 if c < 128 and not chr(c).isalnum() and c != 39 else c for c in range(256))


class Transducer:
    """A sequential transducer: ``step[state, symbol]`` to (state, symbol put out).

    A step that isn't named keeps the state and passes the symbol on.
    """

    def __init__(self, states: int, step: dict[tuple[int, int], tuple[int, int]]):
        self.states = states
        self.next = np.repeat(np.arange(states)[:, None], N_SYMBOLS, axis=1)
        self.out = np.repeat(np.arange(N_SYMBOLS)[None, :], states, axis=0)
        for (s, x), (t, y) in step.items():
            self.next[s, x], self.out[s, x] = t, y

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this puts out is what the other reads."""
        made = Transducer(self.states * other.states, {})
        for s, t, x in product(range(self.states), range(other.states), range(N_SYMBOLS)):
            y = self.out[s, x]
            made.next[s * other.states + t, x] = self.next[s, x] * other.states + other.next[t, y]
            made.out[s * other.states + t, x] = other.out[t, y]
        return made


def grammar() -> Transducer:
    """Negation, reported speech, then aim; state 0 is a clause's beginning."""
    negation = Transducer(2, {(0, NEGATION): (1, NEGATION), (1, GAP): (0, GAP), (1, STOP): (0, STOP), (1, INSULT): (1, INSULT_DENIED), (1, THREAT): (1, THREAT_DENIED)})
    report = Transducer(2, {(0, REPORT): (1, REPORT), (1, STOP): (0, STOP), (1, INSULT): (1, INSULT_QUOTED), (1, THREAT): (1, THREAT_QUOTED)})
    # 0 nothing, 1 target seen, 2 insult or threat seen that nothing was aimed at yet
    aim = Transducer(
        3,
        {
            (0, TARGET): (1, TARGET), (0, INSULT): (2, INSULT), (0, THREAT): (2, THREAT),
            (1, INSULT): (1, INSULT_AIMED), (1, THREAT): (1, THREAT_AIMED), (1, STOP): (0, STOP),
            (2, TARGET): (1, AIMED_LATER), (2, STOP): (0, STOP),
        },
    )
    return negation.then(report).then(aim)


class Grammar:
    """The composed grammar with its words; counts matches in texts."""

    def __init__(self, learned: tuple[str, ...] = ()):
        self.symbol: dict[bytes, int] = {b"\x01": STOP}
        for symbol, listed in ((INSULT, [*INSULTS, *learned]), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in listed:
                self.symbol.setdefault(w.encode(), symbol)
        t = grammar()
        self.next, self.out = t.next.tolist(), t.out.tolist()
        self.place = {x: i for i, x in enumerate(COUNTED)}

    def count(self, text: str | None) -> list[int]:
        """Matches by kind."""
        found = [0] * len(COUNTED)
        tokens = clauses(text)
        symbols = list(map(self.symbol.get, tokens))
        if INSULT not in symbols and THREAT not in symbols:
            return found
        state, skipped = 0, 0
        for x in symbols:
            if x is None:
                skipped += 1
                if skipped == SCOPE:
                    state = self.next[state][GAP]
                continue
            skipped = 0
            y = self.out[state][x]
            state = self.next[state][x]
            if y in self.place:
                found[self.place[y]] += 1
        return found


def clauses(text: str | None) -> list[bytes]:
    """Words in lower case, with a mark of its own (byte 1) at each clause's end."""
    return (text or "").lower().encode().translate(_ENDS).replace(b"\x01", b" \x01 ").split()


def sampled_labels(labels: DataFrame, fold: int, held_out: int, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, toxic)`` of the training fold: ``sample`` rows at most."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), fold) != held_out))
    rows = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("_toxic"))
    taken = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_toxic").limit(sample).collect()
    return labels.sparkSession.createDataFrame(taken, "doc_id long, _toxic int")


def learn_insults(labelled: DataFrame) -> tuple[str, ...]:
    """Words to add to the insults, from ``(text, _toxic)``."""

    def seen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: set[tuple[bytes, int]] = set()
        docs: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
        for batch in it:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = clauses(text)
                for w in set(tokens):
                    docs[w][toxic != 0] += 1
                if toxic:
                    padded = [b"", *tokens, b""]
                    contexts.update((w, hash_pair(a, b)) for a, w, b in zip(padded, tokens, padded[2:], strict=False))
        rows = [(w, None, n, p) for w, (n, p) in docs.items()] + [(w, c, 0, 0) for w, c in contexts]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["word", "context", "clean", "toxic"])

    rows = labelled.select("text", "_toxic").mapInArrow(seen, "word binary, context long, clean long, toxic long")
    per_word = rows.groupBy("word").agg(F.count_distinct("context").alias("contexts"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = (F.col("contexts") + 0.5) / (F.col("clean") + 0.5)
    per_word = per_word.where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("contexts") >= MIN_VARIETY * F.col("toxic")) & (odds >= MIN_ODDS))
    # As many words as the sample of at most ``SAMPLE`` rows teaches.
    best = per_word.where(F.col("word") != b"\x01").orderBy("word").select("word").collect()
    return tuple(bytes(r["word"]).decode(errors="replace") for r in best)


def hash_pair(a: bytes, b: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(a + b"\0" + b, 0) - (1 << 63)


def counted(documents: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``hits``, the matches by kind."""
    sent = documents.sparkSession.sparkContext.broadcast(grammar)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in it:
            hits = [g.count(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hits, pa.list_(pa.int32()))], names=[*keep, "hits"])

    fields = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select("text", *keep).mapInArrow(run, f"{fields}, hits array<int>")


class Model:
    """Logistic weights of the counted matches."""

    def __init__(self, grammar: Grammar, weights: np.ndarray | None):
        self.grammar, self.weights = grammar, weights

    def scores(self, hits: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(hits))
        z = self.weights[0] + features(hits) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(hits: np.ndarray) -> np.ndarray:
    """For each kind whether and how often it stands in the text, and whether any does."""
    some = (hits > 0).astype(float)
    return np.concatenate([some, np.log1p(hits), some.max(axis=1, keepdims=True)], axis=1)


def fit(hits: np.ndarray, clean: np.ndarray, toxic: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Newton steps for the logistic model over distinct rows with their counts."""
    x = np.concatenate([np.ones((len(hits), 1)), features(hits)], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    n = clean + toxic
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (toxic - n * p) - penalty * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(documents: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """Insults and weights from the labelled rows of the training fold."""
    chosen = sampled_labels(labels, fold, held_out, sample)
    # The sample has a fixed bound, so it can be sent along with the scan.
    labelled = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    g = Grammar(learn_insults(labelled))
    rows = counted(labelled, g, ["_toxic"]).groupBy("hits").agg(F.count_if(F.col("_toxic") == 0).alias("clean"), F.count_if(F.col("_toxic") != 0).alias("toxic")).collect()
    if not rows:
        return Model(g, None)
    return Model(g, fit(np.array([r["hits"] for r in rows]), np.array([r["clean"] for r in rows]), np.array([r["toxic"] for r in rows])))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, hits)`` for every row."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in it:
            hits = [m.grammar.count(t) for t in batch.column(1).to_pylist()]
            s = m.scores(np.array(hits, dtype=np.int64).reshape(-1, len(COUNTED)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "score", "hits"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, hits array<int>")
