import random

import numpy as np

from imgq.llm import toxicity as t


def kinds(text):
    found = t.Grammar().count(text)
    return {k: n for k, n in zip(t.COUNTED, found, strict=True) if n}


def test_clauses():
    assert kinds("what an idiot") == {t.INSULT: 1}
    assert kinds("You idiot! It rains.") == {t.INSULT_AIMED: 1}
    assert kinds("idiot, that is what you are") == {t.INSULT: 1, t.AIMED_LATER: 1}
    assert kinds("you are not an idiot") == {t.INSULT_DENIED: 1}
    assert kinds("not one two three four five idiot") == {t.INSULT: 1}  # beyond the negation's scope
    assert kinds("he said idiot. idiot") == {t.INSULT_QUOTED: 1, t.INSULT: 1}
    assert kinds("you. idiot") == {t.INSULT: 1}  # a clause's end
    assert kinds("I will kill you") == {t.THREAT: 1, t.AIMED_LATER: 1}
    assert kinds("never hurt") == {t.THREAT_DENIED: 1}
    assert kinds("idiot " * 9) == {t.INSULT: 9}  # every match counts
    assert kinds("") == kinds(None) == kinds("clean text") == {}


def test_composition_is_the_cascade():
    rng = random.Random(1)
    parts = [t.Transducer(2, {(0, 2): (1, 7), (1, 0): (0, 0), (1, 7): (0, 3)}), t.Transducer(3, {(0, 7): (2, 4), (2, 3): (1, 5), (1, 1): (0, 9)})]
    made = parts[0].then(parts[1])
    a = b = c = 0
    for _ in range(500):
        x = rng.randrange(t.N_SYMBOLS)
        y = parts[0].out[a, x]
        a, want = parts[0].next[a, x], parts[1].out[b, y]
        b = parts[1].next[b, y]
        assert made.out[c, x] == want
        c = made.next[c, x]
        assert c == a * 3 + b


def test_learns_words_and_separates(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for d in range(600):
        w = [f"w{rng.randint(0, 80)}" for _ in range(40)]
        toxic = d % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(40), rng.choice(["gribblesnark", "idiot"]))
        docs.append((d, " ".join(w), "x"))
        labels.append((d, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (None, "idiot", "x")]
    labels += [(900, None), (None, 1)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.learn(documents, table)
    assert b"gribblesnark" in model.grammar.symbol
    got = {r["doc_id"]: r["score"] for r in t.score(documents, model).collect()}
    assert len(got) == len(docs)
    assert all((got[d] >= 0.5) == bool(y) for d, y in labels if d is not None and y is not None)
    assert got[900] == got[901] < 0.5 and all(0 <= s <= 1 for s in got.values())
    nothing = t.learn(documents, table.limit(0))
    assert {r["score"] for r in t.score(documents, nothing).collect()} == {0.0}
    assert t.score(documents.limit(0), model).count() == 0


def test_words_of_copies_are_not_learned(spark):
    rng = random.Random(3)
    copy = " ".join(f"copied{i}" for i in range(30))
    rows = [(copy, 1)] * 200 + [(" ".join(f"w{rng.randint(0, 80)}" for _ in range(30)), 0) for _ in range(200)]
    assert t.learn_insults(spark.createDataFrame(rows, "text string, _toxic int")) == ()


def test_fit():
    hits = np.zeros((2, len(t.COUNTED)), dtype=int)
    hits[1, 0] = 2
    m = t.Model(t.Grammar(), t.fit(hits, np.array([90, 1]), np.array([10, 99])))
    s = m.scores(hits)
    assert abs(s[0] - 0.1) < 0.02 and s[1] > 0.95
