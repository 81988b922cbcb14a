import random

import numpy as np
from pyspark.sql import functions as F

from imgq.llm import decontam


def brute_align(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        item = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 12))])
        text = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 30))], dtype=np.int64)
        points, a, b = decontam.align(item, text)
        assert points == brute_align(item, text)
        if points:
            assert brute_align(item, text[a:b]) == points


def sentence(rng, n, prefix):
    return " ".join(rng.choice("the of and to a in".split()) if rng.random() < 0.4 else f"{prefix}{rng.randint(0, 3000)}" for _ in range(n))


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, sentence(rng, 30, "w")) for i in range(12)] + [(50, None), (51, ""), (52, "the of"), (53, "of the and to a in the of")]
    docs, want = [], set()
    for d in range(120):
        text = sentence(rng, 80, "w")
        if d % 10 == 0:
            i = d // 10
            w = items[i][1].split()
            if d % 20 == 0:  # edited
                for at in range(3, len(w), 9):
                    w[at] = "edited"
                del w[10]
            text = text[:200] + " " + " ".join(w).upper() + ". " + text[200:]
            want.add((d, i))
        docs.append((d, text, "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "a", "x"), (903, items[0][1], "x"), (903, items[0][1], "x")]
    want.add((903, 0))
    documents = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_WORDS, 100):
        got = decontam.leaks(documents, benchmark, block_words=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] < 50} == want
        assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    for r in got:
        if (r["doc_id"], r["item_id"]) == (903, 0):
            assert (r["start_word"], r["end_word"], r["score"]) == (0, 30, 1.0)
    kept = decontam.drop_contaminated(documents, benchmark.where("item_id < 50"))
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontam.leaks(documents.limit(0), benchmark).count() == 0
    assert decontam.leaks(documents, benchmark.limit(0)).count() == 0


def test_a_passage_in_most_documents_is_found(spark):
    rng = random.Random(3)
    item = sentence(rng, 30, "w")
    docs = [(d, sentence(rng, 40, "v") + " " + item) for d in range(80)] + [(100 + d, sentence(rng, 60, "u")) for d in range(20)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(80))


def test_rows_are_judged_by_themselves(spark):
    """Null and repeated ids, and columns called like helpers."""
    rng = random.Random(4)
    item = sentence(rng, 30, "w")
    rows = [(None, item, 1), (None, "clean text here", 2), (5, item, 3), (5, "another clean text", 4), (6, None, 5), (7, "", 6)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, `_bad` int").withColumn("a.b", F.lit(1))
    kept = decontam.drop_contaminated(documents, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == documents.columns
    assert sorted(r["_bad"] for r in kept.collect()) == [2, 4, 5, 6]


def test_seeds_are_the_rare_half_and_what_is_rare():
    block = decontam.Block([(1, "a b c d e f g"), (2, "a b c x")])
    number = block.numbers()
    gram = lambda t: tuple(block.vocab[w.encode()] for w in t.split())
    counts = {number[gram(t)]: n for t, n in {"a b c": 900, "b c d": 500, "c d e": 2, "d e f": 400, "e f g": 400, "b c x": 1}.items()}
    block.choose_seeds(counts, 10_000)
    assert {g for g in block.seeds} == {gram(t) for t in ("c d e", "d e f", "e f g", "b c x")}
