import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from imgq.llm import minmax
from imgq.llm.common import table

from .conftest import SCHEMA
from .test_simhash import brute_roots


def brute_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_classes(rows):
    """Sets and smallest reachable ids of (doc_id, text); rows that repeat an id are told apart."""
    sets = [brute_set(t) for _, t in rows]
    edges = [(i, j) for (i, x), (j, y) in combinations(enumerate(sets), 2) if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    root = brute_roots(range(len(rows)), edges)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root[i]] = min(d, low.get(root[i], d))
    return sorted(((d if d is not None else -1), len(s), low.get(root[i], -1) if s else (d if d is not None else -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in minmax.components(df).collect())


def test_documents_against_brute_force(documents, rows, no_documents):
    assert found(documents) == brute_classes([(r[0], r[1]) for r in rows])
    assert minmax.components(no_documents).count() == 0
    kept = minmax.dedup(documents)
    assert kept.columns == documents.columns


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_crowds_stars_chains_and_null_ids(spark):
    rng = random.Random(5)
    out, n = [], iter(range(10**6))
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    crowd = [edited(rng, base, rng.choice([0, 1, 1, 2, 3])) for _ in range(120)]  # copies of a text link with it, few with each other
    out += [(1000 - next(n), t, None, None, None, None) for t in crowd]
    chain = [f"c{k}" for k in range(100)]
    for k in range(40):  # each text has the words of the one before it but for the first two
        out.append((next(n), " ".join(chain[2 * k :] + [f"d{j}" for j in range(2 * k)]), None, None, None, None))
    shared = [f"s{k}" for k in range(60)]
    out += [(next(n), " ".join(shared + [f"o{next(n)}" for _ in range(rng.choice([8, 12, 30]))]), None, None, None, None) for _ in range(40)]  # a passage in common, not similar enough
    out += [(None, crowd[0], None, None, None, None), (None, "nobody else has this", None, None, None, None), (None, None, None, None, None, None)]
    out += [(5000, t, None, None, None, None) for t in ("a b", "A  B", "a b c d e", "a b c d e f g", "", " \t", "a b c d e f g")]
    df = spark.createDataFrame(out, SCHEMA).repartition(5)
    assert found(df) == brute_classes([(r[0], r[1]) for r in out])


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert found(table(spark, sf, "documents")) == brute_classes(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors, few = [], []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = x[:110], x[20:]
        same = minmax.signature(a) == minmax.signature(b)
        errors.append(same.mean() - 90 / 120)
        few.append(same[: minmax.PERMUTATIONS].mean() - 90 / 120)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.std(few)
    assert len(minmax.signature(a)) == 2 * minmax.PERMUTATIONS


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "k"), (2, "a b c", 8, "k"), (None, "x", 9, "k")], "doc_id long, text string, n int, _gone string")
    assert minmax.components(df).select(F.count("*")).first()[0] == 3
    assert sorted(r["n"] for r in minmax.dedup(df).collect()) == [7, 9]
