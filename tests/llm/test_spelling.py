import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from imgq.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_groups(words):
    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(found[w]), form[w], words.get(form[w]), root))
    return out


def variants(rng, base, letters="abcé"):
    w = list(base)
    for _ in range(rng.randint(0, 3)):
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        if kind == 0:
            w.insert(at, rng.choice(letters))
        elif at < len(w):
            w[at : at + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(w)


def some_words(seed, k=220):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 12))) for _ in range(6)] + ["aaaaaaaa", "z" * 40]
    return {v: rng.choice([1, 2, 3, 20, 30, 400, 5000]) for v in (variants(rng, rng.choice(bases)) for _ in range(k)) if len(v) >= 6}


@pytest.mark.parametrize("group", [3, 40, 1 << 13])
def test_groups_against_brute_force(spark, group):
    words = some_words(group)
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), group=group)
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect()} == brute_groups(words)


def test_words_against_brute_force(spark, documents, rows, no_documents):
    more = [(None, "Straßenbahn STRASSENBAHN x2Éternité_éternité", None, None, 0, 0.0)] * 2 + [(900 + i, "unglaublich wonderful y" + "q" * 3000, "en", "s", 0, 0.0) for i in range(80)]
    df = documents.unionByName(spark.createDataFrame(more, documents.schema))
    got = {r["word"]: r["n"] for r in spelling.count_words(spelling.damaged_words(df)).collect()}
    want = brute_words([(r[0], r[1]) for r in rows + more])
    assert got == want and len(want) > 100
    assert spelling.variant_groups(spelling.count_words(spelling.damaged_words(no_documents))).count() == 0


def test_query_against_brute_force(spark, documents, rows):
    words = spelling.count_words(spelling.damaged_words(documents))
    got = {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variant_groups(words).collect()}
    assert got == brute_groups(brute_words([(r[0], r[1]) for r in rows]))


@settings(max_examples=60, deadline=None)
@given(st.permutations(list(range(21))), st.lists(st.tuples(*[st.integers(0, 21)] * 4), min_size=1, max_size=8))
def test_wavelet_tree_reports_rectangles(values, boxes):
    tree = spelling.WaveletTree(np.array(values))
    q, v = tree.report(*np.array(boxes).T)
    want = [(k, values[x]) for k, (x0, x1, y0, y1) in enumerate(boxes) for x in range(x0, x1) if y0 <= values[x] < y1]
    assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted(want)
