import math
import zlib
from collections import Counter, defaultdict

import pytest

from imgq.llm import katz
from imgq.llm.common import crc32_mod


class Brute:
    """The same model over dictionaries."""

    def __init__(self, texts):
        t = [[w.encode().lower() for w in (x or "").split()] + [b"</>"] for x in texts]
        self.c = Counter(w for x in t for w in x)
        self.n = sum(self.c.values())
        d1 = katz.Discounts([sum(k == r for k in self.c.values()) for r in range(1, katz.K + 2)])
        self.p = {w: float(d1.discounted([k])[0]) / self.n for w, k in self.c.items()}
        self.unseen = 1 - sum(self.p.values())
        pairs = Counter()
        for x in t:
            pairs.update(zip(["begin", *x], x, strict=False))
        self.d2 = katz.Discounts([sum(k == r for k in pairs.values()) for r in range(1, katz.K + 2)])
        self.follow = defaultdict(dict)
        for (v, w), k in pairs.items():
            self.follow[v][w] = k

    def prob(self, w, v):
        own = self.p.get(w, self.unseen)
        if v not in self.follow:
            return own
        follow = self.follow[v]
        kept = sum(float(self.d2.discounted([k])[0]) for k in follow.values())
        z = sum(follow.values())
        if kept > z - 1e-9:
            z += 1
        if w in follow:
            return float(self.d2.discounted([follow[w]])[0]) / z
        return (1 - kept / z) / (1 - sum(self.p[x] for x in follow)) * own

    def score(self, text):
        out, v = 0.0, "begin"
        for w in [*(x.encode().lower() for x in (text or "").split()), b"</>"]:
            out += math.log10(self.prob(w, v))
            v = w
        return out


# Few codes and small parts send most bigrams by hash and over several parts.
@pytest.mark.parametrize("settings", [katz.Settings(), katz.Settings(share=16, part_tokens=400, chunk_tokens=300)])
def test_against_brute_force_and_adds_up(spark, documents, rows, settings):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    brute = Brute([t for d, t, *_ in rows if not held[d]])
    for v in ["begin", *list(brute.follow)[:40], "never"]:
        if v != b"</>":
            assert math.isclose(sum(brute.prob(w, v) for w in [*brute.c, None]), 1, rel_tol=1e-9)
    got = katz.train_and_score(documents, lambda d: crc32_mod(d, 7) == 2, settings).collect()
    want = sorted((d, brute.score(t), t) for d, t, *_ in rows)
    for r, (d, s, t) in zip(sorted(got, key=lambda r: (r["doc_id"], r["score"])), want, strict=True):
        assert r["doc_id"] == d and math.isclose(r["score"], s, rel_tol=1e-8), (d, r["score"], s)
        words = [*(x.encode().lower() for x in (t or "").split()), b"</>"]
        assert (r["held_out"], r["train_tokens"], r["n_tokens"]) == (held[d], brute.n, len(words))
        assert r["n_known"] == sum(w in brute.c for w in words)
        assert math.isclose(r["base_score"], sum(math.log10((brute.c[w] + 1) / (brute.n + len(brute.c) + 1)) for w in words), rel_tol=1e-9)


def test_good_turing_and_histories_without_small_counts(spark):
    """Counts of counts that allow Good-Turing, a history whose followers are all frequent, and null ids."""
    texts = [f"w{i} w{i}" for i in range(400)] + ["x y"] * 30 + [f"u{i % 90} q" for i in range(180)] + [f"t{i % 40} r" for i in range(120)] + [f"s{i % 12} p" for i in range(48)]
    texts += [f"o{i % 6} n" for i in range(30)] + [f"l{i % 3} k" for i in range(18)]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(9000, "x z new y")]
    brute = Brute(texts)
    assert brute.d2.d is not None and brute.follow[b"x"] == {b"y": 30}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = katz.train_and_score(docs, lambda d: d == 9000, katz.Settings(share=32, part_tokens=100, chunk_tokens=200)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert math.isclose(r["score"], brute.score(text), rel_tol=1e-9), text


def test_no_rows(spark, no_documents):
    assert katz.train_and_score(no_documents, lambda d: crc32_mod(d, 7) == 2).count() == 0
    only = spark.createDataFrame([(2, "a b a")], "doc_id long, text string")
    [r] = katz.train_and_score(only, lambda d: d == 2).collect()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"], r["score"]) == (0, 0, 4, 0.0, 0.0)
