from pyspark.sql import functions as F
import random

import numpy as np

from imgq.llm import cuckoo, line_dedup


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def made(seed=5, n=40):
    rng = random.Random(seed)
    pool = ["A long shared line", " a LONG shared line\t", "short", "", "one more repeated line é", "ÉCLAIR et ÉTÉ", "éclair et été"] + [f"own line number {i}" for i in range(30)]
    return [(i, None if i == 7 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(n)]


def cleaned(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cleaned(line_dedup.dedup_lines(df)) == brute(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_insert_and_delete_are_exact(spark):
    rows = made(6)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    store = line_dedup.LineStore(spark, shards=3)
    store.insert(frame(rows[:15]))
    store.insert(frame(rows[10:]))  # five of them again
    assert cleaned(store.clean(frame(rows))) == brute(rows)
    store.delete(frame(rows[:20]).select("doc_id"))
    assert cleaned(store.clean(frame(rows[20:]))) == brute(rows[20:])
    store.insert(frame(rows[:20]))
    assert cleaned(store.clean(frame(rows))) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "the same long line"), (1, "the same long line\nother"), (1, "the same long line"), (2, "THE same long line ")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in got) == [("1", 0), ("1", 0), ("2", 1), ("None", 0)]


def test_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    f = cuckoo.build(h)
    assert f.contains(h).all()
    f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(rng.integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all()
    assert f.contains(h[:2500]).mean() < 0.05
    assert cuckoo.build(h[:0]).contains(h).sum() == 0


def test_columns_called_like_helpers(spark):
    rows = [(1, "a repeated line\nown", 1, 2, 3), (2, "a repeated line", 4, 5, 6), (None, "a repeated line", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_lines` int, kept int, `a.b` int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_lines", "a.b", "n_lines", "n_dropped", "kept"]
    assert sorted((r["_lines"], r["a.b"], r["kept"]) for r in got.collect()) == [(1, 3, "a repeated line\nown"), (4, 6, ""), (7, 9, "a repeated line")]


def test_filters_that_fill_up_are_built_anew(spark):
    store = line_dedup.LineStore(spark, shards=2)
    text = lambda a, b: "\n".join(f"line number {i:06d}" for i in range(a, b))
    docs = [spark.createDataFrame([(2 * k, text(0, 40 * 4**k)), (2 * k + 1, text(0, 40 * 4**k))], "doc_id long, text string") for k in range(4)]
    for d in docs:
        store.insert(d)
    assert store.filters.where(F.length("filter") == 0).count() == 0 and store.filters.count() == 2
    lost = {r["doc_id"]: len(r["keys"]) for r in store.repeated(docs[3]).collect()}
    assert lost == {6: 40 * 4**3 - (40 * 4**3 - 40 * 4**2), 7: 40 * 4**3}
    store.delete(docs[0])
    assert store.refs.where("first_doc < 2").count() == 0
