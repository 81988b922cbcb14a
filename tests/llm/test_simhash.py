import random
from itertools import combinations

from xxhash import xxh64_intdigest

from imgq.llm import components, simhash
from imgq.llm.common import materialize


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents_against_brute_force(documents, rows, no_documents):
    got = simhash.components(documents).collect()
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    assert sorted((r["doc_id"], r["fp"]) for r in got) == sorted((d, signed(f)) for d, f in fps)
    edges = [(a, b) for (a, f), (b, g) in combinations(fps, 2) if (f ^ g).bit_count() <= 4]
    want = brute_roots({d for d, _ in fps}, edges)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash.components(no_documents).count() == 0
    kept = simhash.dedup(documents)
    assert kept.columns == documents.columns
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted(set(want.values()))


def test_crowds_and_chains(spark):
    rng = random.Random(3)
    fps = {0}
    for _ in range(4):  # crowds around a few centres
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(30):  # a chain
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    edges = [(i, j) for (i, f), (j, g) in combinations(enumerate(fps), 2) if (f ^ g).bit_count() <= 4]
    want = brute_roots(range(len(fps)), edges)
    nodes = materialize(spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, rep long"), "nodes")
    for small in (1, 64, 1000):
        found = simhash.links(nodes, 4, small)
        pairs = {(r["a"], r["b"]) for r in found.collect()}
        near = {frozenset(e) for e in edges}
        assert all(frozenset(p) in near for p in pairs)
        roots = {r["node"]: r["root"] for r in components.connected_components(found).collect()}
        assert {i: roots.get(i, i) for i in range(len(fps))} == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (5, 5)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200}
    assert got.count() == 104


def test_hex(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(-1,), (0,), (255,)], "fp long").select(simhash.as_hex(F.col("fp")).alias("h"))
    assert [r["h"] for r in got.collect()] == ["f" * 16, "0" * 16, "0" * 14 + "ff"]
