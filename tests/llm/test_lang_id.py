import numpy as np
from pyspark.sql import functions as F

from imgq.llm import lang_id

TEXT = {"aa": ["abcabcabd xyz"], "bb": ["zzz yxw ééa"]}


def brute_phrases(sample, text):
    """Greedy longest matches; a symbol that the sample lacks is a phrase's end."""
    n, cur = 1, ""
    for c in text:
        if cur + c in sample:
            cur += c
        else:
            n += 1
            cur = c if c in sample else ""
    return n


def test_automaton_knows_exactly_the_substrings():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 3, 60)
    table = lang_id.suffix_automaton(s, 3)
    joined = "".join(map(str, s))
    for _ in range(500):
        x = rng.integers(0, 3, rng.integers(1, 8))
        state = 0
        for c in x:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == ("".join(map(str, x)) in joined)


def test_phrases_against_brute_force():
    p = lang_id.CrossParser(TEXT)
    clean = lambda t: "".join(map(chr, lang_id._lower_letters(t)))
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcxyzwé 1.ñ"), rng.integers(1, 40))) for _ in range(100)] + [None, "", "123"]
    counts, letters = p.phrases(texts)
    for t, row, n in zip(texts, counts, letters, strict=True):
        t = t or ""
        assert n == sum(c.isalpha() for c in t)
        for j, lang in enumerate(p.langs):
            want = brute_phrases("".join(clean(x) for x in TEXT[lang]), clean(t)) if t else 0
            assert row[j] == want, (t, lang)


def test_windows_leave_no_trace(monkeypatch):
    p = lang_id.CrossParser(TEXT)
    whole = {lang: "".join("".join(map(chr, lang_id._lower_letters(x))) for x in TEXT[lang]) for lang in p.langs}
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcxyzwé ñ"), rng.integers(1, 300))) for _ in range(60)] + ["abcabcabd xyz" * 20, "abc" * 50, "", "ñ" * 64]
    monkeypatch.setattr(lang_id, "WINDOW", 16)
    counts, _ = p.phrases(texts)
    for t, row in zip(texts, counts, strict=True):
        clean = "".join(map(chr, lang_id._lower_letters(t)))
        assert row.tolist() == [brute_phrases(whole[lang], clean) if t else 0 for lang in p.langs]


def test_a_long_piece_of_the_sample_is_one_phrase():
    rng = np.random.default_rng(6)
    sample = "".join(rng.choice(list("abcdefgh"), 9000))
    p = lang_id.CrossParser({"aa": [sample], "bb": [sample[::-1]]})
    counts, _ = p.phrases([sample[1000:7000], sample])
    assert counts[:, 0].tolist() == [1, 1] and (counts[:, 1] > 500).all()


def test_what_no_language_can_parse_is_rejected(spark):
    rows = [(i, "the water of the green house and the little window in the morning " * 3, "en") for i in range(20)]
    odd = [(100, "жщцы фыва йцук", "ru"), (101, "the house", None), (102, "12 34", "en"), (103, None, "en")]
    docs = spark.createDataFrame([*rows, *[(i, t, None) for i, t, _ in odd]], "doc_id long, text string, `lang` string")
    kept = {r["doc_id"] for r in lang_id.keep_identified(docs.withColumn("a.b", F.lit(1))).collect()}
    assert kept == {*range(20), 101}


def test_held_out_accuracy_and_edges(documents, rows, no_documents):
    got = lang_id.identify(documents).collect()
    assert len(got) == len(rows)
    truth = {d: lang for d, _, lang, *_ in rows}
    clear = [r for r in got if r["doc_id"] < 60]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in clear) >= 0.98 * len(clear)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {60, 61, 62}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert lang_id.identify(no_documents).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = lang_id.keep_identified(documents)
    assert kept.columns == documents.columns and kept.count() == len(rows) - 3


def test_whole_texts_are_learnt(spark):
    """Few long texts with a common beginning teach as many symbols as there may be."""
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdefgh", "bb": "hijklmno"}
    head = "12 34 " * 200  # no letters in over 600 code points
    rows = [(d, head + "".join(rng.choice(list(letters[lang]), 5000)), lang) for d, lang in enumerate(["aa", "bb"] * 3)]
    rows += [(d + 10, "".join(rng.choice(list(letters["aa"]), 40)), "aa") for d in range(5)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    init = lang_id.CrossParser.__init__

    def spy(self, samples, max_symbols):
        seen.update(samples)
        init(self, samples, max_symbols)

    lang_id.CrossParser.__init__ = spy
    try:
        parser = lang_id.learn(documents)
        assert {lang: sum(map(len, x)) for lang, x in seen.items()} == {"aa": 3 * 5001 + 5 * 40, "bb": 3 * 5001}
        wanted = [(t, lang) for _, t, lang in rows if len(t) > 1000]
        phrases, _ = parser.phrases([t[-2000:] for t, _ in wanted])
        assert all(row[parser.langs.index(lang)] <= 2 for row, (_, lang) in zip(phrases, wanted, strict=True))
        lang_id.learn(documents, max_symbols=6000)
        assert all(6000 <= sum(map(len, x)) < 6000 + 5001 for x in seen.values())
        lang_id.learn(documents, sample_docs=2)
        assert all(len(x) == 2 for x in seen.values())
    finally:
        lang_id.CrossParser.__init__ = init


def test_marks_alone_are_no_letters(spark, documents):
    rows = [(500, "\u0301\u0301", None, "s", 2, 0.0), (501, "12 \u0308 %", None, "s", 6, 0.0), (502, "the water e\u0301", None, "s", 12, 0.0)]
    df = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.identify(df).where("doc_id >= 500").collect()}
    assert got[500] == got[501] == ("und", 0.0) and got[502][0] != "und"
