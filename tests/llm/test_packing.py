import random
import zlib

import numpy as np
import pytest

from imgq.llm import packing
from imgq.llm.tokens import coder, vocabulary


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", "a", " a", "a ", "Hello, world.\nNext line", "two  spaces", "tab\there", "a\n\nb", "x \ny", "é à, ça.", "it's <|endoftext|> ok", "nb\xa0sp", "\n", "a,b;c", "१२३ ½", "😀 ok", "w x", "end.\n"],
)
def test_remembered_words_give_the_tokenizer_s_ids(text):
    assert np.frombuffer(coder(vocabulary()).encode(text), dtype="<u4").tolist() == plain_ids(text)


def test_ids_of_random_texts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abé ,.\n\t'’%  ") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(coder(vocabulary()).encode(text), dtype="<u4").tolist() == plain_ids(text)


def test_plan_uses_every_length_once_and_packs_well():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(30)}
        used, bins = {}, 0
        for bin_, times in packing.best_two_fit(histogram, 64):
            assert sum(x * n for x, n in bin_.items()) <= 64
            bins += times
            for x, n in bin_.items():
                used[x] = used.get(x, 0) + n * times
        assert used == histogram
        assert bins <= 1.25 * sum(x * n for x, n in histogram.items()) / 64 + 1


def test_two_replace_the_smallest():
    # Greedy: 6 + 3 leaves 1; 3 gives way to 2 + 2.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)


def test_pack(documents, rows, no_documents):
    got = packing.pack(documents, 64, keep_ids=True).collect()
    want = sorted((d, len(plain_ids(t or "")) + 1) for d, t, *_ in rows)
    total = {}
    for r in got:
        assert r["length"] <= 64 and r["ids_crc32"] == zlib.crc32(r["ids"])
    by_row = {}
    for r in got:
        by_row.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in rows:
        if d != 71:
            ids = b"".join(bytes(r["ids"]) for r in sorted(by_row[d], key=lambda r: r["piece"]))
            assert np.frombuffer(ids, "<u4").tolist() == [*plain_ids(t or ""), 0]
    for d, n in want:
        total[d] = total.get(d, 0) + n
    assert {d: sum(r["length"] for r in v) for d, v in by_row.items()} == total
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(seqs) <= 1.02 * sum(total.values()) / 64 + 1
    assert packing.pack(no_documents, 64).count() == 0


def test_sequences(documents):
    packed = packing.pack(documents, 64, keep_ids=True)
    made = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in made) == 4 * sum(r["length"] for r in packed.collect())


def test_special_tokens_are_as_in_the_plain_call():
    from tokenizers import Tokenizer

    special = [t.content for t in Tokenizer.from_file(vocabulary()).get_added_tokens_decoder().values()]
    for text in [f"a {x} b" for x in special] + [f"one{x}two\nthree" for x in special]:
        assert np.frombuffer(coder(vocabulary()).encode(text), dtype="<u4").tolist() == plain_ids(text)


def test_place_keeps_columns_like_its_helpers(spark):
    rows = [(1, 0, 0, 5, 7, "a", 1.0), (None, 0, 0, 5, 8, "b", 2.0), (1, 0, 0, 5, 7, "a", 1.0)]
    made = packing.place(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, _bucket string, _rank double"), 16)
    assert sorted((r["_bucket"], r["_rank"]) for r in made.collect()) == [("a", 1.0), ("a", 1.0), ("b", 2.0)]
    assert sorted(r["offset"] for r in made.collect()) == [0, 5, 10]
