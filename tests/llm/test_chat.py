import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from imgq.llm import chat

SCHEMA = "tree_id long, id long, parent long, score double, role string, text string"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<>|/s[]INST\\SYturnedx\n é", max_size=30), min_size=50, max_size=80))
def test_escape_round_trip(spark, texts):
    texts = [*texts, "<|turn|>", "<<s>", "<</SYS>>", "\\<|", "\\", "[[INST]", "</s>[INST] ok [/INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(x in r["e"] for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def brute(rows):
    """Best path of each tree as (tree, [(role, text)])."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        best = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at, seen = [], leaf, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(own[at])
                at = own[at][2]
            if at in seen:
                continue
            best.append((-sum(r[3] or 0 for r in path) / len(path), -len(path), leaf, [(r[4] or "", r[5] or "") for r in reversed(path)]))
        if best:
            out[tree] = min(best)[3]
    return out


def test_trees_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for tree in range(8):
        for i in range(rng.randint(1, 25)):
            parent = rng.randint(0, i - 1) if i and rng.random() < 0.95 else None
            rows.append((tree, i, parent, float(rng.randint(0, 3)), rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "<|end|>", "a\nb"])))
    rows += [(90, i, i - 1 if i else None, 1.0, "assistant", f"t{i}") for i in range(70)]  # a long chain
    rows += [(91, 1, 2, 1.0, "user", "ring"), (91, 2, 1, 1.0, "user", "ring"), (92, 5, 4, 1.0, "user", "orphan")]
    made = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = made.select("tree_id", chat.read_turns(F.col("formatted")).alias("t"), "formatted", "loss_spans", chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    want = brute(rows)
    assert {r["tree_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in got} == want
    for r in got:
        assert r["m"] == "".join(t["text"] for t in r["t"] if t["role"] == "assistant")
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    every = chat.format_chats(spark.createDataFrame(rows, SCHEMA), branches=None)
    assert every.count() >= len(want)


def test_messages_without_a_tree_are_one_tree(spark):
    rows = [(None, 1, None, 1.0, "user", "hi"), (None, 2, 1, 1.0, "assistant", "yo"), (4, 1, None, 1.0, "user", None)]
    got = {r["tree_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(0))).collect()}
    assert set(got) == {None, 4} and got[None]["formatted"].count(chat.TURN) == 2 and len(got[None]["loss_spans"]) == 1


def test_repeated_messages_count_once(spark):
    rows = [(1, 1, None, 1.0, "user", "hi")] * 2 + [(1, 2, 1, 1.0, "assistant", "yes"), (1, 2, 1, 1.0, "assistant", "no"), (None, 1, None, 1.0, "user", "alone")]
    df = spark.createDataFrame(rows, "tree_id long, id long, parent long, score double, role string, text string")
    got = chat.format_chats(df).select("tree_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r["tree_id"]: [(x["role"], x["text"]) for x in r["t"]] for r in got} == {1: [("user", "hi"), ("assistant", "no")], None: [("user", "alone")]}
    assert len(got) == 2
