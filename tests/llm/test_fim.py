import hashlib
import re

import pytest
from pyspark.sql import functions as F

from imgq.llm import fim


def brute_units(text, together):
    """Code points joined with the unit before them where ``together`` says so."""
    out = []
    for c in text:
        if out and together(out[-1][-1], c):
            out[-1] += c
        else:
            out.append(c)
    return out


RULES = {
    "characters": lambda a, b: False,
    "words": lambda a, b: b.isspace() or not a.isspace(),
    "lines": lambda a, b: a != "\n",
    "code": lambda a, b: (a.isalnum() or a == "_") and (b.isalnum() or b == "_") or a in " \t" and b in " \t",
}
TEXTS = ["", "a", "ab  cd\n\nef", "x=f(y_1)\n\treturn é9", "\U0001f986\U0001f986 a\U0001f986", "\r\n", "  lead", "end\n", "a<P>b", "<", "<S", "<M><S"]


@pytest.mark.parametrize("grammar", RULES)
def test_units_against_a_loop(spark, grammar):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", fim.units(F.col("t"), grammar).alias("u")).collect():
        assert row["u"] == brute_units(row["t"], RULES[grammar]), row["t"]


def test_graphemes_keep_marks_and_joined_pictures(spark):
    text = "éx\r\n\U0001f468‍\U0001f469"
    got = spark.createDataFrame([(text,)], "t string").select(fim.units(F.col("t"), "graphemes").alias("u")).first()["u"]
    assert got == ["é", "x", "\r\n", "\U0001f468‍\U0001f469"]


def brute(doc_id, text, rule):
    text = text or ""
    units = brute_units(text, rule)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not units or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("grammar", ["characters", "words"])
def test_rows_against_brute_force_and_back(spark, documents, rows, grammar):
    more = [(1000 + i, t, None, "s", 0, 0.0) for i, t in enumerate(TEXTS * 8)] + [(None, "no id", None, None, 0, 0.0)] * 2
    df = documents.unionByName(spark.createDataFrame(more, documents.schema))
    made = fim.fill_in_middle(df, grammar)
    back = made.select("doc_id", "text", F.col("_fim.*"), fim.restore(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    want = sorted(((r[0] is None, r[0] or 0, *brute(r[0], r[1], RULES[grammar])) for r in rows + more), key=repr)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["form"], r["prefix"], r["middle"], r["output"]) for r in back), key=repr) == want
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_clashing_columns_and_no_rows(spark, no_documents):
    df = spark.createDataFrame([(1, "abc", "mine", 5, "x")], "doc_id long, text string, _fim string, _units int, form string")
    made = fim.fill_in_middle(df)
    assert made.columns == [*df.columns, "__fim"]
    row = made.first()
    assert (row["_fim"], row["_units"], row["form"], row["__fim"]["n"]) == ("mine", 5, "x", 3)
    assert fim.fill_in_middle(no_documents).count() == 0


def test_query_is_plain_spark(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    plan = fim.fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
