"""Chat formatting of reply trees.

Messages name the message that they reply to. Iterated self-joins that double
their reach (a parent, then its parent's parent, ...) give every leaf the depth
and the mean score of its path from the root, so the number of joins grows with
the logarithm of the longest path. Branches are ranked in each tree, and only
the chosen ones are spelled out, again by doubling, and formatted.

In the template a turn is ``<|turn|>role<|text|>text<|end|>`` and a line break.
Inside roles and texts every control string, of this or of other common
templates, is broken up with a backslash after its first character, and each
backslash is doubled; taking one backslash from each pair restores the text.

Edge cases: null roles and texts are empty strings. A reply to a message that
is not there is a root. Messages that reply to each other in a ring have no
root and are left out. Messages without a tree_id are one tree. Ties of branches
go to the longer one, then to the leaf with the smallest id. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CLOSE = END + "\n"
#: Control strings of this and of other templates; the first character stays in front of the backslash.
CONTROL = r"(<)(?=\||/?s>|</?SYS>>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(text, CONTROL, "$1$2\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def ranked_branches(messages: DataFrame) -> DataFrame:
    """A row for each leaf: tree_id, leaf, depth, score (mean of its path) and rank in its tree.

    ``messages``: tree_id, id, parent (null for a root) and score; ids are
    unique in their tree.
    """
    ids = messages.select("tree_id", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    base = messages.select("tree_id", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).join(ids, ["tree_id", "parent"], "left")
    replied = messages.where("parent IS NOT NULL").select("tree_id", F.col("parent").alias("id"), F.lit(True).alias("_replied")).distinct()
    base = base.join(replied, ["tree_id", "id"], "left")
    # up: the ancestor reached; depth and total count what lies between, this message included.
    now = base.select(
        "tree_id", "id", F.when(F.col("_known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"), F.col("_replied").isNull().alias("is_leaf")
    )
    now = materialize(now, "paths")
    # Only what hasn't come to its root yet goes on; nothing else is written again.
    going = now.where("up IS NOT NULL")
    # No path is longer than the table: what still goes on after so many doublings is a ring.
    for _ in range(messages.count().bit_length()):
        if going.isEmpty():
            break
        far = now.select("tree_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        step = going.join(far, ["tree_id", "up"])
        step = step.select("tree_id", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"), "is_leaf")
        step = materialize(step, "paths")
        now, going = now.where("up IS NULL").unionByName(step), step.where("up IS NOT NULL")
    leaves = now.where("up IS NULL AND is_leaf")
    mean = F.col("total") / F.col("depth")
    order = Window.partitionBy("tree_id").orderBy(mean.desc(), F.desc("depth"), "id")
    return leaves.select("tree_id", F.col("id").alias("leaf"), "depth", mean.alias("score"), F.row_number().over(order).alias("rank"))


def paths(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(tree_id, leaf, id, height)`` for every message on the way from each leaf (height 0) up to its root.

    ``leaves``: tree_id, leaf and depth, the number of messages on its way. The
    longest way says how many rounds there are. A round writes what it adds and
    nothing again.
    """
    longest = leaves.agg(F.max("depth")).first()[0] or 1
    rows = leaves.select("tree_id", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("height"))
    if longest == 1:
        return rows
    known = messages.select("tree_id", F.col("id").alias("up"), F.lit(True).alias("_k"))
    hop = materialize(messages.select("tree_id", "id", F.col("parent").alias("up")).join(known, ["tree_id", "up"]).select("tree_id", "id", "up"), "hops")
    step = 1
    while step < longest:
        further = rows.join(hop, ["tree_id", "id"]).select("tree_id", "leaf", F.col("up").alias("id"), (F.col("height") + step).alias("height"))
        rows = rows.unionByName(materialize(further, "paths"))
        if 2 * step < longest:
            twice = hop.join(hop.select("tree_id", F.col("id").alias("up"), F.col("up").alias("_up")), ["tree_id", "up"])
            hop = materialize(twice.select("tree_id", "id", F.col("_up").alias("up")), "hops", instead_of=hop)
        step *= 2
    drop(hop)  # every round is written by now
    return rows


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each conversation: tree_id, leaf, ``formatted`` and ``loss_spans``.

    ``turns``: tree_id, leaf, height, role, text. Spans are (start, size) in
    code points of ``formatted``, one for each assistant text.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    made = turns.select(
        "tree_id", "leaf", "height", (F.col("role") == "assistant").alias("_loss"), F.length(text).cast("long").alias("_size"),
        F.concat(F.lit(TURN), role, F.lit(TEXT)).alias("_head"), text.alias("_text"),
    )
    made = made.withColumn("_whole", F.concat("_head", "_text", F.lit(CLOSE)))
    order = Window.partitionBy("tree_id", "leaf").orderBy(F.desc("height"))
    before = F.coalesce(F.sum(F.length("_whole")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = made.withColumn("_start", before + F.length("_head"))
    turn = F.struct((-F.col("height")).alias("o"), "_whole", "_loss", "_start", "_size")
    out = made.groupBy("tree_id", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["_loss"]), lambda x: F.struct(x["_start"].alias("start"), x["_size"].alias("size")))
    return out.select("tree_id", "leaf", F.array_join(F.transform("t", lambda x: x["_whole"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of each tree as conversations; None takes all.

    ``messages``: tree_id, id, parent, score, role, text; further columns are
    not read. Messages whose tree_id is null are one tree. A message that comes
    more than once (the same tree and id) counts once: the first row by parent,
    score, role and text, nulls before others.
    """
    # A struct that holds a null is equal to another one, so no join loses a tree.
    tree = messages.groupBy(F.struct("tree_id").alias("tree_id"), "id").agg(F.min(F.struct("parent", "score", "role", "text")).alias("_m"))
    tree = materialize(tree.select("tree_id", "id", "_m.parent", "_m.score", "_m.role", "_m.text"), "messages")
    leaves = ranked_branches(tree)
    chosen = materialize(leaves if branches is None else leaves.where(F.col("rank") <= branches), "branches")
    turns = paths(tree, chosen).join(tree.select("tree_id", "id", "role", "text"), ["tree_id", "id"])
    out = format_turns(turns).join(chosen.select("tree_id", "leaf", "score", "rank"), ["tree_id", "leaf"])
    return out.withColumn("tree_id", F.col("tree_id.tree_id"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: x != "")
    one = lambda x: F.struct(
        unescape(F.substring_index(x, TEXT, 1)).alias("role"),
        unescape(F.substring(x, F.lit(len(TEXT) + 1) + F.length(F.substring_index(x, TEXT, 1)), F.length(x) - F.length(F.substring_index(x, TEXT, 1)) - len(TEXT) - len(CLOSE))).alias("text"),
    )
    return F.transform(parts, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int"))), ""))
