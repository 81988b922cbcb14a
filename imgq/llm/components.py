"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _canonical(edges: DataFrame) -> DataFrame:
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pair.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b; long), root the smallest node reached.

    Every round hangs each node's larger, then its smaller neighbours on the
    smallest one it knows; the number of rounds grows with the logarithm of the
    longest path. A node's neighbours are only aggregated, never gathered.
    Rounds are written to the shared folder.
    """
    now = materialize(_canonical(edges), "edges")  # a > b
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = materialize(small.where("a <> b").distinct(), "edges", instead_of=now)
        # Done when every node hangs on one root and no root hangs on another.
        roots = new.select(F.col("b").alias("a")).distinct()
        settled = new.groupBy("a").count().where("count > 1").limit(1).count() == 0 and new.join(roots.hint("merge"), "a", "left_semi").limit(1).count() == 0
        now = new
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
