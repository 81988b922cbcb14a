"""Tables as rasters: long-form pixels, one row for each place of an image.

``pixels``: image_id long, y int, x int, v double; colour images have the
columns r, g, b instead of v, label maps have ``label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one float image: a row for each vector."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"))


def embedding_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as integers from 0 to 255; values from -0.75 to 0.75 are spread."""
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("v") + 0.75) / 1.5 * 256)))
    return embedding_image(spark, sf_dir).withColumn("v", v.cast("double"))


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label map over the same grid: label + 1 of each vector where its value is positive, else 0."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("l"), F.posexplode("embedding").alias("x", "v"))
    label = F.when(F.col("v") > 0, F.col("l") + 1).otherwise(0).cast("long")
    return e.select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"), label.alias("label"))


def embedding_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour image in [0, 1]: each three elements of a vector are one pixel; what the last one lacks counts as 0."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 3).cast("int") - 1)).alias("x"))
    channel = lambda k: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.coalesce(F.get("embedding", 3 * F.col("x") + k).cast("double"), F.lit(0.0)) + 0.75) / 1.5 * 256))) / 255.0
    return e.select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("y"), "x", *[channel(k).alias(c) for k, c in enumerate("rgb")])


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed on a 64 x 64 grid, with two label maps: the smallest and largest line number."""
    li = read(spark, sf_dir, "lineitem")
    place = [F.pmod("l_partkey", F.lit(64)).cast("int").alias("y"), F.pmod("l_suppkey", F.lit(64)).cast("int").alias("x")]
    return li.groupBy(*place).agg(
        F.sum("l_quantity").alias("v"), F.sum("l_tax").alias("w"), F.min("l_linenumber").cast("long").alias("label"), F.max("l_linenumber").cast("long").alias("other")
    ).withColumn("image_id", F.lit(0).cast("long"))


def full_part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with zeros where no item falls, so that the grid has no gaps."""
    grid = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"))
    p = grid.join(part_grid(spark, sf_dir).drop("image_id"), ["y", "x"], "left")
    return p.select(F.lit(0).cast("long").alias("image_id"), "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "w", "label", "other")])


def event_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events by hour of the month and user, 720 x 64; absent places are 0."""
    e = read(spark, sf_dir, "events")
    hour = (F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") % 720).cast("int")
    counts = e.groupBy(hour.alias("y"), F.pmod("user_id", F.lit(64)).cast("int").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    grid = spark.range(720 * 64).select((F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"))
    return grid.join(counts, ["y", "x"], "left").select(F.lit(0).cast("long").alias("image_id"), "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
