"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a session of one process (master ``local``) that names none gets a
    temporary folder of its machine; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='imgq-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a copy that outlives any executor. ``instead_of`` is
    a table made here before that nothing will read again: its files go once
    the new ones are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if instead_of is not None:
        drop(instead_of)
    return out


def drop(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` has made."""
    jvm, path = table.sparkSession._jvm, getattr(table, "written_path", None)
    if path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


class Names:
    """Helper columns that no column of the input is called like.

    >>> n = Names(documents); documents.withColumn(n.lines, ...)
    """

    def __init__(self, *tables: DataFrame):
        self._taken = {c.lower() for t in tables for c in t.columns}

    def __getattr__(self, name: str) -> str:
        out = f"_{name}"
        while out.lower() in self._taken:
            out = f"_{out}"
        return out


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]
