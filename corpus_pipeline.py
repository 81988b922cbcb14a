"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Rows, not ids, are judged by the stages that look at one text (1 and 4), so null
and repeated ids are nothing special there. Columns of any names stay as they
are. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgq.llm import decontam, lang_id, line_dedup, packing, simhash
from imgq.llm.common import materialize, quoted, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without any letter (null and
    empty texts too) and those that no language can parse go. Repeated rows fare alike."""
    return lang_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one with a smaller id has; n_chars follows.

    Documents that lose all lines go. Rows without an id lose nothing, rows that
    repeat an id are one document. Columns called like a result of line dedup
    stay as they are; ``n_chars`` may be absent.
    """
    apart = {c: c if c in ("doc_id", "text") else f"c{i}_{c}" for i, c in enumerate(docs.columns)}
    out = line_dedup.dedup_lines(docs.select(*[quoted(c).alias(x) for c, x in apart.items()]))
    taken = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.where("n_dropped = 0 OR kept <> ''").select(*[taken.get(c, quoted(x)).alias(c) for c, x in apart.items()])


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component.

    Rows that repeat that id all stay, and so do rows without an id.
    """
    return simhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; null texts have none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place there.

    Each row is packed by itself; ties between pieces go by bucket, id and piece.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]

#: Tokenisation, fingerprints and cross-parsing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
