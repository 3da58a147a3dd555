"""The corpus pipeline: quality, lines, near duplicates, personal data, packing. Each stage works on what the one before kept."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import checkpoint, table
from tesela.llm.jaccard import jaccard_components
from tesela.llm.line_dedup import line_dedup
from tesela.llm.packing import pack
from tesela.llm.pii import redact
from tesela.llm.quality import keep_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling rejects go; the models are fitted on the documents that come in.

    Null and empty texts score 0, the score of a text that the models tell nothing about. Repeated rows have equal fates. Null ids
    have no label. Without labels of both kinds all rows stay. An empty table gives no rows."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document go, and documents that had text and have none left; n_chars follows the text.

    Null and empty texts and rows with a null id stay as they are. Repeated rows of one id lose nothing by each other. An empty
    table gives no rows. Columns of the input keep their names, whatever they are."""
    out = line_dedup(docs)
    gone = F.col("lines").isNotNull() & (F.trim(F.col("text")) == "")
    text = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.where(~gone).withColumns(text).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays; rows with a null id all stay.

    Null and empty texts are no one's duplicates and stay. Repeated rows of an id share its fate. An empty table gives no rows."""
    found = jaccard_components(docs, with_links=False)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised in the text; every document stays. n_chars follows the text. Null texts stay null, repeated rows
    and rows with a null id are treated like others. An empty table gives no rows."""
    out = redact(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their token ids.

    Null and empty texts are the end id alone; repeated rows and null ids are packed like others. Only doc_id and text are read. An
    empty table gives no rows."""
    import public_tokenizers

    path = os.environ.get("TESELA_WORD_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, path, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]
#: No stage but the last but one works by SQL functions alone, and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are cut in the shared folder, as the driver's runs cut them with Parquet."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
