"""Exact deduplication by a 128-bit content hash, with bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import checkpoint, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts group by md5 and, inside a group, by their bytes, so that a collision of the hash never merges two texts:
    each text is one class. Both keys are pre-aggregated on the map side, so that a group of copies with a third of
    all rows reaches the shuffle as one row for each task. The classes go back to the rows by 384 bits of digests,
    without the texts; two different texts behind one such key end the query with an error. Classes are cut in the shared
    folder before that, so that behind the last shuffle stands the join alone, and Spark's adaptive execution can split the
    rows of a hot class over tasks.

    Null text is empty text. Of repeated ids in one class all rows are the same document and share `kept`. A null id
    never stays unless all ids of the class are null, whose keep_id is null and kept false. Other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    digests = [F.md5("text").alias("h"), F.sha2("text", 256).alias("text_sha256")]
    by_bytes = rows.groupBy(F.md5("text").alias("h"), "text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = by_bytes.select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    sure = F.when(F.col("n") == 1, F.col("g")).otherwise(F.raise_error(F.lit("two texts share md5 and sha256")))
    one = classes.groupBy("h", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("g"))
    one = checkpoint(one.select("h", "text_sha256", "keep_id", sure.alias("group_size")))
    return (
        rows.select("doc_id", *digests)
        .join(one, ["h", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
