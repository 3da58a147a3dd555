"""Writers: indexes, runs, reports, postings, graphs. Text formats are one string column, which any Spark sink takes."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesela.config import AnalyzerConfig


def store_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def store_settings(spark: SparkSession, config: AnalyzerConfig, path: str, tables: list[str]) -> None:
    """The names of an index's tables, and the analyzer's settings beside them, so that queries are normalised as texts were."""
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/tables")
    spark.createDataFrame([(json.dumps(asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def store_index(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet for each table, those with a term_id sorted by it so that look-ups skip row groups, and the list of names."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        by = next((c for c in ("term_id", "term") if c in df.columns), None)
        (df.repartitionByRange(by).sortWithinPartitions(by) if by else df).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/tables")


def q0_lines(run: DataFrame, model: str) -> DataFrame:
    """query_id, doc_id, rank (from 0, by falling score; scores that differ behind nine places tie), line."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc("doc_id"))) - 1
    ranked = run.select("query_id", "doc_id", place.cast("long").alias("rank"), F.round("score", 6).alias("score"))
    line = F.format_string("%d Q0 %d %d %.6f %s", "query_id", "doc_id", "rank", "score", F.lit(model))
    return ranked.select("query_id", "doc_id", "rank", line.alias("line"))


def tab_lines(run: DataFrame) -> DataFrame:
    """value: query, rank (from 1), document and, where the run has one, score, tab-separated."""
    score = [F.desc("score")] if "score" in run.columns else []
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*score, F.asc("doc_id")))
    more = ["score"] if score else []
    return run.withColumn("rank", place).select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("query_id", "rank", "doc_id", *more))).alias("value"))


def term_lines(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy("term").select(F.concat_ws(" - ", "term", F.col("cf").cast("string"), F.col("df").cast("string")).alias("value"))


def id_name_lines(names: DataFrame) -> DataFrame:
    return names.select(F.concat_ws(" ", F.col("doc_id").cast("string"), "name").alias("value"))


def doc_terms(tf: DataFrame) -> DataFrame:
    """doc_id, terms: the different terms of each document as one string."""
    return tf.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("terms"))


def result_lines(matches: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, value: `Rank i: name`, from 1, by document."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("doc_id"))
    return matches.join(names, "doc_id").select("query_id", F.format_string("Rank %d: %s", place, "name").alias("value"))


def trec_lines(docs: DataFrame) -> DataFrame:
    """value: one DOC element for each document (doc_id, title, author, body)."""
    part = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{tag}>"), F.col(c), F.lit(f"</{tag}>\n"))).otherwise("")
    return docs.select(F.concat(F.lit("<DOC>\n<DOCNO>"), F.col("doc_id").cast("string"), F.lit("</DOCNO>\n"), part("TITLE", "title"), part("AUTHOR", "author"), part("TEXT", "body"), F.lit("</DOC>")).alias("value"))


def report_lines(row: DataFrame) -> DataFrame:
    """value: `name: value` for each column of a one-row report."""
    pairs = F.array(*(F.concat_ws(": ", F.lit(c), F.col(c).cast("string")) for c in row.columns))
    return row.select(F.explode(pairs).alias("value"))


def evaluation_lines(macro_stats: DataFrame, levels: DataFrame) -> DataFrame:
    """value: the totals, then the mean precision at each tenth of recall (level 0 to 10)."""
    at = levels.orderBy("level").select(F.format_string("Precision at %d%% : %.4f", F.col("level") * 10, "precision").alias("value"))
    return report_lines(macro_stats).unionByName(at)


def id_url_lines(nodes: DataFrame) -> DataFrame:
    """value: `id: url` of a graph's nodes (id, node)."""
    return nodes.select(F.concat_ws(": ", F.col("id").cast("string"), "node").alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("%d -> %d", "src", "dst").alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
