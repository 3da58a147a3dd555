"""Readers: corpora, topics, vectors, runs, judgments, postings, reports and stored indexes."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.config import AnalyzerConfig


def corpus_from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def corpus_from_directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """doc_id (from 1 in the order of the paths), name, text of whole files. A missing path is an AnalysisException."""
    from tesela.operators.index import ranked

    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return ranked(named, "doc_id", F.asc("name")).select("doc_id", "name", "text")


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def directory_listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, name, length, modified of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", file_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"))


def lines(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def between_markers(text, start: str, end: str):
    """The text behind the first start marker and before the next end marker; without a marker, to that side's end."""
    at = F.locate(start, text)
    tail = F.when(at > 0, F.substring(text, at + len(start), F.length(text))).otherwise(text)
    stop = F.locate(end, tail)
    return F.when(stop > 0, F.substring(tail, F.lit(1), stop - 1)).otherwise(tail)


def stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The words of a stop-word file, which is small; an empty path means none. They are normalised where they are used."""
    if not path:
        return ()
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w")).where("w <> ''").distinct()
    return tuple(r.w for r in words.orderBy("w").collect())


def topics(spark: SparkSession, path: str) -> DataFrame:
    """query_id, title of TOP / NUM / TITLE blocks; tags in any case; what stands outside of tags is passed over."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<top>(.*?)</top>"), F.lit(1))).alias("b"))
    part = lambda tag: F.trim(F.regexp_extract("b", rf"(?is)<{tag}>\s*(.*?)\s*(?:</{tag}>|<|$)", 1))
    return blocks.select(F.expr(r"try_cast(regexp_extract(b, '(?is)<num>\\D*(\\d+)', 1) as int)").alias("query_id"), part("title").alias("title"))


def queries_from_list(spark: SparkSession, titles: list[str]) -> DataFrame:
    """query_id from 1, title; the list ends at "-1"."""
    kept = titles[: titles.index("-1")] if "-1" in titles else titles
    return spark.createDataFrame([(i, t) for i, t in enumerate(kept, 1)], "query_id int, title string")


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """term_id, idf, term of the lines with three fields."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") == 3)
    return f.select(F.expr("try_cast(f[0] as int)").alias("term_id"), F.expr("try_cast(f[1] as double)").alias("idf"), F.col("f")[2].alias("term")).where("term_id is not null and idf is not null")


def id_vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, term_id of lines such as `Query 1: (72, 191, 192)`."""
    hit = spark.read.text(path).select(F.regexp_extract("value", r"(\d+)\s*:", 1).alias("v"), F.regexp_extract("value", r"\(([^)]*)\)", 1).alias("t")).where("v <> ''")
    return hit.select(F.col("v").cast("int").alias("vec_id"), F.explode(F.regexp_extract_all("t", F.lit(r"\d+"), F.lit(0))).alias("t")).select("vec_id", F.col("t").cast("int").alias("term_id"))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    return id_vectors(spark, path).select(F.col("vec_id").alias("query_id"), F.col("term_id").alias("doc_id"))


def tab_run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rank, doc_id and, where the file has it, sim."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    at = lambda i, kind: F.expr(f"try_cast(try_element_at(f, {i + 1}) as {kind})")
    return f.select(at(0, "int").alias("query_id"), at(1, "int").alias("rank"), at(2, "long").alias("doc_id"), at(3, "double").alias("sim")).where("query_id is not null")


def q0_run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, q, doc_id, rank, score, model."""
    return spark.read.csv(path, sep=" ", schema="query_id int, q string, doc_id long, rank int, score double, model string")


def tagged_collection(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, author, body, xref of `.I .T .A .W .X` blocks. A section that a document lacks is null, whatever the
    document before it had."""
    text = spark.read.option("lineSep", "\n.I ").text(path).select(F.regexp_replace("value", r"^\.I ", "").alias("v"))
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("v", rf"(?s)\n\.{tag}[^\n]*\n(.*?)(?=\n\.[TAWXB]\s|\n\.[TAWXB]\n|$)", 1)), F.lit(""))
    return text.select(F.expr(r"try_cast(regexp_extract(v, '^\\s*(\\d+)', 1) as int)").alias("doc_id"), part("T").alias("title"), part("A").alias("author"), part("W").alias("body"), part("X").alias("xref")).where("doc_id is not null")


def postings_dump(spark: SparkSession, path: str) -> DataFrame:
    """term, df, docs (rising) of lines `term:df:doc,doc`; ids that are no numbers are left out."""
    f = spark.read.text(path).select(F.split("value", ":").alias("f")).where(F.size("f") == 3)
    docs = F.expr("array_sort(filter(transform(split(f[2], ','), x -> try_cast(trim(x) as bigint)), x -> x is not null))")
    return f.select(F.col("f")[0].alias("term"), F.expr("try_cast(f[1] as bigint)").alias("df"), docs.alias("docs"))


def postings_text(spark: SparkSession, path: str) -> DataFrame:
    """term_id, doc_id, value, positions of lines `id:doc,value;` or `id:doc,p1,p2;`. positions is an array always."""
    rows = spark.read.text(path).select(F.split("value", ":").alias("f")).where(F.size("f") == 2)
    items = rows.select(F.col("f")[0].cast("long").alias("term_id"), F.explode(F.filter(F.split(F.col("f")[1], ";"), lambda x: x != "")).alias("i"))
    parts = items.select("term_id", F.split("i", ",").alias("p"))
    return parts.select("term_id", F.col("p")[0].cast("long").alias("doc_id"), F.expr("try_cast(p[1] as double)").alias("value"), F.expr("transform(slice(p, 2, size(p) - 1), x -> cast(try_cast(x as double) as int))").alias("positions"))


def evaluation_report(spark: SparkSession, path: str) -> DataFrame:
    """level (percent), value of lines `Precision at N% : v`."""
    hit = spark.read.text(path).select(F.regexp_extract("value", r"(?i)precision at\s+(\d+)%\D*?([0-9.]+)\s*$", 1).alias("l"), F.regexp_extract("value", r"(?i)precision at\s+(\d+)%\D*?([0-9.]+)\s*$", 2).alias("v"))
    return hit.where("l <> ''").select(F.col("l").cast("int").alias("level"), F.col("v").cast("double").alias("value"))


def id_names(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, name of lines `id name`."""
    f = spark.read.text(path).select(F.split("value", r"\s+", 2).alias("f")).where(F.size("f") == 2)
    return f.select(F.expr("try_cast(f[0] as bigint)").alias("doc_id"), F.col("f")[1].alias("name")).where("doc_id is not null")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html: fetched pages. One without text, or whose content type (where the table has one) isn't HTML, has empty
    text: its address stays known, and no link leaves it."""
    rows = spark.read.parquet(path)
    html = F.coalesce("html", F.lit(""))
    if "content_type" in rows.columns:
        html = F.when(F.lower("content_type").rlike(r"^\s*(text/html|application/xhtml\+xml)\b"), html).otherwise("")
    return rows.select("page_id", "url", html.alias("html"))


def stored_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What sinks.store_index has written, by name."""
    names = [r["name"] for r in spark.read.json(f"{path}/tables").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def stored_settings(spark: SparkSession, path: str) -> AnalyzerConfig:
    """The analyzer settings that an index was built with."""
    found = json.loads(spark.read.text(f"{path}/settings").first()[0])
    return AnalyzerConfig(**found | {"stopwords": tuple(found["stopwords"])})


def postings_at(index: dict[str, DataFrame], pointers: list[int]) -> DataFrame:
    """pointer, term, doc_id, tf of the lists that begin at the given bytes; files and row groups of other terms are skipped."""
    asked = index["vocabulary"].where(F.col("pointer").isin(pointers)).select("pointer", "term")
    return index["postings"].select("term", "doc_id", "tf").join(asked, "term").select("pointer", "term", "doc_id", "tf")


def vocabulary_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the words of a plain word list, one to a line, once each."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


#: Operators as whole words by default; as substrings in the way of old query files.
BOOLEAN = ("AND", "OR", "NOT")


def parse_query(title: str, legacy: bool = False) -> dict:
    """op, distance and text of a query title: phrase in quotes, N-TERMS / ADJACENT / CLOSE-TO, or the last of AND, OR, NOT."""
    if spans := re.findall(r'"([^"]*)"', title):
        return {"op": "PHRASE", "distance": None, "text": spans[-1]}
    for pattern, distance in ((r"\sADJACENT\b", 1), (r"\sCLOSE-TO\b", 5)):
        if re.search(pattern, title):
            return {"op": "NEAR", "distance": distance, "text": re.sub(pattern, " ", title)}
    if near := re.search(r"\s(\d+)-TERMS\b", title):
        return {"op": "NEAR", "distance": int(near[1]), "text": title.replace(near[0], " ")}
    found = [w for w in BOOLEAN if (w in title if legacy else re.search(rf"\b{w}\b", title))]
    text = title
    for w in found:
        text = text.replace(w, " ") if legacy else re.sub(rf"\b{w}\b", " ", text)
    return {"op": found[-1] if found else None, "distance": None, "text": text}


def parsed_queries(spark: SparkSession, titles: list[tuple[int, str]], legacy: bool = False) -> DataFrame:
    """query_id, title, op, distance, terms. Queries come from the driver, so they are parsed there; terms are analysed in Spark."""
    from tesela.functions.text import tokenize

    rows = [(i, t, *(parse_query(t, legacy)[k] for k in ("op", "distance", "text"))) for i, t in titles]
    df = spark.createDataFrame(rows, "query_id int, title string, op string, distance int, text string")
    return df.select("query_id", "title", "op", "distance", tokenize(F.col("text")).alias("terms"))
