"""The inverted index as DataFrames: occurrences are the fact table, everything else aggregates them.

corpus: doc_id, text. occurrences: doc_id, pos (from 0, in the filtered terms of the whole document), term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesela.config import AnalyzerConfig
from tesela.functions.stem_es import stem_es
from tesela.functions.text import analyse, keep_length
from tesela.operators.shared import cut


def analysed(corpus: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """doc_id, tokens, terms, kept. With patterns the unit is a line: what a line yields follows its ordinary terms."""
    if not config.regex:
        return corpus.select("doc_id", analyse(F.col("text"), config).alias("a")).select("doc_id", "a.*")
    lines = corpus.select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: analyse(x, config)).alias("a"))
    whole = lambda k: F.flatten(F.transform("a", lambda x: x[k]))
    mixed = F.flatten(F.transform("a", lambda x: F.concat(x["terms"], x["kept"])))
    return lines.select("doc_id", whole("tokens").alias("tokens"), mixed.alias("terms"), whole("kept").alias("kept"))


def occurrences(corpus: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """doc_id, pos, term. Stemming runs over distinct terms, which are joined back; lengths are judged on stems."""
    a = analysed(corpus, config)
    if not config.stem:
        return a.select("doc_id", F.posexplode("terms").alias("pos", "term"))
    if config.stem != "spanish":
        raise ValueError("only Spanish stemming is there")
    rows = a.select("doc_id", F.posexplode("terms").alias("raw", "term"), "kept")
    rows = rows.select("doc_id", "raw", "term", F.array_contains("kept", F.col("term")).alias("whole"))
    stems = rows.where(~F.col("whole")).select("term").distinct().select("term", stem_es("term").alias("stem"))
    joined = rows.join(stems, "term", "left").select("doc_id", "raw", "whole", F.when(F.col("whole"), F.col("term")).otherwise(F.col("stem")).alias("term"))
    low, high = config.min_size or 0, config.max_size or 1 << 30
    joined = joined.where(F.col("whole") | F.length("term").between(low, high))
    order = W.partitionBy("doc_id").orderBy("raw")
    return joined.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "term")


def term_frequency(occ: DataFrame) -> DataFrame:
    """term, doc_id, tf."""
    return occ.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def collection_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def positional_index(occ: DataFrame) -> DataFrame:
    """term, doc_id, positions: rising."""
    return occ.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def vocabulary(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, cf, df, idf = ln(N / df). n_docs: one row with n."""
    counts = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    return counts.join(F.broadcast(n_docs)).select("term", "cf", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def ranked(df: DataFrame, name: str, *order: Column, start: int = 1) -> DataFrame:
    """Numbers rows in a global order without one task for all: ranges are sorted apart and shifted by the sizes before them.

    The ranges with their numbers are cut in the shared folder, so that sizes and rows come from one and the same exchange."""
    from pyspark.sql import types as T

    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__row", inside).join(offsets, "__part").select(*df.columns, (F.col("__row") + F.col("__offset") + (start - 1)).cast(T.LongType()).alias(name))


def term_ids(terms: DataFrame) -> DataFrame:
    """term, term_id: from 1, in code-point order."""
    return ranked(terms.select("term").distinct(), "term_id", F.col("term").asc())


def n_documents(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("n"))


def tf_idf(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """term, doc_id, tf, weight = (tf / largest tf of the document) * idf."""
    top = tf.groupBy("doc_id").agg(F.max("tf").alias("top"))
    return tf.join(top, "doc_id").join(vocab.select("term", "idf"), "term").select("term", "doc_id", "tf", (F.col("tf") / F.col("top") * F.col("idf")).alias("weight"))


def doc_norms(weights: DataFrame, corpus: DataFrame) -> DataFrame:
    """doc_id, norm: 0 for a document without terms."""
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return corpus.select("doc_id").join(norms, "doc_id", "left").select("doc_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def postings(occ: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions (rising). Ranges of (term, document), so that a frequent term's list is cut over tasks."""
    ranges = occ.repartitionByRange("term", "doc_id").groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return ranges.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions").sortWithinPartitions("term", "doc_id")


def build(corpus: DataFrame, path: str, config: AnalyzerConfig = AnalyzerConfig()) -> None:
    """Writes an index: postings; vocabulary (term, term_id, cf, df, idf, pointer); documents (doc_id, n_tokens, top, norm); and
    the analyzer's settings. The corpus is read once; each table is read back before the next one is made of it."""
    from tesela.sources import sinks

    spark = corpus.sparkSession
    sinks.store_table(postings(occurrences(corpus, config)), f"{path}/postings")
    tf = spark.read.parquet(f"{path}/postings").select("term", "doc_id", "tf")
    vocab = ranked(vocabulary(tf, n_documents(corpus)), "term_id", F.asc("term"))
    vocab = running(vocab, "term_id", F.col("df") * 8, "pointer", exclusive=True)
    sinks.store_table(vocab.select("term", "term_id", "cf", "df", "idf", "pointer").repartitionByRange("term").sortWithinPartitions("term"), f"{path}/vocabulary")
    vocab = spark.read.parquet(f"{path}/vocabulary")
    sizes = tf.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.max("tf").alias("top"))
    norms = doc_norms(tf_idf(tf, vocab), corpus)
    documents = norms.join(sizes, "doc_id", "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("top", F.lit(0)).alias("top"), "norm")
    sinks.store_table(documents, f"{path}/documents")
    sinks.store_settings(spark, config, path, ["postings", "vocabulary", "documents"])


def lookup(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """term, cf, df, idf of the asked terms; 0 for those that the vocabulary lacks."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return terms.select("term").distinct().join(vocab, "term", "left").select("term", zero("cf"), zero("df"), F.coalesce("idf", F.lit(0.0)).alias("idf"))


def corpus_stats(corpus: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """One row: documents, tokens, terms of the vocabulary, their ratios, mean length of a term, terms that occur once."""
    a = analysed(corpus, config)
    totals = a.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("tokens")).alias("n_tokens"))
    words = occurrences(corpus, config).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    vocab = words.agg(F.count(F.lit(1)).alias("n_terms"), F.avg(F.length("term")).alias("avg_term_length"), F.count_if(F.col("cf") == 1).alias("n_hapax"))
    ratio = lambda k: F.round(F.col(k) / F.nullif(F.col("n_docs"), F.lit(0)), 6)
    return totals.join(vocab).select("n_docs", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_terms", ratio("n_tokens").alias("tokens_per_doc"), ratio("n_terms").alias("terms_per_doc"), F.round("avg_term_length", 6).alias("avg_term_length"), "n_hapax")


def doc_extremes(corpus: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """kind, doc_id, n_tokens, n_terms of the longest and the shortest document by tokens; of ties the last one."""
    a = analysed(corpus, config).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("terms")).cast("long").alias("n_terms"))
    whole = F.struct("doc_id", "n_tokens", "n_terms")
    best = a.agg(F.max_by(whole, F.struct("n_tokens", "doc_id")).alias("longest"), F.min_by(whole, F.struct(F.col("n_tokens"), -F.col("doc_id"))).alias("shortest"))
    return best.select(F.explode(F.create_map(F.lit("longest"), "longest", F.lit("shortest"), "shortest")).alias("kind", "d")).select("kind", "d.*")


def postings_stats(tf: DataFrame) -> DataFrame:
    df = document_frequency(tf)
    return df.agg(F.min("df").alias("min_df"), F.max("df").alias("max_df"), F.round(F.avg("df"), 6).alias("avg_df"))


#: Documents of a stretch of a list that one task writes.
RANGE = 1 << 12


def joined_lists(rows: DataFrame, key: str, *entries: str) -> DataFrame:
    """key and, for each column of strings, its values in the order of doc_id as one string. A list is written in stretches of
    documents first, so no task sorts or holds the entries of a frequent term; only the stretches' strings meet."""
    struct = lambda by: F.array_sort(F.collect_list(F.struct(by, *entries))).alias("l")
    text = [F.array_join(F.col(f"l.{e}"), "").alias(e) for e in entries]
    parts = rows.withColumn("__range", F.floor(F.col("doc_id") / RANGE)).groupBy(key, "__range").agg(struct("doc_id")).select(key, "__range", *text)
    return parts.groupBy(key).agg(struct("__range")).select(key, *text)


def postings_text(tf: DataFrame, ids: DataFrame) -> DataFrame:
    """term_id, line: `id:doc,value;doc,value;` with six decimals."""
    entry = F.format_string("%d,%.6f;", F.col("doc_id"), F.col("tf").cast("double"))
    lists = joined_lists(tf.join(ids, "term").select("term_id", "doc_id", entry.alias("e")), "term_id", "e")
    return lists.select("term_id", F.concat(F.col("term_id").cast("string"), F.lit(":"), "e").alias("line"))


def postings_pointers(tf: DataFrame, ids: DataFrame) -> DataFrame:
    """term_id, df, pointer: the byte where a list begins if a document takes four bytes and its value four more."""
    sized = document_frequency(tf).join(ids, "term").select("term_id", "df")
    return running(sized, "term_id", (F.col("df") * 8).alias("__add"), "pointer", exclusive=True)


def running(df: DataFrame, order: str, add: Column, name: str, exclusive: bool = False) -> DataFrame:
    """A running sum in a global order: ranges are summed apart and shifted by the sums before them. The ranges are cut in the
    shared folder as in ranked."""
    parts = cut(df.withColumn("__add", add).repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    totals = parts.groupBy("__part").agg(F.sum("__add").alias("__total"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    frame = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    return parts.withColumn("__sum", F.coalesce(F.sum("__add").over(frame), F.lit(0))).join(offsets, "__part").select(*df.columns, (F.col("__sum") + F.col("__offset")).alias(name))


def index_overhead(corpus: DataFrame, tf: DataFrame, ids: DataFrame) -> DataFrame:
    """Bytes of the texts and of the text postings, and the share of the postings in both."""
    texts = corpus.agg(F.sum(F.octet_length("text")).alias("collection_bytes"))
    lists = postings_text(tf, ids).agg(F.sum(F.octet_length("line") + 1).alias("index_bytes"))
    return texts.join(lists).select("collection_bytes", "index_bytes", F.round(F.col("index_bytes") * 100.0 / (F.col("collection_bytes") + F.col("index_bytes")), 6).alias("overhead_pct"))


def dictionary_size(vocab: DataFrame) -> DataFrame:
    """Bytes of a dictionary held as one string: per term three numbers of 4, 4 and 3 bytes and the mean length, rounded down, and 1."""
    n = vocab.agg(F.count(F.lit(1)).alias("n_terms"), F.avg(F.length("term")).alias("a"))
    return n.select("n_terms", (F.col("n_terms") * (12 + F.floor("a"))).cast("long").alias("n_bytes"))


def top_terms(vocab: DataFrame, k: int = 10, most: bool = True) -> DataFrame:
    """The k most or least frequent terms by (cf, df); ties in the order of the terms."""
    by = [F.desc("cf"), F.desc("df")] if most else [F.asc("cf"), F.asc("df")]
    return vocab.select("term", "cf", "df").orderBy(*by, "term").limit(k)


def term_length_hist(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy(F.length("term").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_terms"))
