"""Layout of postings: gaps, skip lists and compressed sizes. postings: term, doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesela.functions import codes
from tesela.operators.index import joined_lists, ranked, running


def dgaps(postings: DataFrame) -> DataFrame:
    """term, doc_id, gap to the document before; the first gap is from 0."""
    before = F.lag("doc_id", 1, 0).over(W.partitionBy("term").orderBy("doc_id"))
    return postings.select("term", "doc_id", (F.col("doc_id") - before).alias("gap"))


def undo_dgaps(gaps: DataFrame, order: str) -> DataFrame:
    """term, order, doc_id: running sums of gaps."""
    down = W.partitionBy("term").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return gaps.select("term", order, F.sum("gap").over(down).alias("doc_id"))


def skip_lists(postings: DataFrame) -> DataFrame:
    """term, entry (from 0), doc_id, idx: pointers into each list, the root of its length and one of them, or all of one."""
    return pointers(postings, 0)


def pointers(postings: DataFrame, back: int) -> DataFrame:
    """The entries of skip lists, with the document `back` places before the target (0 before the first) as doc_id.

    Places come from a global order in ranges of (term, document), so no task holds or sorts the list of a frequent term."""
    placed = ranked(postings.select("term", "doc_id"), "place", F.asc("term"), F.asc("doc_id"))
    lists = placed.groupBy("term").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    wanted = F.when(n < 2, n).otherwise(F.floor(F.sqrt(n.cast("double"))) + 1)
    sized = lists.select("term", "start", wanted.alias("wanted"), F.floor(n / wanted).alias("step"))
    at = F.col("place") - F.col("start") + back  # of the target
    hits = placed.join(sized, "term").withColumn("idx", at).where(((F.col("idx") + 1) % F.col("step") == 0) & ((F.col("idx") + 1) / F.col("step") <= F.col("wanted")))
    out = hits.select("term", (F.col("idx") + 1).alias("i"), "step", "doc_id", "idx").select("term", (F.floor(F.col("i") / F.col("step")) - 1).alias("entry"), "doc_id", "idx")
    if not back:
        return out
    first = sized.where(F.col("step") <= back).select("term", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("idx"))
    return out.unionByName(first)


def skip_lists_for_gaps(postings: DataFrame) -> DataFrame:
    """As skip_lists, with the document before the pointer's target as key (0 before the first), from which gaps go on."""
    return pointers(postings, 1)


def compressed(gaps: DataFrame) -> DataFrame:
    """term, gamma, vbyte: the bits of each list of gaps; gap + 1 is coded, as a gap from document 0 may be 0."""
    k = F.col("gap") + 1
    return joined_lists(gaps.select("term", "doc_id", codes.gamma_encode(k).alias("gamma"), codes.vbyte_encode(k).alias("vbyte")), "term", "gamma", "vbyte")


def compression_size(gaps: DataFrame) -> DataFrame:
    """kB (bits / 8000) of all lists by each code, by closed forms."""
    k = F.col("gap") + 1
    return gaps.agg(F.round(F.sum(codes.gamma_bits(k)) / 8000.0, 6).alias("gamma_kb"), F.round(F.sum(codes.vbyte_bits(k)) / 8000.0, 6).alias("vbyte_kb"))


def bulk_load(dump: DataFrame) -> DataFrame:
    """term, df, pointer, docs, gaps, skips of a postings dump (term, docs), sorted by term."""
    rows = dump.select("term", F.array_sort("docs").alias("docs")).select("term", F.posexplode("docs").alias("i", "doc_id"))
    gaps = dgaps(rows.select("term", "doc_id")).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "gap"))).alias("g"))
    skips = skip_lists_for_gaps(rows.select("term", "doc_id")).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("entry", "doc_id", "idx"))).alias("skips"))
    joined = gaps.join(skips, "term").select("term", F.size("g").cast("long").alias("df"), F.transform("g", lambda x: x["doc_id"]).alias("docs"), F.transform("g", lambda x: x["gap"]).alias("gaps"), "skips")
    return running(joined, "term", F.col("df") * 8, "pointer", exclusive=True)
