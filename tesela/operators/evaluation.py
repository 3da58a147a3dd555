"""Evaluation of ranked runs and their comparison. run: query_id, doc_id, rank (from 1). qrels: query_id, doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesela.operators.index import running


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with rel (0 or 1) and total, the number of relevant documents of the query; queries without any are left out."""
    relevant = qrels.select("query_id", "doc_id").distinct()
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    flagged = run.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").na.fill(0, ["rel"])
    return flagged.join(total, "query_id")


def precision_recall(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, rank, doc_id, rel, hits, total, precision and recall down each ranking."""
    order = W.partitionBy("query_id").orderBy("rank")
    down = order.rowsBetween(W.unboundedPreceding, 0)
    j = judged(run, qrels).withColumns({"hits": F.sum("rel").over(down), "place": F.row_number().over(order)})
    return j.select("query_id", "place", "doc_id", "rel", "hits", "total", (F.col("hits") / F.col("place")).alias("precision"), (F.col("hits") / F.col("total")).alias("recall")).withColumnRenamed("place", "rank")


def interpolated(rp: DataFrame) -> DataFrame:
    """query_id, level (0 to 10 tenths of recall), precision: the largest of the ranks whose recall falls into the tenth, else that
    of the next tenth above with ranks, else that of the level before, else 0."""
    best = rp.groupBy("query_id", F.floor(F.col("hits") * 10 / F.col("total")).cast("int").alias("level")).agg(F.max("precision").alias("p"))
    levels = rp.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("level"))
    by = W.partitionBy("query_id").orderBy("level")
    above = F.first("p", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))
    before = F.last("p", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    return levels.join(best, ["query_id", "level"], "left").select("query_id", "level", F.coalesce(above, before, F.lit(0.0)).alias("precision"))


def stats(rp: DataFrame) -> DataFrame:
    """query_id, retrieved, relevant, relevant_retrieved, ap_ref (over relevant retrieved), ap (over relevant), r_precision."""
    hit = F.when(F.col("rel") == 1, F.col("precision"))
    found = F.sum("rel")
    return rp.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.max("total").alias("relevant"),
        found.alias("relevant_retrieved"),
        (F.sum(hit) / F.nullif(found, F.lit(0))).alias("ap_ref"),
        (F.coalesce(F.sum(hit), F.lit(0.0)) / F.max("total")).alias("ap"),
        F.max_by("precision", F.when(F.col("rank") <= F.col("total"), F.col("rank"))).alias("r_precision"),
    )


def macro(rp: DataFrame) -> DataFrame:
    """rank, n_queries, precision: the mean over the queries that have the rank."""
    return rp.groupBy("rank").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("precision").alias("precision"))


def macro_stats(per_query: DataFrame) -> DataFrame:
    sums = [F.sum(k).alias(k) for k in ("retrieved", "relevant", "relevant_retrieved")]
    return per_query.agg(*sums, *(F.avg(k).alias(k) for k in ("ap_ref", "ap", "r_precision")))


def micro(rp: DataFrame) -> DataFrame:
    """All queries as one ranking: at each rank, what all queries have retrieved and found so far. Sums are over
    ranges of ranks, each in its own task."""
    per_rank = rp.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.sum("rel").alias("r"))
    total = rp.select("query_id", "total").distinct().agg(F.sum("total").alias("total"))
    summed = running(running(per_rank, "rank", F.col("n"), "retrieved"), "rank", F.col("r"), "hits")
    return summed.join(F.broadcast(total)).select("rank", "retrieved", "hits", (F.col("hits") / F.col("retrieved")).alias("precision"), (F.col("hits") / F.col("total")).alias("recall"))


def top_n(run: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return run.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def spearman(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """query_id, n_docs, rho of two runs at their first n: a document that one run lacks gets the rank behind that run's last."""
    a = top_n(left, n).select("query_id", "doc_id", F.col("rank").alias("ra"))
    b = top_n(right, n).select("query_id", "doc_id", F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "doc_id"], "full")
    q = W.partitionBy("query_id")
    fill = lambda k: F.coalesce(F.col(k), F.coalesce(F.max(k).over(q), F.lit(0)) + 1)
    filled = both.select("query_id", fill("ra").alias("ra"), fill("rb").alias("rb"))
    d = F.col("ra") - F.col("rb")
    sums = filled.groupBy("query_id").agg(F.sum(d * d).alias("d2"), F.count(F.lit(1)).alias("n_docs"))
    m = F.col("n_docs") - 1
    bottom = m * (m * m - 1)
    return sums.select("query_id", "n_docs", F.when((F.col("d2") == 0) | (bottom == 0), F.lit(1.0)).otherwise(1 - 6 * F.col("d2") / bottom).alias("rho"))


def compare_models(tables: dict[str, DataFrame]) -> DataFrame:
    """level and the mean interpolated precision of each model, side by side."""
    out = None
    for name, per_query in tables.items():
        own = per_query.groupBy("level").agg(F.avg("precision").alias(name))
        out = own if out is None else out.join(own, "level")
    return out


def normalise_doc_ids(run: DataFrame, own: DataFrame, external: DataFrame) -> DataFrame:
    """run with the external id of the document of the same name; where no name or several match, the id stays.

    own, external: doc_id, name."""
    unique = external.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("doc_id").alias("new_id")).where("n = 1")
    names = own.join(unique, "name").select("doc_id", "new_id")
    return run.join(names, "doc_id", "left").withColumn("doc_id", F.coalesce("new_id", "doc_id")).drop("new_id")
