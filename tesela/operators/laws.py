"""Corpus laws: Zipf's ranks, fits and tails, and Heaps' curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesela.operators.index import ranked, running


def zipf_rank(counts: DataFrame) -> DataFrame:
    """term, freq, rank (ties share the least), c = freq * rank. The rank of a frequency is one more than the number of terms
    with a larger one, so the window runs over distinct frequencies, not over terms."""
    sizes = counts.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(W.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = sizes.select("freq", (above + 1).alias("rank"))
    return counts.join(ranks, "freq").select("term", "freq", "rank", (F.col("freq") * F.col("rank")).alias("c"))


def zipf_cumulative(counts: DataFrame) -> DataFrame:
    """term, freq, cum, rel, cum_rel, by falling frequency; ties in the order of the terms."""
    placed = ranked(counts, "place", F.desc("freq"), F.asc("term"))
    summed = running(placed, "place", F.col("freq"), "cum")
    total = counts.agg(F.sum("freq").alias("total"))
    return summed.join(F.broadcast(total)).select("term", "freq", "cum", (F.col("freq") / F.col("total")).alias("rel"), (F.col("cum") / F.col("total")).alias("cum_rel"))


def zipf_prune(cumulative: DataFrame, share: float) -> DataFrame:
    """Without the tails that hold `share` of all occurrences together."""
    return cumulative.where(F.col("cum_rel").between(share / 2, 1 - share / 2))


def zipf_fit(ranks: DataFrame) -> DataFrame:
    """slope, intercept and r2 of ln freq over ln rank."""
    y, x = F.log("freq"), F.log("rank")
    return ranks.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def zipf_constant_summary(ranks: DataFrame) -> DataFrame:
    at = lambda p: F.percentile("c", F.lit(p))
    return ranks.agg(F.count("c").alias("n"), F.avg("c").alias("mean"), F.stddev("c").alias("std"), F.min("c").alias("min"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max("c").alias("max"))


def omitted_share(cumulative: DataFrame, below: int = 5) -> DataFrame:
    """Percent of occurrences in terms of fewer than `below` occurrences."""
    kept = cumulative.agg(F.min(F.when(F.col("freq") < below, F.col("cum_rel"))).alias("m"))
    return kept.select(((1 - F.col("m")) * 100).alias("share"))


def predicted_share(ranks: DataFrame, cumulative: DataFrame, below: int = 5) -> DataFrame:
    """The same by the fit: terms behind the rank at which it gives `below`."""
    cut = zipf_fit(ranks).select(F.exp((F.log(F.lit(float(below))) - F.col("intercept")) / F.col("slope")).alias("cut"))
    tail = ranks.select("term", "rank").join(cumulative, "term").join(F.broadcast(cut)).where("rank > cut")
    return tail.agg(((1 - F.min("cum_rel")) * 100).alias("share"))


def predicted_frequency(fit: DataFrame, ranks: list[int]) -> DataFrame:
    rows = fit.select("slope", "intercept", F.explode(F.array(*map(F.lit, ranks))).alias("rank"))
    return rows.select(F.col("rank").cast("long").alias("rank"), F.exp(F.col("slope") * F.log("rank") + F.col("intercept")).alias("freq"))


def heaps_curve(occ: DataFrame, stage: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_terms after each document: running sums over documents of tokens and of terms seen first there.

    Two levels, so no task orders all tokens. With a stage column the sums restart in each stage, while terms stay known."""
    keys = [stage, "doc_id"] if stage else ["doc_id"]
    first = occ.groupBy("term").agg(F.min(F.struct(*keys)).alias("at")).groupBy(*(F.col(f"at.{k}").alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("new"))
    sizes = occ.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    docs = sizes.join(first, keys, "left").na.fill(0, ["new"])
    if stage:
        frame = W.partitionBy(stage).orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)
        return docs.select(stage, "doc_id", F.sum("n").over(frame).alias("n_tokens"), F.sum("new").over(frame).alias("n_terms"))
    out = running(running(docs, "doc_id", F.col("n"), "n_tokens"), "doc_id", F.col("new"), "n_terms")
    return out.select("doc_id", "n_tokens", "n_terms")


def heaps_tokens(occ: DataFrame) -> DataFrame:
    """doc_id, pos, n_terms: the curve after each token, by documents' offsets and a sum inside each document."""
    first = occ.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    flagged = occ.join(first.select(F.col("at.doc_id").alias("doc_id"), F.col("at.pos").alias("pos"), F.lit(1).alias("new")), ["doc_id", "pos"], "left").na.fill(0, ["new"])
    per_doc = running(flagged.groupBy("doc_id").agg(F.sum("new").alias("add")), "doc_id", F.col("add"), "before", exclusive=True).select("doc_id", "before")
    inside = F.sum("new").over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return flagged.select("doc_id", "pos", inside.alias("inside")).join(per_doc, "doc_id").select("doc_id", "pos", (F.col("inside") + F.col("before")).alias("n_terms"))


def heaps_estimate(curve: DataFrame, k: float = 10.0, beta: float = 0.6) -> DataFrame:
    return curve.select("doc_id", "n_tokens", (F.lit(k) * F.pow(F.col("n_tokens").cast("double"), F.lit(beta))).alias("estimate"))
