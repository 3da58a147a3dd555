"""Links, crawl order and PageRank over DataFrames."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.operators.index import ranked
from tesela.operators.shared import cut

HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else urljoin(a, b) for a, b in zip(base, link, strict=True)])


def is_relative(url: Column) -> Column:
    """Without a host: mail addresses count as relative."""
    return ~url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def page_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """page_id, url, at, link: anchors in order, repeated ones too, without fragments; relative ones are resolved.

    Root-relative links (the common kind) are resolved in the JVM, others by the full rules in a vectorised UDF."""
    links = F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: ~x.startswith("#"))
    if limit is not None:
        links = F.slice(links, 1, limit)
    rows = pages.select("page_id", "url", F.posexplode(links).alias("at", "link"))
    rooted = F.col("link").startswith("/") & ~F.col("link").startswith("//")
    plain = rows.where(~is_relative(F.col("link")) | rooted).withColumn("link", F.when(rooted, F.concat(origin(F.col("url")), F.col("link"))).otherwise(F.col("link")))
    other = rows.where(is_relative(F.col("link")) & ~rooted).withColumn("link", absolute("url", "link"))
    return plain.unionByName(other)


def out_degree(edges: DataFrame) -> DataFrame:
    """src, n_links: different targets."""
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("n_links"))


def with_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id from 1 in the order of the names, node) and edges (src, dst) by these ids. edges: src, dst names."""
    nodes = ranked(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "id", F.asc("node")).select("id", "node")
    by = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    return nodes, edges.join(by("src"), "src").join(by("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def crawl(edges: DataFrame, seeds: DataFrame, max_urls: int = 50) -> DataFrame:
    """url, depth, id of the first max_urls known addresses, breadth first; inside a level by address.

    edges: src, dst. seeds: url. A level is one join; the loop runs over levels, and each level is cut."""
    known = cut(seeds.select("url").distinct().select("url", F.lit(0).alias("depth")))
    depth, n = 0, known.count()
    while n < max_urls:
        frontier = known.where(F.col("depth") == depth)
        fresh = edges.join(frontier, edges["src"] == frontier["url"], "left_semi").select(F.col("dst").alias("url")).distinct()
        fresh = fresh.join(known, "url", "left_anti").orderBy("url").limit(max_urls - n)
        depth += 1
        grown = cut(known.unionByName(fresh.select("url", F.lit(depth).alias("depth"))))
        m = grown.count()
        if m == n:
            break
        known, n = grown, m
    return ranked(known, "id", F.asc("depth"), F.asc("url")).where(F.col("id") <= max_urls).select("url", "depth", "id")


def page_rank(edges: DataFrame, teleport: float = 0.15, epsilon: float | None = 1e-5, iterations: int = 1000, every: int = 8) -> DataFrame:
    """node, rank. edges: src, dst, weight (not negative); the nodes are those of either end.

    Rows are normalised by their weight; a node without out-edges spreads its rank evenly, which is one sum that the
    driver sees instead of a dense row. Starts from 1/n and stops after `iterations`, or once the change of the ranks, as a
    vector's length, falls below epsilon. The loop is cut every few rounds."""
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    totals = edges.groupBy("src").agg(F.sum("weight").alias("total")).where("total > 0")
    moves = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(totals, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    sources = totals.select(F.col("src").alias("node"), F.lit(True).alias("leads"))
    nodes = cut(nodes.join(sources, "node", "left").na.fill(False, ["leads"]))
    ranks = nodes.select("node", "leads", F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        lost = ranks.where("not leads").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"), F.lit(1).alias("one"))
        whole = ranks.agg(F.sum("rank").alias("whole"))
        came = moves.join(ranks, moves["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("came"))
        new = nodes.join(came, nodes["node"] == came["dst"], "left").join(F.broadcast(lost.join(whole)))  # one row
        spread = (F.coalesce("came", F.lit(0.0)) + F.col("lost") / n) * (1 - teleport) + F.col("whole") * teleport / n
        new = new.select("node", "leads", spread.alias("rank"))
        if epsilon is not None or i % every == every - 1:
            new = cut(new)
        if epsilon is not None:
            old = ranks.select("node", F.col("rank").alias("old"))
            if (new.join(old, "node").agg(F.sqrt(F.sum((F.col("rank") - F.col("old")) ** 2))).first()[0] or 0.0) < epsilon:
                ranks = new
                break
        ranks = new
    return ranks.select("node", "rank")
