"""Boolean, phrase, proximity and ranked retrieval.

queries: query_id, terms (array, in order, normalised). tf: term, doc_id, tf. weights: term, doc_id, tf, weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesela.config import Similarity

#: Words apart of the named proximity operators.
ADJACENT, CLOSE_TO = 1, 5


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: bag of words."""
    return queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def set_of_words(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.array_distinct("terms").alias("terms"))


def intersect(queries: DataFrame, tf: DataFrame) -> DataFrame:
    """query_id, doc_id: documents with all terms, by division; a term that no document has empties the answer."""
    q = set_of_words(queries).select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n"))
    hits = tf.select("term", "doc_id").join(q, "term").groupBy("query_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("found"))
    return hits.where("found = n").select("query_id", "doc_id")


def union(queries: DataFrame, tf: DataFrame) -> DataFrame:
    q = set_of_words(queries).select("query_id", F.explode("terms").alias("term"))
    return tf.select("term", "doc_id").join(q, "term").select("query_id", "doc_id").distinct()


def complement(queries: DataFrame, tf: DataFrame, corpus: DataFrame) -> DataFrame:
    """Documents with none of the terms; a query without terms has an empty answer. Queries are few: they go to every task
    that holds documents."""
    asked = queries.where(F.size("terms") > 0).select("query_id")
    return corpus.select("doc_id").join(asked).join(union(queries, tf), ["query_id", "doc_id"], "left_anti")


def phrase(queries: DataFrame, occ: DataFrame, tf: DataFrame) -> DataFrame:
    """query_id, doc_id: all terms at consecutive positions. A single term is a union; an unknown term empties the answer."""
    long = queries.where(F.size("terms") >= 2)
    q = long.select("query_id", F.posexplode("terms").alias("at", "term"), F.size("terms").alias("n"))
    starts = occ.join(q, "term").groupBy("query_id", "n", "doc_id", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("found"))
    return starts.where("found = n").select("query_id", "doc_id").distinct().unionByName(union(queries.where(F.size("terms") < 2), tf))


def near(queries: DataFrame, occ: DataFrame, distance: int | None = None, direction: str = "both") -> DataFrame:
    """query_id, doc_id: the first two different terms of a query within a distance, that of the call or of the query's column.

    direction: both, left (the second term before the first) or right. Positions that are close lie in one or in neighbouring
    stretches of distance + 1 positions, so the join is an equality on (document, stretch) and never all pairs of a document."""
    apart = F.lit(distance) if distance is not None else F.col("distance")
    two = F.array_distinct("terms")
    q = queries.where(F.size(two) >= 2).select("query_id", two[0].alias("t1"), two[1].alias("t2"), apart.cast("int").alias("d"))
    width = F.col("d") + 1
    left = occ.join(q, occ["term"] == q["t1"]).select("query_id", "d", "doc_id", F.col("pos").alias("p1"), F.floor(F.col("pos") / width).alias("s"))
    right = occ.join(q, occ["term"] == q["t2"]).select("query_id", "doc_id", F.col("pos").alias("p2"), F.explode(F.array(*(F.floor(F.col("pos") / width) + k for k in (-1, 0, 1)))).alias("s"))
    gap = F.col("p2") - F.col("p1")
    close = {"both": F.abs(gap), "right": F.when(gap > 0, gap), "left": F.when(gap < 0, -gap)}[direction] <= F.col("d")
    return left.join(right, ["query_id", "doc_id", "s"]).where(close).select("query_id", "doc_id").distinct()


def retrieve(queries: DataFrame, occ: DataFrame, tf: DataFrame, corpus: DataFrame) -> DataFrame:
    """Dispatch by the column op: NEAR (with distance), AND, OR, NOT, PHRASE; none is OR."""
    of = lambda *ops: queries.where(F.coalesce("op", F.lit("OR")).isin(*ops))
    parts = [near(of("NEAR"), occ), intersect(of("AND"), tf), complement(of("NOT"), tf, corpus), phrase(of("PHRASE"), occ, tf), union(of("OR"), tf)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def query_weights(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """query_id, term, qweight = qtf * idf, for known terms."""
    return query_terms(queries).join(vocab.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("qweight"))


def rank(queries: DataFrame, weights: DataFrame, vocab: DataFrame, norms: DataFrame, similarity: Similarity = Similarity.COSINE) -> DataFrame:
    """query_id, doc_id, score for documents that share a term with the query. Norms are read for the measures that need them."""
    q = query_weights(queries, vocab)
    product = weights.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qweight")).alias("sp"))
    if similarity is Similarity.SCALAR:
        return product.select("query_id", "doc_id", F.col("sp").alias("score"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qweight") * F.col("qweight"))).alias("qn"))
    sp, d, n = F.col("sp"), F.col("norm"), F.col("qn")
    top, bottom = {
        Similarity.COSINE: (sp, d * n),
        Similarity.JACCARD: (sp, d * d + n * n - sp),
        Similarity.DICE: (2 * sp, d * d + n * n),
    }[similarity]
    both = product.join(norms, "doc_id").join(qn, "query_id").withColumns({"t": top, "b": bottom})
    return both.where("b != 0").select("query_id", "doc_id", (F.col("t") / F.col("b")).alias("score"))


def top_k(scores: DataFrame, k: int, *order, start: int = 1) -> DataFrame:
    """query_id, doc_id, rank, score: the first k of each query, by partial limits before the exchange."""
    order = order or (F.desc("score"), F.desc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") + (start - 1)).cast("long")).select("query_id", "doc_id", "rank", "score")


def narrow(table: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of a table by term that the queries ask for. It stands before every other join and aggregate, so what is
    shuffled afterwards are the queries' postings alone; where queries are many, the size-checked join isn't a broadcast."""
    return table.join(queries.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")


def same_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """query_id, same: whether two rankings (query_id, doc_id, score) of each query hold the same documents with the same scores."""
    key = ["query_id", "doc_id", F.round("score", 6).alias("score")]
    both = left.select(*key, F.lit(1).alias("side")).unionByName(right.select(*key, F.lit(-1).alias("side")))
    rows = both.groupBy("query_id", "doc_id", "score").agg(F.sum("side").alias("rest"))
    return rows.groupBy("query_id").agg(F.bool_and(F.col("rest") == 0).alias("same"))


def idvector_union(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id: the vectors of term ids that share an id with the query's."""
    return vectors.select("vec_id", "term_id").join(queries.select("query_id", "term_id").distinct(), "term_id").select("query_id", "vec_id").distinct()


def summed_weights(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the documents' weights over the query's different terms; the query's own weights don't count."""
    q = set_of_words(queries).select("query_id", F.explode("terms").alias("term"))
    return weights.join(q, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 9).alias("score"))


def term_at_a_time(queries: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Of ties the larger document id comes first."""
    return top_k(summed_weights(queries, weights), k)


def document_at_a_time(queries: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Scores over 0 only; ties at the boundary keep the smallest ids, and the answer lists larger ids first."""
    kept = top_k(summed_weights(queries, weights).where("score > 0"), k, F.desc("score"), F.asc("doc_id"))
    return top_k(kept.drop("rank"), k)


def idvector_rank(vectors: DataFrame, queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """query_id, vec_id, dp, cosine for vectors of term ids: a term that occurs weighs its idf, an unknown one 0."""
    idf = vocab.select("term_id", "idf")
    v = vectors.select("vec_id", "term_id").distinct().join(idf, "term_id", "left").na.fill(0.0, ["idf"])
    q = queries.select("query_id", "term_id").distinct().join(idf, "term_id", "left").na.fill(0.0, ["idf"])
    norm = lambda df, k, name: df.groupBy(k).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias(name))
    dp = v.join(q.drop("idf"), "term_id").groupBy("query_id", "vec_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dp")).where("dp > 0")
    return dp.join(norm(v, "vec_id", "vn"), "vec_id").join(norm(q, "query_id", "qn"), "query_id").select("query_id", "vec_id", "dp", (F.col("dp") / (F.col("vn") * F.col("qn"))).alias("cosine"))
