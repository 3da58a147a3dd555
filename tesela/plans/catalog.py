"""The registered queries over the standard tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesela.config import AnalyzerConfig, Similarity
from tesela.functions import codes, text
from tesela.functions.stem_es import stem_es
from tesela.operators import evaluation, graph, index, laws, postings, retrieval
from tesela.plans.sql import LANGUAGES, STOP, TITLES, TOPICS, tokens, with_parts
from tesela.plans.store import index_tables
from tesela.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder and the index parts over its documents, as lazy plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def corpus(self) -> DataFrame:
        return self.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    @property
    def index(self) -> dict[str, DataFrame]:
        return index_tables(self.spark, self.dir, self.corpus)

    @property
    def occ(self) -> DataFrame:
        return self.index["postings"].select("term", "doc_id", F.explode("positions").alias("pos"))

    @property
    def tf(self) -> DataFrame:
        return self.index["postings"].select("term", "doc_id", "tf")

    @property
    def vocab(self) -> DataFrame:
        return self.index["vocabulary"].select("term", "cf", "df", "idf")

    @property
    def ids(self) -> DataFrame:
        return self.index["vocabulary"].select("term", "term_id")

    def weighted(self, tf: DataFrame) -> DataFrame:
        """term, doc_id, tf, weight of some postings, by the stored largest frequencies and idf."""
        top = self.index["documents"].select("doc_id", "top")
        return tf.join(self.vocab.select("term", "idf"), "term").join(top, "doc_id").select("term", "doc_id", "tf", (F.col("tf") / F.col("top") * F.col("idf")).alias("weight"))

    @property
    def weights(self) -> DataFrame:
        return self.weighted(self.tf)

    @property
    def asked(self) -> DataFrame:
        """Postings of the topics' terms alone."""
        return retrieval.narrow(self.tf, self.topics)

    @property
    def asked_places(self) -> DataFrame:
        """term, doc_id, pos of the topics' terms alone."""
        rows = retrieval.narrow(self.index["postings"].select("term", "doc_id", "positions"), self.topics)
        return rows.select("term", "doc_id", F.explode("positions").alias("pos"))

    @property
    def norms(self) -> DataFrame:
        return self.index["documents"].select("doc_id", "norm")

    @property
    def topics(self) -> DataFrame:
        return self.spark.createDataFrame([(i, t.split()) for i, t in TOPICS], "query_id int, terms array<string>")

    @property
    def counts(self) -> DataFrame:
        return self.index["vocabulary"].select("term", F.col("cf").alias("freq"))

    def ranking(self, similarity: Similarity) -> DataFrame:
        return retrieval.rank(self.topics, self.weighted(self.asked), self.vocab, self.norms, similarity)

    def run(self, similarity: Similarity = Similarity.COSINE) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
        return self.ranking(similarity).select("query_id", "doc_id", place.cast("long").alias("rank"))

    @property
    def qrels(self) -> DataFrame:
        """Of each topic's language, the documents that are labelled good."""
        good = self.labels.where("quality = 1").select("doc_id").distinct()
        languages = self.spark.createDataFrame(list(LANGUAGES.items()), "query_id int, lang string")
        return self.documents.select("doc_id", "lang").join(good, "doc_id").join(languages, "lang").select("query_id", "doc_id").distinct()

    @property
    def rp(self) -> DataFrame:
        return evaluation.precision_recall(self.run(), self.qrels)

    @property
    def page_edges(self) -> DataFrame:
        return graph.page_links(self.pages).select(F.col("url").alias("src"), F.col("link").alias("dst"))

    @property
    def trade(self) -> DataFrame:
        li = self.lineitem.select("l_orderkey", "l_suppkey").join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        li = li.join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return li.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg((F.count(F.lit(1)) * 1.0).alias("weight"))


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_parts(sql)
        return f

    return keep


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


# lexical analysis

query("tokenize", "SELECT doc_id, array_to_string(t, '|') AS tokens FROM tok")(lambda t: t.corpus.select("doc_id", joined(text.tokenize(F.col("text"))).alias("tokens")))
query("document_lines", "SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")(lambda t: t.corpus.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long")))
_STOP = ", ".join(f"'{w}'" for w in STOP)
query("stopword_filter", f"SELECT doc_id, array_to_string(list_filter(t, lambda x: x NOT IN ({_STOP})), '|') AS terms FROM tok")(lambda t: index.analysed(t.corpus, AnalyzerConfig(stopwords=STOP)).select("doc_id", joined(F.col("terms")).alias("terms")))
query("length_filter", "SELECT doc_id, array_to_string(list_filter(t, lambda x: length(x) BETWEEN 3 AND 23), '|') AS terms FROM tok")(lambda t: index.analysed(t.corpus, AnalyzerConfig(min_size=3, max_size=23)).select("doc_id", joined(F.col("terms")).alias("terms")))
query("analyse", f"SELECT doc_id, len(t) AS n_tokens, array_to_string(list_filter(t, lambda x: x NOT IN ({_STOP}) AND length(x) BETWEEN 3 AND 23), '|') AS terms FROM tok")(lambda t: index.analysed(t.corpus, AnalyzerConfig(stopwords=STOP, min_size=3, max_size=23)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), joined(F.col("terms")).alias("terms")))


@query("stem_es")
def _stems(t: Tables) -> DataFrame:
    return t.occ.select("term").distinct().select("term", stem_es("term").alias("stem"))


@query("regex_analyse")
def _regex_analyse(t: Tables) -> DataFrame:
    return index.analysed(t.corpus, AnalyzerConfig(regex=True)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), joined(F.col("terms")).alias("terms"))


#: Short texts with every extracted class, as the corpus lacks some of them.
SAMPLES = ["Dr. Paz vive en S.A.B. hoy", "a &nbsp; b &amp; c", "el 12/10/2011 y 5-6-99", "sube 12,5% y +-3%", "vale $4,60 o $12", "tel (0223) 4756953 o (011) 4555-1234 fin", "ver http://www.unlu.edu.ar/a?b=1 y www.sitio.com", "mail a juan.paz@mail.unlu.edu ya", "Juan Perez y Maria del Carmen", "12/10/2011 $3 (02) 44 x@y.co.ar Ana Paz"]


def _matches(name: str, classes: list[str]) -> None:
    def run(t: Tables) -> DataFrame:
        more = t.spark.createDataFrame([(-i, s) for i, s in enumerate(SAMPLES, 1)], "doc_id long, text string")
        rows = t.corpus.unionByName(more)
        left = F.col("text")
        found = []
        for c in classes:
            if c == "names":
                left = text.strip_accents(left)
            found.append(F.regexp_extract_all(left, F.lit(text.PATTERNS[c]), F.lit(0)))
            left = F.regexp_replace(left, text.PATTERNS[c], "")
        return rows.select("doc_id", joined(F.concat(*found)).alias("found"))

    pattern = lambda c: text.PATTERNS[c].replace("(?:www\\.|(?!www))", "").replace("'", "''")  # noqa: E731  no look-ahead in the check
    left, found = "x", []
    for c in classes:
        left = f"strip_accents({left})" if c == "names" else left
        found.append(f"regexp_extract_all({left}, '{pattern(c)}')")
        left = f"regexp_replace({left}, '{pattern(c)}', '', 'g')"
    rows = " UNION ALL ".join(f"SELECT {-i} AS doc_id, '{s}' AS x" for i, s in enumerate(SAMPLES, 1))
    array = found[0]
    for f in found[1:]:
        array = f"list_concat({array}, {f})"
    query(name, f"SELECT doc_id, array_to_string({array}, '|') AS found FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents UNION ALL {rows})")(run)


_matches("regex_abbreviations", ["abbreviations"])
_matches("regex_html_entities", ["entities", "entities_spaced"])
_matches("regex_numbers", ["dates", "percentages", "money", "phones"])
_matches("regex_urls", ["urls"])
_matches("regex_emails", ["emails"])
_matches("regex_proper_names", ["names"])
_matches("regex_tokens", list(text.PATTERNS))

# index

query("term_frequency", "SELECT term, doc_id, tf FROM tf")(lambda t: t.tf)
query("collection_frequency", "SELECT term, cf FROM voc")(lambda t: index.collection_frequency(t.tf))
query("document_frequency", "SELECT term, df FROM voc")(lambda t: index.document_frequency(t.tf))
query("positional_index", "SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM occ GROUP BY term, doc_id")(lambda t: index.positional_index(t.occ).select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")))
query("term_ids", "SELECT term, term_id FROM ids")(lambda t: t.ids)
query("index_build", "SELECT term_id, term, doc_id, tf, round(weight, 6) AS weight FROM w JOIN ids USING (term)")(lambda t: t.weights.join(t.ids, "term").select("term_id", "term", "doc_id", "tf", r6("weight")))
query("vocabulary_lookup", "SELECT a.term, coalesce(cf, 0) AS cf, coalesce(df, 0) AS df, round(coalesce(idf, 0), 6) AS idf FROM (VALUES ('the'), ('de'), ('nosuchterm')) a(term) LEFT JOIN voc USING (term)")(lambda t: index.lookup(t.vocab, t.spark.createDataFrame([("the",), ("de",), ("nosuchterm",)], "term string")).withColumn("idf", F.round("idf", 6)))
query("pointer_lookup", "WITH p AS (SELECT term, CAST(coalesce(sum(8 * df) OVER (ORDER BY term_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pointer FROM voc JOIN ids USING (term)) SELECT pointer, term, doc_id, tf FROM p JOIN tf USING (term) WHERE term IN ('the', 'der')")(lambda t: readers.postings_at(t.index, [r.pointer for r in t.index["vocabulary"].where("term in ('the', 'der')").select("pointer").collect()]))
query("corpus_stats", "SELECT n_docs, n_tokens, n_terms, round(n_tokens * 1.0e0 / n_docs, 6) AS tokens_per_doc, round(n_terms * 1.0e0 / n_docs, 6) AS terms_per_doc, round(a, 6) AS avg_term_length, n_hapax FROM (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens FROM tok), (SELECT count(*) AS n_terms, avg(length(term)) AS a, count(*) FILTER (cf = 1) AS n_hapax FROM voc)")(lambda t: index.corpus_stats(t.corpus))
_EXT = "SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM tok"
query("doc_extremes", f"SELECT * FROM (SELECT 'longest' AS kind, * FROM ({_EXT}) ORDER BY n_tokens DESC, doc_id DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'shortest' AS kind, * FROM ({_EXT}) ORDER BY n_tokens, doc_id DESC LIMIT 1)")(lambda t: index.doc_extremes(t.corpus))
query("idf", "SELECT term, df, round(idf, 6) AS idf FROM voc")(lambda t: t.vocab.select("term", "df", r6("idf")))
query("tf_idf", "SELECT term, doc_id, tf, round(weight, 6) AS weight FROM w")(lambda t: t.weights.select("term", "doc_id", "tf", r6("weight")))
query("doc_norms", "SELECT doc_id, round(norm, 6) AS norm FROM norms")(lambda t: t.norms.select("doc_id", r6("norm")))
query("postings_stats", "SELECT min(df) AS min_df, max(df) AS max_df, round(avg(df), 6) AS avg_df FROM voc")(lambda t: index.postings_stats(t.tf))
_LIST = "SELECT term_id, term_id || ':' || string_agg(doc_id || ',' || printf('%.6f', tf::DOUBLE) || ';', '' ORDER BY doc_id) AS line FROM tf JOIN ids USING (term) GROUP BY term_id"
query("postings_text", _LIST)(lambda t: index.postings_text(t.tf, t.ids))
query("postings_pointers", "SELECT term_id, df, CAST(coalesce(sum(8 * df) OVER (ORDER BY term_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pointer FROM voc JOIN ids USING (term)")(lambda t: index.postings_pointers(t.tf, t.ids))
query("index_overhead", f"SELECT c AS collection_bytes, i AS index_bytes, round(i * 100.0e0 / (c + i), 6) AS overhead_pct FROM (SELECT CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS c FROM documents), (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) AS i FROM ({_LIST}))")(lambda t: index.index_overhead(t.corpus, t.tf, t.ids))
query("posting_lookup", "SELECT term, doc_id, tf FROM tf WHERE term = 'the'")(lambda t: t.tf.where("term = 'the'"))
query("query_bow", "SELECT query_id, term, qtf FROM qt")(lambda t: retrieval.query_terms(t.topics))
query("query_bow_long", f"SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY 1, 2")(lambda t: retrieval.query_terms(t.benchmark.select(F.col("item_id").alias("query_id"), text.tokenize(F.coalesce("text", F.lit(""))).alias("terms"))))
query("dictionary_size", "SELECT count(*) AS n_terms, CAST(count(*) * (12 + floor(avg(length(term)))) AS BIGINT) AS n_bytes FROM voc")(lambda t: index.dictionary_size(t.vocab))
query("term_length_hist", "SELECT length(term) AS length, count(*) AS n_terms FROM voc GROUP BY 1")(lambda t: index.term_length_hist(t.vocab))
query("top_terms", "SELECT term, cf, df FROM voc ORDER BY cf DESC, df DESC, term LIMIT 10")(lambda t: index.top_terms(t.vocab))
query("bottom_terms", "SELECT term, cf, df FROM voc ORDER BY cf, df, term LIMIT 10")(lambda t: index.top_terms(t.vocab, most=False))

# boolean, phrase and proximity

query("bool_and", "SELECT query_id, doc_id FROM tf JOIN qt USING (term) JOIN qn USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n")(lambda t: retrieval.intersect(t.topics, t.asked))
query("bool_or", "SELECT query_id, doc_id FROM hits_or")(lambda t: retrieval.union(t.topics, t.asked))
query("bool_not", "SELECT query_id, d.doc_id FROM documents d, topics WHERE NOT EXISTS (SELECT 1 FROM hits_or h WHERE h.doc_id = d.doc_id AND h.query_id = topics.query_id)")(lambda t: retrieval.complement(t.topics, t.asked, t.corpus))
query("phrase", "SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, doc_id, pos - k AS s FROM occ JOIN (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS k, len(terms) AS n FROM topics) q USING (term) GROUP BY query_id, doc_id, s, n HAVING count(*) = n)")(lambda t: retrieval.phrase(t.topics, t.asked_places, t.asked))


def _near(name: str, distance: int) -> None:
    pairs = "SELECT query_id, list_filter(terms, lambda x, i: list_position(terms, x) = i) AS u FROM topics"
    query(name, f"SELECT DISTINCT query_id, a.doc_id FROM ({pairs}) q JOIN occ a ON a.term = u[1] JOIN occ b ON b.term = u[2] AND b.doc_id = a.doc_id WHERE abs(a.pos - b.pos) <= {distance}")(lambda t: retrieval.near(t.topics, t.asked_places, distance))


_near("prox_adjacent", retrieval.ADJACENT)
_near("prox_close_to", retrieval.CLOSE_TO)
_near("prox_n_terms", 20)

def _mixed_sql() -> str:
    terms = {1: ["the", "of"], 2: ["nosuchterm", "der"], 3: ["the", "of"], 4: ["de", "la"], 5: ["the", "of"], 6: ["und", "der"], 7: ["and", "the"], 8: ["que"]}
    have = lambda x: f"SELECT doc_id FROM tf WHERE term = '{x}'"
    close = lambda a, b, d: f"SELECT a.doc_id FROM occ a JOIN occ b USING (doc_id) WHERE a.term = '{a}' AND b.term = '{b}' AND abs(a.pos - b.pos) <= {d}"
    answers = {
        1: f"{have('the')} INTERSECT {have('of')}", 2: f"{have('nosuchterm')} UNION {have('der')}", 3: f"SELECT doc_id FROM documents EXCEPT ({have('the')} UNION {have('of')})",
        4: "SELECT a.doc_id FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'de' AND b.term = 'la'",
        5: close(*terms[5], 5), 6: close(*terms[6], 20), 7: close(*terms[7], 1), 8: have("que"),
    }
    return " UNION ALL ".join(f"SELECT {i} AS query_id, doc_id FROM (SELECT DISTINCT doc_id FROM ({x}))" for i, x in answers.items())


@query("retrieve_mixed", _mixed_sql())
def _mixed(t: Tables) -> DataFrame:
    asked = readers.parsed_queries(t.spark, TITLES).select("query_id", "op", "distance", "terms")
    rows = retrieval.narrow(t.index["postings"].select("term", "doc_id", "tf", "positions"), asked)
    return retrieval.retrieve(asked, rows.select("term", "doc_id", F.explode("positions").alias("pos")), rows.select("term", "doc_id", "tf"), t.corpus)


query("idvector_or", "SELECT DISTINCT query_id, doc_id AS vec_id FROM tf JOIN qt USING (term)")(lambda t: retrieval.idvector_union(t.asked.join(t.ids, "term").select(F.col("doc_id").alias("vec_id"), "term_id"), retrieval.query_terms(t.topics).join(t.ids, "term").select("query_id", "term_id")))

# ranking

query("query_weights", "SELECT query_id, term, round(qweight, 6) AS qweight FROM qw")(lambda t: retrieval.query_weights(t.topics, t.vocab).select("query_id", "term", r6("qweight")))
query("rank_scalar", "SELECT query_id, doc_id, round(sp, 6) AS score FROM sp")(lambda t: t.ranking(Similarity.SCALAR).select("query_id", "doc_id", r6("score")))
query("rank_cosine", "SELECT query_id, doc_id, round(score, 6) AS score FROM cosine")(lambda t: t.ranking(Similarity.COSINE).select("query_id", "doc_id", r6("score")))
query("rank_jaccard", "SELECT query_id, doc_id, round(sp / (norm * norm + qn * qn - sp), 6) AS score FROM scored WHERE norm * norm + qn * qn - sp <> 0")(lambda t: t.ranking(Similarity.JACCARD).select("query_id", "doc_id", r6("score")))
query("rank_dice", "SELECT query_id, doc_id, round(score, 6) AS score FROM dice")(lambda t: t.ranking(Similarity.DICE).select("query_id", "doc_id", r6("score")))
_TAAT = "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM {}) WHERE rank <= 10"
query("taat_topk", _TAAT.format("summed"))(lambda t: retrieval.term_at_a_time(t.topics, t.weighted(t.asked), 10).select("query_id", "doc_id", "rank", r6("score")))
_DAAT = "(SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM summed WHERE score > 0) WHERE k <= 10)"
query("daat_topk", _TAAT.format(_DAAT))(lambda t: retrieval.document_at_a_time(t.topics, t.weighted(t.asked), 10).select("query_id", "doc_id", "rank", r6("score")))
query("taat_equals_daat", "SELECT DISTINCT query_id, true AS same FROM summed")(lambda t: retrieval.same_results(retrieval.term_at_a_time(t.topics, t.weighted(t.asked), 1 << 30).where("score > 0"), retrieval.document_at_a_time(t.topics, t.weighted(t.asked), 1 << 30)))
query("ranking_file", "SELECT query_id, doc_id, rank, query_id || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.6f', s) || ' COSINE' AS line FROM (SELECT query_id, doc_id, round(score, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM cosine)")(lambda t: sinks.q0_lines(t.ranking(Similarity.COSINE), "COSINE"))
query("idvector_cosine", "WITH v AS (SELECT DISTINCT doc_id AS vec_id, term FROM occ), d AS (SELECT query_id, vec_id, sum(idf * idf) AS dp FROM v JOIN qt USING (term) JOIN voc USING (term) GROUP BY 1, 2), vn AS (SELECT vec_id, sqrt(sum(idf * idf)) AS vn FROM v JOIN voc USING (term) GROUP BY 1), un AS (SELECT query_id, sqrt(sum(idf * idf)) AS un FROM qt JOIN voc USING (term) GROUP BY 1) SELECT query_id, vec_id, round(dp, 6) AS dp, round(dp / (vn * un), 6) AS cosine FROM d JOIN vn USING (vec_id) JOIN un USING (query_id) WHERE dp > 0")(
    lambda t: retrieval.idvector_rank(t.tf.join(t.ids, "term").select(F.col("doc_id").alias("vec_id"), "term_id"), retrieval.query_terms(t.topics).join(t.ids, "term").select("query_id", "term_id"), t.vocab.join(t.ids, "term").select("term_id", "idf")).select("query_id", "vec_id", r6("dp"), r6("cosine"))
)

# laws

query("zipf_rank", "SELECT term, freq, rank, freq * rank AS c FROM zr")(lambda t: laws.zipf_rank(t.counts))
query("zipf_cumulative", "SELECT term, freq, cum, round(freq * 1.0e0 / total, 9) AS rel, round(cum * 1.0e0 / total, 9) AS cum_rel FROM zc")(lambda t: laws.zipf_cumulative(t.counts).select("term", "freq", "cum", F.round("rel", 9).alias("rel"), F.round("cum_rel", 9).alias("cum_rel")))
query("zipf_prune", "SELECT share, term, freq FROM zc, (VALUES (5), (10), (15)) s(share) WHERE cum * 1.0e0 / total BETWEEN share / 200.0e0 AND 1 - share / 200.0e0")(lambda t: _pruned(t))


def _pruned(t: Tables) -> DataFrame:
    cumulative = laws.zipf_cumulative(t.counts)
    parts = [laws.zipf_prune(cumulative, s / 100).select(F.lit(s).alias("share"), "term", "freq") for s in (5, 10, 15)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


query("zipf_fit", "SELECT round(m, 6) AS slope, round(b, 6) AS intercept, round(r2, 6) AS r2 FROM fit")(lambda t: laws.zipf_fit(laws.zipf_rank(t.counts)).select(r6("slope"), r6("intercept"), r6("r2")))
query("zipf_constant_summary", 'WITH c AS (SELECT freq * rank AS c FROM zr) SELECT count(*) AS n, round(avg(c), 4) AS mean, round(stddev_samp(c), 4) AS std, min(c) AS min, quantile_cont(c, 0.25) AS p25, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.75) AS p75, max(c) AS max FROM c')(lambda t: laws.zipf_constant_summary(laws.zipf_rank(t.counts)).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)}))
query("freq_lt5_share", "SELECT round((1 - min(cum * 1.0e0 / total)) * 100, 6) AS share FROM zc WHERE freq < 5")(lambda t: laws.omitted_share(laws.zipf_cumulative(t.counts)).select(r6("share")))
query("zipf_predicted_share", "SELECT round((1 - min(cum * 1.0e0 / zc.total)) * 100, 6) AS share FROM zc JOIN zr USING (term), fit WHERE rank > exp((ln(5.0e0) - b) / m)")(lambda t: laws.predicted_share(laws.zipf_rank(t.counts), laws.zipf_cumulative(t.counts)).select(r6("share")))
query("zipf_predict", "SELECT rank, round(exp(m * ln(rank) + b), 4) AS freq FROM fit, (VALUES (1), (10), (100), (1000)) v(rank)")(lambda t: laws.predicted_frequency(laws.zipf_fit(laws.zipf_rank(t.counts)), [1, 10, 100, 1000]).select("rank", F.round("freq", 4).alias("freq")))
_HEAPS = "CAST(sum(n) OVER w2 AS BIGINT) AS n_tokens, CAST(sum(k) OVER w2 AS BIGINT) AS n_terms"
query("heaps_curve", f"SELECT doc_id, {_HEAPS} FROM heaps WINDOW w2 AS (ORDER BY doc_id)")(lambda t: laws.heaps_curve(t.occ))
query("heaps_tokens", "SELECT doc_id, pos, CAST(sum(f) OVER (ORDER BY doc_id, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_terms FROM (SELECT doc_id, pos, (row_number() OVER (PARTITION BY term ORDER BY doc_id, pos) = 1)::INT AS f FROM occ)")(lambda t: laws.heaps_tokens(t.occ).withColumn("pos", F.col("pos").cast("long")))
query("heaps_estimate", "SELECT doc_id, n_tokens, round(10 * pow(n_tokens, 0.6e0), 4) AS estimate FROM (SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS n_tokens FROM heaps)")(lambda t: laws.heaps_estimate(laws.heaps_curve(t.occ)).withColumn("estimate", F.round("estimate", 4)))
query("heaps_incremental", "WITH o AS (SELECT term, doc_id, doc_id % 3 AS stage FROM occ), f AS (SELECT term, min((stage, doc_id)) AS first FROM o GROUP BY term), s AS (SELECT stage, doc_id, count(*) AS n FROM o GROUP BY 1, 2), k AS (SELECT first[1] AS stage, first[2] AS doc_id, count(*) AS k FROM f GROUP BY 1, 2) SELECT stage, doc_id, CAST(sum(n) OVER w2 AS BIGINT) AS n_tokens, CAST(sum(coalesce(k, 0)) OVER w2 AS BIGINT) AS n_terms FROM s LEFT JOIN k USING (stage, doc_id) WINDOW w2 AS (PARTITION BY stage ORDER BY doc_id)")(lambda t: laws.heaps_curve(t.occ.withColumn("stage", F.col("doc_id") % 3), "stage"))

# evaluation

query("precision_recall", "SELECT query_id, rank, doc_id, rel, hits, total, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")(lambda t: t.rp.select("query_id", "rank", "doc_id", "rel", "hits", "total", r6("precision"), r6("recall")))
_LEVELS = "WITH best AS (SELECT query_id, (10 * hits) // total AS level, max(precision) AS p FROM pr GROUP BY 1, 2), lv AS (SELECT query_id, level FROM (SELECT DISTINCT query_id FROM pr), range(11) r(level)), lp AS (SELECT lv.query_id, lv.level, p FROM lv LEFT JOIN best USING (query_id, level)), ip AS (SELECT query_id, level, coalesce(first_value(p IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(p IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS precision FROM lp) "
query("eval_interpolated", _LEVELS + "SELECT query_id, level, round(precision, 6) AS precision FROM ip")(lambda t: evaluation.interpolated(t.rp).select("query_id", F.col("level").cast("long").alias("level"), r6("precision")))
query("eval_stats", "SELECT query_id, count(*) AS retrieved, max(total) AS relevant, CAST(sum(rel) AS BIGINT) AS relevant_retrieved, round(sum(precision) FILTER (rel = 1) / nullif(sum(rel), 0), 6) AS ap_ref, round(coalesce(sum(precision) FILTER (rel = 1), 0) / max(total), 6) AS ap, round(arg_max(precision, rank) FILTER (rank <= total), 6) AS r_precision FROM pr GROUP BY query_id")(lambda t: evaluation.stats(t.rp).select("query_id", "retrieved", "relevant", "relevant_retrieved", r6("ap_ref"), r6("ap"), r6("r_precision")))
query("eval_macro", "SELECT rank, count(*) AS n_queries, round(avg(precision), 6) AS precision FROM pr GROUP BY rank")(lambda t: evaluation.macro(t.rp).select("rank", "n_queries", r6("precision")))
query("eval_micro", "SELECT rank, CAST(sum(n) OVER o AS BIGINT) AS retrieved, CAST(sum(r) OVER o AS BIGINT) AS hits, round(sum(r) OVER o * 1.0e0 / sum(n) OVER o, 6) AS precision, round(sum(r) OVER o * 1.0e0 / (SELECT sum(total) FROM (SELECT DISTINCT query_id, total FROM pr)), 6) AS recall FROM (SELECT rank, count(*) AS n, sum(rel) AS r FROM pr GROUP BY rank) WINDOW o AS (ORDER BY rank)")(lambda t: evaluation.micro(t.rp).select("rank", "retrieved", "hits", r6("precision"), r6("recall")))
query("run_topn", "SELECT query_id, doc_id, rank FROM run WHERE rank <= 25")(lambda t: evaluation.top_n(t.run(), 25))


@query("spearman_topk", "WITH a AS (SELECT n, query_id, doc_id, rank AS ra FROM run, (VALUES (10), (25), (50)) v(n) WHERE rank <= n), b AS (SELECT n, query_id, doc_id, rank AS rb FROM run2, (VALUES (10), (25), (50)) v(n) WHERE rank <= n), f AS (SELECT n, query_id, coalesce(ra, max(ra) OVER q + 1) AS ra, coalesce(rb, max(rb) OVER q + 1) AS rb FROM a FULL JOIN b USING (n, query_id, doc_id) WINDOW q AS (PARTITION BY n, query_id)), g AS (SELECT n, query_id, count(*) AS n_docs, sum((ra - rb) * (ra - rb)) AS d2 FROM f GROUP BY 1, 2) SELECT n, query_id, n_docs, round(CASE WHEN d2 = 0 OR (n_docs - 1) * ((n_docs - 1) * (n_docs - 1) - 1) = 0 THEN 1 ELSE 1 - 6.0e0 * d2 / ((n_docs - 1) * ((n_docs - 1) * (n_docs - 1) - 1)) END, 6) AS rho FROM g")
def _spearman(t: Tables) -> DataFrame:
    a, b = t.run(), t.run(Similarity.DICE)
    parts = [evaluation.spearman(a, b, n).select(F.lit(n).alias("n"), "query_id", "n_docs", r6("rho")) for n in (10, 25, 50)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OTHER = _LEVELS.removeprefix("WITH ").replace("best", "best2").replace("lv", "lv2").replace("lp", "lp2").replace("ip ", "ip2 ").replace("pr ", "pr_dice ").replace("pr)", "pr_dice)")


@query("model_comparison", _LEVELS.rstrip() + ", " + _OTHER + "SELECT level, a.cosine, b.dice FROM (SELECT level, round(avg(precision), 6) AS cosine FROM ip GROUP BY level) a JOIN (SELECT level, round(avg(precision), 6) AS dice FROM ip2 GROUP BY level) b USING (level)")
def _models(t: Tables) -> DataFrame:
    out = evaluation.compare_models({"cosine": evaluation.interpolated(t.rp), "dice": evaluation.interpolated(evaluation.precision_recall(t.run(Similarity.DICE), t.qrels))})
    return out.select(F.col("level").cast("long").alias("level"), r6("cosine"), r6("dice"))


@query("normalize_doc_ids", "WITH own AS (SELECT doc_id, 'd' || doc_id // 2 AS name FROM documents), ext AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'd0' ELSE 'd' || doc_id END AS name, min(doc_id) + 1000000000 AS new_id FROM documents GROUP BY 1 HAVING count(*) = 1) SELECT query_id, coalesce(new_id, r.doc_id) AS doc_id, rank FROM run r LEFT JOIN own o ON o.doc_id = r.doc_id LEFT JOIN ext e ON e.name = o.name")
def _normalised(t: Tables) -> DataFrame:
    """Names: documents come in twos of one name; of the other side's, two in three are unique at every size."""
    name = lambda x: F.concat(F.lit("d"), x.cast("string"))
    own = t.corpus.select("doc_id", name(F.floor(F.col("doc_id") / 2)).alias("name"))
    external = t.corpus.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "d0").otherwise(name(F.col("doc_id"))).alias("name"))
    return evaluation.normalise_doc_ids(t.run(), own, external).select("query_id", "doc_id", "rank")


# postings layout and codes

query("dgaps", "SELECT term, doc_id, gap FROM gaps")(lambda t: postings.dgaps(t.tf))
query("dgaps_decode", "SELECT term, k, doc_id FROM (SELECT term, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS k, doc_id FROM tf)")(lambda t: postings.undo_dgaps(postings.dgaps(t.tf).withColumn("k", F.row_number().over(W.partitionBy("term").orderBy("doc_id")).cast("long")), "k"))
query("skip_lists", "WITH l AS (SELECT term, list(doc_id ORDER BY doc_id) AS d, count(*) AS n FROM tf GROUP BY term), p AS (SELECT term, d, n, CASE WHEN n < 2 THEN n ELSE floor(sqrt(n))::BIGINT + 1 END AS k FROM l), e AS (SELECT term, d, unnest(range(k)) AS entry, n // k AS step FROM p) SELECT term, entry, d[(entry + 1) * step] AS doc_id, (entry + 1) * step - 1 AS idx FROM e")(lambda t: postings.skip_lists(t.tf))
_BIN = "CASE WHEN {0} >= 0 THEN ltrim(bin({0}::BIGINT), '0') END"
_G = _BIN.format("(gap + 1)")
query("elias_gamma", f"SELECT term, doc_id, repeat('1', length(b) - 1) || '0' || substr(b, 2) AS bits FROM (SELECT term, doc_id, {_G} AS b FROM gaps)")(lambda t: postings.dgaps(t.tf).select("term", "doc_id", codes.gamma_encode(F.col("gap") + 1).alias("bits")))
query("vbyte", f"WITH g AS (SELECT term, doc_id, {_G} AS b FROM gaps), p AS (SELECT term, doc_id, lpad(b, ((length(b) + 6) // 7 * 7)::INT, '0') AS b FROM g) SELECT term, doc_id, array_to_string([CASE WHEN i = length(b) // 7 - 1 THEN '1' ELSE '0' END || substr(b, i * 7 + 1, 7) FOR i IN range(length(b) // 7)], '') AS bits FROM p")(lambda t: postings.dgaps(t.tf).select("term", "doc_id", codes.vbyte_encode(F.col("gap") + 1).alias("bits")))
query("compression_size", f"SELECT round(sum(2 * length(b) - 1) / 8000.0e0, 6) AS gamma_kb, round(sum(8 * ((length(b) + 6) // 7)) / 8000.0e0, 6) AS vbyte_kb FROM (SELECT {_G} AS b FROM gaps)")(lambda t: postings.compression_size(postings.dgaps(t.tf)))
query("binary_codes", f"SELECT k, b AS plain, lpad(b, 24, '0') AS fixed, substr(b, 2) AS headless, repeat('0', length(b) - 1) || b AS calpha FROM (SELECT df AS k, {_BIN.format('df')} AS b FROM (SELECT DISTINCT df FROM voc))")(lambda t: t.vocab.select(F.col("df").alias("k")).distinct().select("k", F.bin("k").alias("plain"), codes.fixed_width(F.col("k"), 24).alias("fixed"), codes.headless(F.col("k")).alias("headless"), codes.calpha_encode(F.col("k")).alias("calpha")))


def _roundtrip(name: str, column: str, decode) -> None:
    def run(t: Tables) -> DataFrame:
        back = postings.compressed(postings.dgaps(t.tf)).select("term", F.posexplode(decode(column)).alias("k", "v"))
        gaps = back.select("term", F.col("k"), (F.col("v") - 1).alias("gap"))
        return postings.undo_dgaps(gaps, "k").select("term", (F.col("k") + 1).cast("long").alias("k"), "doc_id")

    query(name, "SELECT term, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS k, doc_id FROM tf")(run)


_roundtrip("elias_gamma_roundtrip", "gamma", codes.gamma_decode)
_roundtrip("vbyte_roundtrip", "vbyte", codes.vbyte_decode)

# web graph

query("page_links", "SELECT page_id, place, link FROM full_links")(lambda t: graph.page_links(t.pages).select("page_id", F.col("at").cast("long").alias("place"), "link"))
query("outdegree", "SELECT url AS src, count(DISTINCT link) AS n_links FROM full_links GROUP BY url")(lambda t: graph.out_degree(graph.page_links(t.pages).select(F.col("url").alias("src"), F.col("link").alias("dst"))))


@query("crawl_bfs", "WITH RECURSIVE bfs(url, depth) AS (SELECT min(url), 0 FROM pages UNION SELECT p.dst, b.depth + 1 FROM bfs b JOIN plinks p ON p.src = b.url WHERE b.depth < 12), near AS (SELECT url, min(depth) AS depth FROM bfs GROUP BY url) SELECT url, depth, id FROM (SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS id FROM near) WHERE id <= 50")
def _crawl(t: Tables) -> DataFrame:
    """From one page on, breadth first, until 50 addresses are known: the limit is the crawler's own."""
    return graph.crawl(t.page_edges, t.pages.agg(F.min("url").alias("url")), max_urls=50)


@query("graph_ids", "WITH n AS (SELECT node, row_number() OVER (ORDER BY node) AS id FROM (SELECT src AS node FROM plinks UNION SELECT dst FROM plinks)) SELECT a.id AS src, b.id AS dst, a.id || ': ' || a.node AS line FROM plinks JOIN n a ON a.node = src JOIN n b ON b.node = dst")
def _graph_ids(t: Tables) -> DataFrame:
    nodes, edges = graph.with_ids(t.page_edges.distinct())
    lines = sinks.id_url_lines(nodes).select(F.split("value", ": ", 2)[0].cast("long").alias("src"), F.col("value").alias("line"))
    return edges.join(lines, "src").select("src", "dst", "line")


def _pagerank_sql(table: str, rounds: int, rsp: str = "0.15e0") -> str:
    ctes = [f"WITH nodes AS (SELECT src AS node FROM {table} UNION SELECT dst FROM {table})", "cnt AS (SELECT count(*) AS n FROM nodes)", f"p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM {table})", "r0 AS (SELECT node, 1.0e0 / n AS r FROM nodes, cnt)"]
    for i in range(rounds):
        ctes.append(f"r{i + 1} AS (SELECT nodes.node, (coalesce(c, 0) + l / n) * (1 - {rsp}) + {rsp} / n AS r FROM nodes LEFT JOIN (SELECT dst AS node, sum(p * r) AS c FROM p JOIN r{i} ON r{i}.node = p.src GROUP BY dst) USING (node), cnt, (SELECT coalesce(sum(r), 0) AS l FROM r{i} WHERE node NOT IN (SELECT src FROM p)))")
    return ", ".join(ctes) + f" SELECT node, round(r, 9) AS rank FROM r{rounds}"


query("pagerank", _pagerank_sql("plinks", 5))(lambda t: graph.page_rank(t.page_edges.distinct().withColumn("weight", F.lit(1.0)), epsilon=None, iterations=5).select("node", F.round("rank", 9).alias("rank")))
query("pagerank_weighted", _pagerank_sql("trade", 5))(lambda t: graph.page_rank(t.trade, epsilon=None, iterations=5).select("node", F.round("rank", 9).alias("rank")))
