"""Operators over a corpus of five small documents, with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tesela.config import AnalyzerConfig, Similarity
from tesela.functions import stem_es, text
from tesela.operators import evaluation, graph, index, laws, postings, retrieval

DOCS = [(1, "El gato come. El gato duerme"), (2, "La casa del gato"), (3, "casa casa casa"), (4, ""), (5, "Ñandú: come-pasto §1 e-mail")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def queries(spark, *terms, **more):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(terms, 1)], "query_id int, terms array<string>").withColumns({k: F.lit(v) for k, v in more.items()})


def pairs(df):
    return sorted(map(tuple, df.select("query_id", "doc_id").collect()))


def test_tokens(corpus):
    got = {r.doc_id: r.t for r in corpus.select("doc_id", text.tokenize(F.col("text")).alias("t")).collect()}
    assert got == {1: ["el", "gato", "come", "el", "gato", "duerme"], 2: ["la", "casa", "del", "gato"], 3: ["casa"] * 3, 4: [], 5: ["nandu", "comepasto", "1", "email"]}


def test_exact_accents(spark):
    df = spark.createDataFrame([("Ầbc ẞ ﬁ",)], "t string")
    assert df.select(text.tokenize(F.col("t"), exact=True)).first()[0] == ["abc", "ß", "fi"]


def test_stop_words_close_gaps(corpus):
    occ = index.occurrences(corpus, AnalyzerConfig(stopwords=("El", "la")))
    assert [(r.pos, r.term) for r in occ.where("doc_id = 1").orderBy("pos").collect()] == [(0, "gato"), (1, "come"), (2, "gato"), (3, "duerme")]


def test_stemming_before_length(spark):
    df = spark.createDataFrame([(1, "universidad nacional facultad de function")], "doc_id long, text string")
    got = index.occurrences(df, AnalyzerConfig(stem="spanish", min_size=7)).orderBy("pos").collect()
    assert [(r.pos, r.term) for r in got] == [(0, "univers"), (1, "nacional"), (2, "function")]


@pytest.mark.parametrize(("word", "want"), [("universidad", "univers"), ("facultad", "facult"), ("raquo", "raqu"), ("000000border", "000000bord"), ("nacional", "nacional"), ("function", "function"), ("var", "var")])
def test_stems(word, want):
    assert stem_es.stem(word) == want


def test_patterns_take_turns(spark):
    df = spark.createDataFrame([(1, "Ver 12/10/2011 y $4,60.\nJuan Perez &nbsp; escribe a j.p@mail.unlu.edu hoy")], "doc_id long, text string")
    r = index.analysed(df, AnalyzerConfig(regex=True)).first()
    assert {"12/10/2011", "$4,60", "Juan Perez", "j.p@mail.unlu.edu"} <= set(r.terms) and "&nbsp;" in r.tokens and "&nbsp;" not in r.terms
    assert r.terms.index("y") < r.terms.index("12/10/2011") < r.terms.index("escribe")


def test_weights(spark, corpus):
    tf = index.term_frequency(index.occurrences(corpus))
    vocab = index.vocabulary(tf, index.n_documents(corpus))
    w = {(r.term, r.doc_id): r.weight for r in index.tf_idf(tf, vocab).collect()}
    assert w["gato", 1] == pytest.approx(math.log(5 / 2)) and w["come", 1] == pytest.approx(0.5 * math.log(5)) and w["casa", 3] == pytest.approx(math.log(5 / 2))
    norms = {r.doc_id: r.norm for r in index.doc_norms(index.tf_idf(tf, vocab), corpus).collect()}
    assert norms[4] == 0 and norms[3] == pytest.approx(math.log(5 / 2))
    cosine = retrieval.rank(queries(spark, ["casa"], ["gato", "nada"]), index.tf_idf(tf, vocab), vocab, index.doc_norms(index.tf_idf(tf, vocab), corpus), Similarity.COSINE)
    got = {(r.query_id, r.doc_id): r.score for r in cosine.collect()}
    assert got[1, 3] == pytest.approx(1) and all(0 <= s <= 1 + 1e-9 for s in got.values()) and set(got) == {(1, 2), (1, 3), (2, 1), (2, 2)}


def test_boolean(spark, corpus):
    occ = index.occurrences(corpus)
    tf = index.term_frequency(occ)
    q = queries(spark, ["gato", "casa"], ["gato", "nada"], ["gato"], [])
    assert pairs(retrieval.intersect(q, tf)) == [(1, 2), (3, 1), (3, 2)]
    assert pairs(retrieval.union(q, tf)) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert pairs(retrieval.complement(q, tf, corpus)) == [(1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 3), (3, 4), (3, 5)]


def test_phrase_and_distance(spark, corpus):
    occ = index.occurrences(corpus)
    tf = index.term_frequency(occ)
    assert pairs(retrieval.phrase(queries(spark, ["el", "gato", "duerme"], ["gato", "el"], ["casa"], ["del", "nada"]), occ, tf)) == [(1, 1), (3, 2), (3, 3)]
    q = queries(spark, ["el", "come"], ["la", "gato"], ["casa", "casa"])
    assert pairs(retrieval.near(q, occ, 1)) == [(1, 1)]
    assert pairs(retrieval.near(q, occ, 3)) == [(1, 1), (2, 2)]
    assert pairs(retrieval.near(q, occ, 1, "left")) == [(1, 1)] and pairs(retrieval.near(q, occ, 1, "right")) == [] and pairs(retrieval.near(q, occ, 2, "right")) == [(1, 1)]
    assert pairs(retrieval.near(q, occ, 0)) == []


def test_top_k_ties(spark):
    weights = spark.createDataFrame([("t", d, 1, float(s)) for d, s in [(1, 2), (2, 2), (3, 2), (4, 5), (5, 0)]], "term string, doc_id long, tf long, weight double")
    q = queries(spark, ["t"])
    assert [r.doc_id for r in retrieval.term_at_a_time(q, weights, 2).orderBy("rank").collect()] == [4, 3]
    assert [r.doc_id for r in retrieval.document_at_a_time(q, weights, 2).orderBy("rank").collect()] == [4, 1]


def test_evaluation(spark):
    run = spark.createDataFrame([(1, d, r) for r, d in enumerate([10, 11, 12, 13], 1)], "query_id int, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 10), (1, 12), (1, 99)], "query_id int, doc_id long")
    rp = evaluation.precision_recall(run, qrels)
    s = evaluation.stats(rp).first()
    assert (s.retrieved, s.relevant, s.relevant_retrieved) == (4, 3, 2) and s.ap_ref == pytest.approx((1 + 2 / 3) / 2) and s.ap == pytest.approx((1 + 2 / 3) / 3) and s.r_precision == pytest.approx(2 / 3)
    levels = [r.precision for r in evaluation.interpolated(rp).orderBy("level").collect()]
    assert levels[:4] == pytest.approx([1, 1, 1, 1]) and levels[4:] == pytest.approx([2 / 3] * 7)


def test_spearman(spark):
    run = lambda docs: spark.createDataFrame([(1, d, r) for r, d in enumerate(docs, 1)], "query_id int, doc_id long, rank long")
    assert evaluation.spearman(run([1, 2, 3]), run([1, 2, 3]), 3).first().rho == 1
    got = evaluation.spearman(run([1, 2, 3]), run([1, 2, 4]), 3).first()
    assert got.n_docs == 4 and got.rho == pytest.approx(1 - 6 * 2 / (3 * 8))


def test_page_rank(spark):
    rows = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src int, dst int, weight double")
    got = {r.node: r.rank for r in graph.page_rank(edges).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[3] == pytest.approx(0.15 / 4) and max(got, key=got.get) == 2


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "a"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert [(r.url, r.depth) for r in graph.crawl(edges, seeds, 4).orderBy("id").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://h.org/d/p.html", "<a href='/x'>1</a><a class=k href=\"y.html\">2</a><a href='#f'>3</a><a>4</a><A HREF=http://o.net/z>5</A><a href='mailto:a@b'>6</a>")], "page_id long, url string, html string")
    assert [r.link for r in graph.page_links(pages).orderBy("at").collect()] == ["http://h.org/x", "http://h.org/d/y.html", "http://o.net/z", "mailto:a@b"]


def test_skip_lists(spark):
    for n in (1, 2, 3, 10, 50):
        df = spark.createDataFrame([("t", d) for d in range(1, n + 1)], "term string, doc_id long")
        rows = postings.skip_lists(df).orderBy("entry").collect()
        k = n if n < 2 else int(math.sqrt(n)) + 1
        assert [r.idx for r in rows] == [(i + 1) * (n // k) - 1 for i in range(k)] and all(r.doc_id == r.idx + 1 for r in rows)


def test_zipf_and_heaps(spark, corpus):
    occ = index.occurrences(corpus)
    counts = occ.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    ranks = {r.term: r["rank"] for r in laws.zipf_rank(counts).collect()}
    assert ranks["casa"] == 1 and ranks["gato"] == 2 and ranks["el"] == 3 and ranks["come"] == 4
    curve = [(r.doc_id, r.n_tokens, r.n_terms) for r in laws.heaps_curve(occ).orderBy("doc_id").collect()]
    assert curve == [(1, 6, 4), (2, 10, 7), (3, 13, 7), (5, 17, 11)]
    assert [r.n_terms for r in laws.heaps_tokens(occ).orderBy("doc_id", "pos").collect()][:6] == [1, 2, 3, 3, 3, 4]
