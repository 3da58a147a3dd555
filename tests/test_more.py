"""Readers, writers, stored indexes, codes of large numbers and streams over literal data."""

from pyspark.sql import functions as F

from tesela.config import AnalyzerConfig, Similarity
from tesela.functions import codes, text
from tesela.operators import evaluation, graph, index, postings, retrieval
from tesela.sources import readers, sinks
from tesela.streaming import growth


def values(df):
    return [r.value for r in df.collect()]


def test_text_between_markers(spark):
    df = spark.createDataFrame([("head <b>body</b> tail",), ("no markers",), ("<b>open",)], "t string")
    assert [r.x for r in df.select(readers.between_markers(F.col("t"), "<b>", "</b>").alias("x")).collect()] == ["body", "no markers", "open"]


def test_word_lists(spark, tmp_path):
    (tmp_path / "w").write_text("la el\n\nde  la\n")
    assert readers.stop_words(spark, str(tmp_path / "w")) == ("de", "el", "la") and readers.stop_words(spark, "") == ()
    (tmp_path / "v").write_text("uno\ndos\nuno\n\n")
    assert sorted(r.word for r in readers.vocabulary_words(spark, str(tmp_path / "v")).collect()) == ["dos", "uno"]


def test_queries_and_judgments(spark, tmp_path):
    assert [tuple(r) for r in readers.queries_from_list(spark, ["a", "b", "-1", "c"]).collect()] == [(1, "a"), (2, "b")]
    (tmp_path / "j").write_text("Query 1: (7, 9)\n")
    assert sorted(map(tuple, readers.judgments(spark, str(tmp_path / "j")).collect())) == [(1, 7), (1, 9)]


def test_lines_of_an_index(spark):
    vocab = spark.createDataFrame([("b", 3, 2), ("a", 1, 1)], "term string, cf long, df long")
    assert values(sinks.term_lines(vocab)) == ["a - 1 - 1", "b - 3 - 2"]
    names = spark.createDataFrame([(1, "x.html"), (2, "y.html")], "doc_id long, name string")
    assert sorted(values(sinks.id_name_lines(names))) == ["1 x.html", "2 y.html"]
    tf = spark.createDataFrame([("b", 1, 2), ("a", 1, 1), ("a", 2, 1)], "term string, doc_id long, tf long")
    assert sorted(map(tuple, sinks.doc_terms(tf).collect())) == [(1, "a b"), (2, "a")]
    found = spark.createDataFrame([(1, 2), (1, 1)], "query_id int, doc_id long")
    assert sorted(values(sinks.result_lines(found, names))) == ["Rank 1: x.html", "Rank 2: y.html"]


def test_reports(spark, tmp_path):
    per_query = spark.createDataFrame([(1, 4, 3, 2, 0.5, 0.25, 1.0), (2, 6, 5, 4, 1.0, 0.75, 0.0)], "query_id int, retrieved long, relevant long, relevant_retrieved long, ap_ref double, ap double, r_precision double")
    macro = evaluation.macro_stats(per_query)
    assert macro.first().asDict() == {"retrieved": 10, "relevant": 8, "relevant_retrieved": 6, "ap_ref": 0.75, "ap": 0.5, "r_precision": 0.5}
    levels = spark.createDataFrame([(1, 0.25), (0, 0.5)], "level int, precision double")
    lines = values(sinks.evaluation_lines(macro, levels))
    assert lines[:2] == ["retrieved: 10", "relevant: 8"] and lines[-2:] == ["Precision at 0% : 0.5000", "Precision at 10% : 0.2500"]
    sinks.write_csv(levels, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_gap_skips_and_bulk_load(spark):
    df = spark.createDataFrame([("t", d) for d in (3, 7, 20, 21)], "term string, doc_id long")
    assert [(r.entry, r.doc_id, r.idx) for r in postings.skip_lists_for_gaps(df).orderBy("entry").collect()] == [(0, 0, 0), (1, 3, 1), (2, 7, 2)]
    dump = spark.createDataFrame([("b", [5, 2]), ("a", [9, 1, 4])], "term string, docs array<long>")
    rows = postings.bulk_load(dump).orderBy("term").collect()
    assert [(r.term, r.df, r.pointer, r.docs, r.gaps) for r in rows] == [("a", 3, 0, [1, 4, 9], [1, 3, 5]), ("b", 2, 24, [2, 5], [2, 3])]


def test_pages_by_content_type(spark, tmp_path):
    rows = [(1, "u", "<a>", "text/html; charset=utf-8"), (2, "v", "%PDF", "application/pdf"), (3, "w", None, "text/html"), (4, "x", "<b>", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, content_type string").write.parquet(str(tmp_path / "p"))
    assert sorted((r.page_id, r.html) for r in readers.pages(spark, str(tmp_path / "p")).collect()) == [(1, "<a>"), (2, ""), (3, ""), (4, "")]


def test_menu():
    assert [Similarity.from_menu(k) for k in (1, 2, 3, 4, 9)] == [Similarity.COSINE, Similarity.SCALAR, Similarity.DICE, Similarity.JACCARD, Similarity.COSINE]


def test_vbyte_of_large_numbers(spark):
    numbers = [1, 127, 128, (1 << 53) - 1, (1 << 53) + 1, (1 << 62) + 12345, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    bits = [r.b for r in df.select(codes.vbyte_encode(F.col("n")).alias("b")).collect()]
    assert [list(codes.vbyte_values(b)) for b in bits] == [[n] for n in numbers]


def test_accents_beyond_latin(spark):
    df = spark.createDataFrame([("Ầbc ế Ώ á",)], "t string")
    assert df.select(text.tokenize(F.col("t"))).first()[0] == ["abc", "e", "ω", "a"]


def test_stored_index(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "gato casa gato"), (2, "la casa"), (3, None), (4, "")], "doc_id long, text string").na.fill("", ["text"])
    config = AnalyzerConfig(stopwords=("la",), min_size=2)
    path = str(tmp_path / "i")
    index.build(corpus, path, config)
    back = readers.stored_index(spark, path)
    assert readers.stored_settings(spark, path) == config
    assert sorted((r.term, r.doc_id, r.tf, r.positions) for r in back["postings"].collect()) == [("casa", 1, 1, [1]), ("casa", 2, 1, [0]), ("gato", 1, 2, [0, 2])]
    assert [(r.term, r.term_id, r.cf, r.df, r.pointer) for r in back["vocabulary"].orderBy("term").collect()] == [("casa", 1, 2, 2, 0), ("gato", 2, 2, 1, 16)]
    assert sorted((r.doc_id, r.n_tokens, r.top) for r in back["documents"].collect()) == [(1, 3, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0)]
    assert [tuple(r) for r in readers.postings_at(back, [16]).collect()] == [(16, "gato", 1, 2)]
    asked = spark.createDataFrame([("gato",), ("nada",)], "term string")
    assert {r.term: (r.cf, r.df) for r in index.lookup(back["vocabulary"].select("term", "cf", "df", "idf"), asked).collect()} == {"gato": (2, 1), "nada": (0, 0)}


def test_same_results(spark):
    run = lambda *rows: spark.createDataFrame(list(rows), "query_id int, doc_id long, score double")
    got = retrieval.same_results(run((1, 5, 0.5), (2, 6, 1.0)), run((1, 5, 0.5), (2, 7, 1.0)))
    assert {r.query_id: r.same for r in got.collect()} == {1: True, 2: False}


def test_graph_ids(spark):
    nodes, edges = graph.with_ids(spark.createDataFrame([("b", "a"), ("a", "c")], "src string, dst string"))
    assert sorted(values(sinks.id_url_lines(nodes))) == ["1: a", "2: b", "3: c"] and sorted(map(tuple, edges.collect())) == [(1, 3), (2, 1)]


def test_page_rank_of_sinks(spark):
    """A node without links out spreads its rank over all."""
    got = {r.node: r.rank for r in graph.page_rank(spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double"), teleport=0.0, epsilon=None, iterations=1).collect()}
    assert got == {"a": 0.25, "b": 0.75}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([(1, "gato casa"), (2, "gato")], "doc_id long, text string").write.mode("overwrite").parquet(str(source))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
    counted = growth.term_counts(stream)
    q = counted.writeStream.format("memory").queryName("growth_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r)[:2] for r in spark.table("growth_counts").collect())[:2] == [("casa", 1), ("gato", 2)]


def test_event_windows(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:10:00", 4.0)], "event_type string, t string, value double")
    rows.select("event_type", F.to_timestamp("t").alias("ts"), "value").write.parquet(str(source))
    stream = growth.event_windows(spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("growth_windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("growth_windows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
