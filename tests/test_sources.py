"""Readers and writers over literal files."""

import pytest
from pyspark.errors import AnalysisException

from tesela.operators import index
from tesela.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_corpus_directory(spark, tmp_path):
    (tmp_path / "b").mkdir()
    write(tmp_path / "a.txt", "uno\ndos")
    write(tmp_path / "b" / "c.txt", "tres")
    rows = readers.corpus_from_directory(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(1, "uno\ndos"), (2, "tres")]
    assert [r.name for r in readers.directory_listing(spark, str(tmp_path)).collect()] == ["a.txt"]
    with pytest.raises(AnalysisException):
        readers.corpus_from_directory(spark, str(tmp_path / "none")).count()


def test_topics(spark, tmp_path):
    path = write(tmp_path / "q", "<TOP>\n<NUM>1</NUM>\nloose\n<TITLE>gato negro</TITLE>\n</TOP>\n<top><num>22</num><title>la casa</title></top>")
    assert [(r.query_id, r.title) for r in readers.topics(spark, path).orderBy("query_id").collect()] == [(1, "gato negro"), (22, "la casa")]


def test_vectors_and_vocabulary(spark, tmp_path):
    v = write(tmp_path / "v", "Vectors\nQuery 1: (72, 191, 192)\nQuery 2: (3)\n")
    assert sorted(map(tuple, readers.id_vectors(spark, v).collect())) == [(1, 72), (1, 191), (1, 192), (2, 3)]
    w = write(tmp_path / "w", "id idf term\n1 0.5 gato\n2 1.25 casa\nbad\n")
    assert sorted(map(tuple, readers.vocabulary_file(spark, w).collect())) == [(1, 0.5, "gato"), (2, 1.25, "casa")]


def test_runs(spark, tmp_path):
    t = write(tmp_path / "t", "query\trank\tdoc\n1\t1\t7\n1\t2\t9\n")
    assert [tuple(r) for r in readers.tab_run(spark, t).orderBy("rank").collect()] == [(1, 1, 7, None), (1, 2, 9, None)]
    q = write(tmp_path / "q", "1 Q0 7 0 0.5 M\n1 Q0 9 1 0.25 M\n")
    assert [(r.doc_id, r["rank"], r.score) for r in readers.q0_run(spark, q).collect()] == [(7, 0, 0.5), (9, 1, 0.25)]


def test_tagged_collection(spark, tmp_path):
    path = write(tmp_path / "c", ".I 1\n.T\nTitle one\n.A\nDoe\n.W\nBody\nmore\n.X\n1 2\n.I 2\n.W\nOnly body\n")
    rows = readers.tagged_collection(spark, path).orderBy("doc_id").collect()
    assert tuple(rows[0]) == (1, "Title one", "Doe", "Body\nmore", "1 2") and tuple(rows[1])[:3] == (2, None, None) and rows[1].body == "Only body"
    assert "<DOCNO>1</DOCNO>" in sinks.trec_lines(readers.tagged_collection(spark, path)).collect()[0].value


def test_postings(spark, tmp_path):
    d = write(tmp_path / "d", "gato:3:9,2,x,5\n")
    assert tuple(readers.postings_dump(spark, d).first()) == ("gato", 3, [2, 5, 9])
    p = write(tmp_path / "p", "1:4,0.500000;7,1.000000;\n2:4,3;\n")
    rows = sorted((r.term_id, r.doc_id, r.value, r.positions) for r in readers.postings_text(spark, p).collect())
    assert rows[0][:3] == (1, 4, 0.5) and rows[2] == (2, 4, 3.0, [3])


def test_reports_and_names(spark, tmp_path):
    r = write(tmp_path / "r", "Average: 1\nPrecision at   0%   : 0.75\nPrecision at 10% : 0.5\n")
    assert [tuple(x) for x in readers.evaluation_report(spark, r).orderBy("level").collect()] == [(0, 0.75), (10, 0.5)]
    n = write(tmp_path / "n", "1 a.html\n2 b c.html\n")
    assert [tuple(x) for x in readers.id_names(spark, n).collect()] == [(1, "a.html"), (2, "b c.html")]


@pytest.mark.parametrize(
    ("title", "legacy", "want"),
    [
        ("gato AND casa", False, ("AND", None)), ("ORDEN publico", False, (None, None)), ("ORDEN publico", True, ("OR", None)),
        ("a AND NOT b", False, ("NOT", None)), ('x "la casa" y "el gato"', False, ("PHRASE", None)), ("universidad 100-TERMS hola", False, ("NEAR", 100)),
        ("a ADJACENT b", False, ("NEAR", 1)), ("a CLOSE-TO b", False, ("NEAR", 5)),
    ],
)
def test_parser(title, legacy, want):
    got = readers.parse_query(title, legacy)
    assert (got["op"], got["distance"]) == want


def test_parsed_terms(spark):
    r = readers.parsed_queries(spark, [(1, "universidad 100-TERMS hola"), (2, 'x "La Casa"')]).orderBy("query_id").collect()
    assert r[0].terms == ["universidad", "hola"] and r[1].terms == ["la", "casa"]


def test_stored_index(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "gato casa"), (2, "gato")], "doc_id long, text string")
    tf = index.term_frequency(index.occurrences(corpus))
    sinks.store_index({"tf": tf, "names": corpus.select("doc_id")}, str(tmp_path / "i"))
    back = readers.stored_index(spark, str(tmp_path / "i"))
    assert set(back) == {"tf", "names"} and sorted(map(tuple, back["tf"].collect())) == sorted(map(tuple, tf.collect()))


def test_lines(spark, tmp_path):
    run = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.75)], "query_id int, doc_id long, score double")
    assert [r.line for r in sinks.q0_lines(run, "M").orderBy("rank").collect()] == ["1 Q0 6 0 0.750000 M", "1 Q0 5 1 0.500000 M"]
    assert sorted(r.value for r in sinks.tab_lines(run).collect()) == ["1\t1\t6\t0.75", "1\t2\t5\t0.5"]
    edges = spark.createDataFrame([(1, 2)], "src int, dst int")
    sinks.write_lines(sinks.dot_lines(edges), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).first()[0] == "1 -> 2"
