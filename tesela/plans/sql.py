"""SQL of the checks: named parts that are put before a query as far as it uses them."""

from __future__ import annotations

import re

from tesela.functions.text import PUNCTUATION, SYMBOLS

#: Short topics of very frequent words; the second and third repeat none and one of theirs.
TOPICS = [(1, "the of"), (2, "de la que"), (3, "the and the"), (4, "und der"), (5, "and to in"), (6, "the nosuchterm")]
#: The language of the documents that a topic is about.
LANGUAGES = {1: "en", 2: "es", 3: "en", 4: "de", 5: "en", 6: "en"}
#: Titles with every operator of the query language.
TITLES = [(1, "the AND of"), (2, "nosuchterm OR der"), (3, "the AND NOT of"), (4, 'find "de la" now'), (5, "the CLOSE-TO of"), (6, "und 20-TERMS der"), (7, "and ADJACENT the"), (8, "que")]
STOP = ("the", "of", "and", "de", "la", "der", "und", "que", "to", "in")

_NORM = f"regexp_replace(regexp_replace(lower(strip_accents(%s)), '{PUNCTUATION}', '', 'g'), '{SYMBOLS}', '', 'g')"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({_NORM % text}, '\\s+'), lambda x: x <> '')"


PARTS = {
    "tok": f"SELECT doc_id, {tokens("coalesce(text, '')")} AS t FROM documents",
    "occ": "SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tok",
    "tf": "SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY term, doc_id",
    "ndocs": "SELECT count(*) AS n FROM documents",
    "voc": "SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, ln(max(n) * 1.0e0 / count(*)) AS idf FROM tf, ndocs GROUP BY term",
    "ids": "SELECT term, row_number() OVER (ORDER BY term) AS term_id FROM (SELECT DISTINCT term FROM occ)",
    "topf": "SELECT doc_id, max(tf) AS top FROM tf GROUP BY doc_id",
    "w": "SELECT tf.term, tf.doc_id, tf, tf * 1.0e0 / top * idf AS weight FROM tf JOIN topf USING (doc_id) JOIN voc USING (term)",
    "norms": "SELECT d.doc_id, coalesce(sqrt(sum(weight * weight)), 0.0e0) AS norm FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id",
    "topics": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {t.split()!r})" for i, t in TOPICS) + ") v(query_id, terms)",
    "topic_languages": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {x!r})" for i, x in LANGUAGES.items()) + ") v(query_id, lang)",
    "qt": "SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM topics) GROUP BY query_id, term",
    "qn": "SELECT query_id, count(*) AS n FROM qt GROUP BY query_id",
    "qw": "SELECT query_id, term, qtf * idf AS qweight FROM qt JOIN voc USING (term)",
    "sp": "SELECT query_id, doc_id, sum(weight * qweight) AS sp FROM w JOIN qw USING (term) GROUP BY query_id, doc_id",
    "qnorm": "SELECT query_id, sqrt(sum(qweight * qweight)) AS qn FROM qw GROUP BY query_id",
    "scored": "SELECT query_id, doc_id, sp, norm, qn FROM sp JOIN norms USING (doc_id) JOIN qnorm USING (query_id)",
    "cosine": "SELECT query_id, doc_id, sp / (norm * qn) AS score FROM scored WHERE norm * qn <> 0",
    "dice": "SELECT query_id, doc_id, 2 * sp / (norm * norm + qn * qn) AS score FROM scored WHERE norm * norm + qn * qn <> 0",
    "summed": "SELECT query_id, doc_id, round(sum(weight), 9) AS score FROM w JOIN qt USING (term) GROUP BY query_id, doc_id",
    "hits_or": "SELECT DISTINCT query_id, doc_id FROM tf JOIN qt USING (term)",
    "counts": "SELECT term, cf AS freq FROM voc",
    "zr": "SELECT term, freq, rank() OVER (ORDER BY freq DESC) AS rank FROM counts",
    "zc": "SELECT term, freq, CAST(sum(freq) OVER (ORDER BY freq DESC, term ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, sum(freq) OVER () AS total FROM counts",
    "fit": "SELECT regr_slope(ln(freq), ln(rank)) AS m, regr_intercept(ln(freq), ln(rank)) AS b, regr_r2(ln(freq), ln(rank)) AS r2 FROM zr",
    "firsts": "SELECT term, min(doc_id) AS doc_id FROM occ GROUP BY term",
    "heaps": "SELECT doc_id, n, coalesce(k, 0) AS k FROM (SELECT doc_id, count(*) AS n FROM occ GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS k FROM firsts GROUP BY doc_id) USING (doc_id)",
    "run": "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cosine",
    "run2": "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dice",
    "qrels": "SELECT t.query_id, l.doc_id FROM topic_languages t JOIN documents d USING (lang) JOIN (SELECT doc_id FROM labels WHERE quality = 1 GROUP BY doc_id) l USING (doc_id) GROUP BY 1, 2",
    "totals": "SELECT query_id, count(*) AS total FROM qrels GROUP BY query_id",
    "judged": "SELECT r.query_id, r.doc_id, r.rank, (q.doc_id IS NOT NULL)::INT AS rel, total FROM run r JOIN totals USING (query_id) LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id",
    "rp": "SELECT *, CAST(sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS hits FROM judged",
    "pr": "SELECT query_id, rank, doc_id, rel, hits, total, hits * 1.0e0 / rank AS precision, hits * 1.0e0 / total AS recall FROM rp",
    "judged_dice": "SELECT r.query_id, r.doc_id, r.rank, (q.doc_id IS NOT NULL)::INT AS rel, total FROM run2 r JOIN totals USING (query_id) LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id",
    "pr_dice": "SELECT *, hits * 1.0e0 / rank AS precision FROM (SELECT *, CAST(sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS hits FROM judged_dice)",
    "gaps": "SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM tf",
    "links": "SELECT page_id, url, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS link FROM (SELECT page_id, url, list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1), lambda x: x[1] <> '#') AS l FROM pages)",
    "full_links": "SELECT page_id, url, place, CASE WHEN link[1] = '/' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || link ELSE link END AS link FROM links",
    "plinks": "SELECT url AS src, link AS dst, 1.0e0 AS weight FROM full_links GROUP BY 1, 2",
    "trade": "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) * 1.0e0 AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
}


def with_parts(body: str) -> str:
    """The query with the parts that it names, and those that they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, part in PARTS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need_in = [x for x in PARTS if x != name and re.search(rf"\b(?:FROM|JOIN|,)\s+{x}\b", part)]
                for x in need_in:
                    need(f" FROM {x} ")
                if name not in needed:
                    needed.append(name)

    need(" ".join(re.findall(r"(?:FROM|JOIN|,)\s+\w+", body)))
    head = ", ".join(f"{n} AS ({PARTS[n]})" for n in needed)
    if not head:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
