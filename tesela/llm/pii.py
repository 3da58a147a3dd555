"""Personal data by patterns, and terms that disclose it by corpus co-occurrence, in SQL functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import checkpoint, table

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the four patterns. Possessive repeats (never followed by what they could give back) run in a loop instead of
#: by recursion, and the looks behind skip starts inside a run that has failed from its first character. Runs of digits match
#: whole or not at all, so that of cards asks for 16 to 19 digits at once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


@dataclass(frozen=True)
class DisclosureConfig:
    """A term t discloses an entity e of a document where PMI(t; e) >= alpha * IC(e), that is log p(e|t) - log p(e) >= -alpha
    * log p(e), over contexts: lines, or stretches of CONTEXT code points of longer lines. min_contexts: different contexts that
    must show both, so that chance pairs don't count. min_chars: of a term."""

    alpha: float = 0.9
    min_contexts: int = 2
    min_chars: int = 4


EMPTY = "cast(array() as array<struct<start:int,end:int,match:string>>)"
#: Pieces whose places are summed at once; whole texts are summed over such blocks, as growing one array copies it.
BLOCK = 128


def places(pieces: Column) -> Column:
    """array<struct<start, end, match>> for an array of (m, gap): each m comes gap code points behind the one before."""
    end = lambda acc, x: acc["at"] + x["gap"] + F.length(x["m"])
    within = lambda part: F.aggregate(
        part,
        F.struct(F.lit(0).alias("at"), F.expr(EMPTY).alias("out")),
        lambda acc, x: F.struct(end(acc, x).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), end(acc, x).alias("end"), x["m"].alias("match")))).alias("out")),
    )
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))))
    moved = lambda acc, x: F.transform(x["out"], lambda y: F.struct((y["start"] + acc["at"]).alias("start"), (y["end"] + acc["at"]).alias("end"), y["match"].alias("match")))
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,end:int,match:string>>>)").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved(acc, x))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )


def spans(text: Column, kind: str) -> Column:
    """The leftmost non-overlapping matches of a kind that are valid; code points, end exclusive.

    Spark returns matches without places, so the text is split at the matches as well, and lengths are summed."""
    pattern, hint = PATTERNS[kind], HINTS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    placed = F.filter(places(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))), lambda x: valid(kind, x["match"]))
    likely = text.rlike(pattern) if hint is None else F.contains(text, F.lit(hint)) & text.rlike(pattern)
    return F.when(likely, placed).otherwise(F.expr(EMPTY))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(digits)
    at = lambda i: F.substring(digits, size - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, at(i)).otherwise(F.when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda x: F.when(F.length(plain(x)) <= 3, F.concat(F.lit("0"), plain(x)).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15)


#: White space that parts terms.
GAP = r"[\x09-\x0D\x20]"
#: What is cut off a word's ends before it counts as a term.
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def term(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, EDGE, ""))


#: Code points of a context at most, so that a context's entities times its terms are bounded however long a line is.
CONTEXT = 512
#: Stretches of a longer line. They end behind a letter before white space, where no match of a pattern goes on, or, in 512 code
#: points without such a place, anywhere.
STRETCH = rf".{{1,{CONTEXT}}}$|.{{1,{CONTEXT - 1}}}\p{{L}}(?=[\x09-\x0D\x20])|.{{1,{CONTEXT}}}"


def contexts(line: Column) -> Column:
    """The contexts of a line, as an array."""
    return F.when(F.length(line) <= CONTEXT, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit("(?s)" + STRETCH), F.lit(0)))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null as empty) and an array of valid spans for each kind."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.select("doc_id", "text", *(spans(F.col("text"), k).alias(k) for k in KINDS))


def disclosing_terms(docs: DataFrame, config: DisclosureConfig = DisclosureConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """entity, term, n_both, n_term, n_entity, contexts: the terms whose contexts give the entity away.

    Counts are over the contexts of all documents. Pairs come from contexts with an entity only; their terms are then counted
    over the whole corpus, with a partial count in every task, so frequent terms reach the shuffle as one row a task.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return disclosures(rows, checkpoint(entity_lines(rows, config)), config)


def disclosures(rows: DataFrame, near: DataFrame, config: DisclosureConfig) -> DataFrame:
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= config.min_contexts)
    lines = rows.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.explode(contexts(F.col("line"))).alias("line"))
    n_lines = lines.groupBy().agg(F.count(F.lit(1)).alias("n_lines"))
    entities = near.select("entity", "doc_id", "line_no", "at").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    words = lines.select(F.explode(F.array_distinct(F.split("line", GAP, -1))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(term(F.col("word")).alias("term"), "n")
    n_term = counted.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    found = pairs.join(n_term, "term").join(entities, "entity").join(F.broadcast(n_lines))  # one row
    told = F.log(F.col("n_both") / F.greatest("n_term", "n_both"))
    return found.where(told >= (1 - config.alpha) * F.log(F.col("n_entity") / F.col("n_lines"))).select("entity", "term", "n_both", "n_term", "n_entity", "contexts")


def entity_lines(rows: DataFrame, config: DisclosureConfig) -> DataFrame:
    """doc_id, line_no, at (number in the line), context (its hash), entity, term: once for each context, entity and term outside
    of entities."""
    likely = None
    for kind in KINDS:
        hit = F.col("text").rlike(PATTERNS[kind])
        hit = hit if HINTS[kind] is None else F.contains(F.col("text"), F.lit(HINTS[kind])) & hit
        likely = hit if likely is None else likely | hit
    lines = rows.where(likely).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "whole"))
    lines = lines.select("doc_id", "line_no", F.posexplode(contexts(F.col("whole"))).alias("at", "line"))
    found = F.flatten(F.array(*(F.transform(spans(F.col("line"), k), lambda x: x["match"]) for k in KINDS)))
    lines = lines.select("doc_id", "line_no", "at", "line", F.array_distinct(found).alias("entities")).where(F.size("entities") > 0)
    plain = F.aggregate("entities", F.col("line"), lambda t, e: F.replace(t, e, F.lit(" ")))
    terms = F.array_distinct(F.filter(F.transform(F.split(plain, GAP, -1), term), lambda x: F.length(x) >= config.min_chars))
    pairs = lines.select("doc_id", "line_no", "at", F.xxhash64("line").alias("context"), F.explode("entities").alias("entity"), terms.alias("terms"))
    return pairs.select("doc_id", "line_no", "at", "context", "entity", F.explode("terms").alias("term"))


def terms_by_document(rows: DataFrame, config: DisclosureConfig) -> DataFrame:
    """doc_id and its disclosing terms, for documents that have some."""
    near = checkpoint(entity_lines(rows, config))
    told = disclosures(rows, near, config).select("entity", "term")
    return near.where("doc_id is not null").join(told, ["entity", "term"], "left_semi").groupBy("doc_id").agg(F.collect_set("term").alias("terms"))


def pii_spans(docs: DataFrame, config: DisclosureConfig = DisclosureConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, email, ip, card, phone and term: arrays of struct<start, end, match>.

    The first four are the patterns' valid matches; term holds the words of the document that disclose one of the entities
    on their line somewhere in it. Null text counts as empty. Repeated rows are counted and marked like others. Rows with
    a null id get no terms. Other columns aren't read. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    by_doc = terms_by_document(rows, config)
    both = rows.join(by_doc, "doc_id", "left")
    words = F.transform(F.split("text", GAP, -1), lambda w: F.struct(w.alias("m"), F.lit(0).alias("gap")))
    spaced = F.transform(words, lambda w, i: F.struct(w["m"].alias("m"), F.when(i == 0, 0).otherwise(1).alias("gap")))
    hits = F.filter(places(spaced), lambda x: F.array_contains(F.col("terms"), term(x["match"])))
    return both.select("doc_id", "text", *(spans(F.col("text"), k).alias(k) for k in KINDS), F.when(F.size("terms") > 0, hits).otherwise(F.expr(EMPTY)).alias("term"))


def written(kind: str) -> Column:
    """kind:start:end of the spans in a column of that name, comma-joined."""
    return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def redact(docs: DataFrame, config: DisclosureConfig = DisclosureConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with personal data in the text generalised to its kind and disclosing terms removed.

    Null text stays null. Columns of the input keep their names, whatever they are."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    by_doc = terms_by_document(rows, config).select(F.col("doc_id").alias("__pii_doc"), F.col("terms").alias("__pii_terms"))
    both = docs.join(by_doc, docs[id_col] == F.col("__pii_doc"), "left")
    text, terms = F.col(text_col), F.col("__pii_terms")
    label = lambda found, by: F.transform(found, lambda x: F.struct(x["start"], x["end"], F.lit(by).alias("by")))
    labelled = [label(spans(text, k), f"[{k.upper()}]") for k in KINDS]
    spaced = F.transform(F.split(text, GAP, -1), lambda w, i: F.struct(w.alias("m"), F.when(i == 0, 0).otherwise(1).alias("gap")))
    hits = F.when(F.size(terms) > 0, F.filter(places(spaced), lambda x: F.array_contains(terms, term(x["match"])))).otherwise(F.expr(EMPTY))
    labelled.append(label(hits, ""))
    marks = F.array_sort(F.flatten(F.array(*labelled)))
    clean = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), x["by"]))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return both.select(*(F.when(text.isNull(), text).when(F.size(marks) > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.array_join(F.flatten(F.array(*map(written, KINDS))), ",")
    every = F.array_join(F.flatten(F.array(*map(written, (*KINDS, "term")))), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
