"""Lexical analysis as column expressions: normalisation, tokens, extraction by patterns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.config import AnalyzerConfig

#: Punctuation and symbols that are deleted, and the extraction patterns in the order in which they apply.
PUNCTUATION = r"[!-/:-@\[-`{-~¿¡]"
SYMBOLS = "[§¢«»­±¬©®€°“”·—’‘–]"
PATTERNS = {
    "abbreviations": r"[A-Z][bcdfghj-np-tvxz]+\.|([A-Za-z]\.(?:[A-Za-z0-9]\.)+)",
    "entities": r"&(?:[a-z]+|#x?\d+);",
    "entities_spaced": r"\s(&\S+;)",
    "dates": r"[0-9]{1,2}[/|\-][0-9]{1,2}[/|\-](?:[0-9]{2,4})",
    "percentages": r"(\+\-)?[0-9]+(.)?[0-9]*%",
    "money": r"\$\d+(?:,\d{1,2})?",
    "phones": r"(?:\(\d{2,}\))\s?\d{2,}(?:\-\d+)?\s",
    "urls": r"(https?://(?:www\.|(?!www))[a-z0-9.]+\.[a-z0-9/?=]{2,}|www\.[a-z0-9]+\.[a-z0-9/?=]{2,})",
    "emails": r"[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~.]+@[a-z0-9\-]+\.[a-z]+(?:\.[a-z]+)+",
    "names": r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)+",
}
#: The order in which the extracted classes are listed.
LISTED = ("names", "emails", "entities", "entities_spaced", "abbreviations", "dates", "percentages", "money", "phones", "urls")


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Characters of all of Unicode whose compatibility decomposition is one character and marks, and that character; then the
    marks, which have no counterpart and go."""
    pairs, marks = [], []
    for code in (*range(0xA0, 0xD800), *range(0xF900, 0x30000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if unicodedata.combining(chr(code)):
            marks.append(chr(code))
        elif len(plain) == 1 and plain != chr(code) and not plain.isspace():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


@F.pandas_udf(T.StringType())
def nfkd_strip(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for all of Unicode."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def strip_accents(text: Column, exact: bool = False) -> Column:
    """Without accents. By default characters that decompose to one are translated, and marks deleted, in the JVM; exact also
    resolves those that decompose to several (ligatures, fractions, Hangul) in a vectorised UDF."""
    return nfkd_strip(text) if exact else F.translate(text, *accent_table())


def remove_punctuation(text: Column) -> Column:
    """Deletes, so that what stood around a mark becomes one token."""
    return F.regexp_replace(text, PUNCTUATION, "")


def remove_symbols(text: Column) -> Column:
    return F.regexp_replace(text, SYMBOLS, "")


def normalise(text: Column, exact: bool = False) -> Column:
    return remove_symbols(remove_punctuation(F.lower(strip_accents(text, exact))))


def tokenize(text: Column, exact: bool = False) -> Column:
    return F.filter(F.split(normalise(text, exact), r"(?U)\s+"), lambda x: x != "")


def extract(text: Column) -> tuple[dict[str, Column], Column]:
    """The matches of every class and what is left: each pattern sees the text without what earlier ones took."""
    found, left = {}, text
    for name, pattern in PATTERNS.items():
        if name == "names":
            left = strip_accents(left)
        found[name] = F.regexp_extract_all(left, F.lit(pattern), F.lit(0))
        left = F.regexp_replace(left, pattern, "")
    return found, left


def stop_list(words: tuple[str, ...]) -> list[str]:
    """Stop words by the same normalisation as text, on the driver: the list is a literal."""
    gone = {c for c in map(chr, range(33, 127)) if not c.isalnum()} | set("¿¡§¢«»­±¬©®€°“”·—’‘–")
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()
    return sorted({"".join(c for c in t if c not in gone) for w in words for t in plain(w).split()} - {""})


def terms_of(tokens: Column, config: AnalyzerConfig) -> Column:
    """Tokens without stop words, and without those of a wrong length unless they are still to be stemmed."""
    stop = stop_list(config.stopwords)
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop))
    return tokens if config.stem else keep_length(tokens, config)


def keep_length(tokens: Column, config: AnalyzerConfig) -> Column:
    if config.min_size is None and config.max_size is None:
        return tokens
    return F.filter(tokens, lambda t: F.length(t).between(config.min_size or 0, config.max_size or (1 << 30)))


def analyse(text: Column, config: AnalyzerConfig) -> Column:
    """struct<tokens, terms, kept>: all tokens; ordinary terms (not stemmed yet); extracted terms, which bypass every filter."""
    if not config.regex:
        tokens = tokenize(text, config.exact_accents)
        return F.struct(tokens.alias("tokens"), terms_of(tokens, config).alias("terms"), F.array().cast("array<string>").alias("kept"))
    found, left = extract(text)
    tokens = tokenize(left, config.exact_accents)
    listed = F.concat(*(found[k] for k in LISTED))
    kept = F.concat(*(found[k] for k in LISTED if not k.startswith("entities")))
    return F.struct(F.concat(tokens, listed).alias("tokens"), terms_of(tokens, config).alias("terms"), kept.alias("kept"))
