"""Repeated passages by hashing of lines and of the sentences in them: the earliest occurrence stays."""

from __future__ import annotations

import string
from collections.abc import Iterator
from hashlib import blake2b
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import _LOWER, U64, blocks, checkpoint, hash_words, table, utf8, word_edges

#: What parts words when units are compared: white space and ASCII punctuation.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(9, 14), 32, *map(ord, string.punctuation)]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True


@dataclass(frozen=True)
class UnitConfig:
    """min_words: a run of repeated units goes only if it has as many words; shorter ones stay, as single short sentences
    recur by chance. Occurrences are ordered by document id, then by offset. long: words of a sentence up to which it is one
    unit. stretch: words of the units that a longer sentence is cut into, on average; it is cut behind words whose hashes say
    so, wherever in the sentence they stand, so that a passage without full stops that is pasted into other words has the same
    cuts inside as elsewhere. different: words that a sentence must have to be cut; of fewer ones every piece would recur."""

    min_words: int = 8
    long: int = 24
    stretch: int = 8
    different: int = 16


def units(data: np.ndarray, offsets: np.ndarray, config: UnitConfig = UnitConfig()) -> tuple:
    """Of UTF-8 rows: row, first byte, end byte, number of words and 128-bit digest (bytes) of each unit with words.

    A unit ends with a line, or with the white space behind a full stop or mark, or inside a long sentence behind a word that
    cuts. Units cover the rows without gaps: what has no words belongs to the unit before it. Digests are BLAKE2b of the words
    alone, with a space between them and ASCII letters in lower case."""
    n = len(data)
    low = _LOWER[data]
    at, to = word_edges(low, offsets, _BREAKS)
    if not len(at):
        return (*(np.zeros(0, np.int64) for _ in range(4)), [])
    white, place = _WHITE[data], np.arange(n)
    solid = np.maximum.accumulate(np.where(white, -1, place))
    line = np.maximum.accumulate(np.where(data == 10, place, -1))
    start = np.zeros(n + 1, bool)
    start[1:] = data == 10
    j = np.flatnonzero(~white[1:] & white[:-1]) + 1
    before = solid[j - 1]
    start[j] |= (before >= 0) & (line[j - 1] < before) & _STOP[data[before]]
    start[offsets] = True
    sentence = np.searchsorted(np.flatnonzero(start[:n]), at, "right")
    wide = np.flatnonzero(np.bincount(sentence)[sentence] > config.long)
    words, of = hash_words(low, at[wide], to[wide]), sentence[wide]
    order = np.lexsort((words, of))
    fresh = np.append(True, (np.diff(of[order]) != 0) | (words[order][1:] != words[order][:-1])) if len(wide) else np.zeros(0, bool)
    various = np.bincount(of[order][fresh], minlength=sentence[-1] + 1) >= config.different
    cuts = wide[(words % U64(config.stretch) == 0) & various[of]]
    cuts = cuts[cuts + 1 < len(at)]
    cuts = cuts[sentence[cuts + 1] == sentence[cuts]]
    start[at[cuts + 1]] = True
    begins = np.flatnonzero(start[:n])
    own = np.searchsorted(begins, at, "right") - 1  # the unit of each word
    first = np.flatnonzero(np.diff(own, prepend=-1))
    last = np.append(first[1:], len(at))
    begin = begins[own[first]]
    row = np.searchsorted(offsets, at[first], "right") - 1
    opens = np.diff(row, prepend=-1) > 0
    begin[opens] = offsets[row[opens]]
    end = np.append(begin[1:], n)
    closes = np.append(opens[1:], True)
    end[closes] = offsets[row[closes] + 1]
    held = ~_BREAKS[low]
    low[~held] = 32
    held[to[to < n]] = True
    place = np.cumsum(held)
    plain = low[held].tobytes()
    digests = [blake2b(plain[a:b], digest_size=16).digest() for a, b in zip((place[at[first]] - 1).tolist(), place[to[last - 1] - 1].tolist(), strict=True)]
    return row, begin, end, last - first, digests


def unit_rows(docs: DataFrame, config: UnitConfig, id_col: str, text_col: str) -> DataFrame:
    """doc_id, at (offset of the unit), size, n_words, d1, d2 (digest of 128 bits); a row for each unit with a word. again: an
    equal unit comes earlier in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for a, b in blocks(offs):
                part = data[offs[a] : offs[b]]
                row, begin, end, n_words, digests = units(part, offs[a : b + 1] - offs[a], config)
                d1, d2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T.copy()
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                at = points[begin] - points[offs[a:b][row] - offs[a]]
                again = np.ones(len(row), bool)
                order = np.lexsort((begin, d2, d1, row))
                new = (np.diff(row[order], prepend=-1) != 0) | (np.diff(d1[order], prepend=0) != 0) | (np.diff(d2[order], prepend=0) != 0)
                again[order[new]] = False
                columns = [batch.column(0).take(pa.array(row + a)), *map(pa.array, (at, points[end] - points[begin], n_words, d1, d2, again))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "size", "n_words", "d1", "d2", "again"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, at long, size long, n_words long, d1 long, d2 long, again boolean")


def repeated_spans(docs: DataFrame, config: UnitConfig = UnitConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of start, end; code points, rising, apart): what goes, for documents that lose something.

    Digests group globally by a pre-aggregated minimum of doc_id; what recurs inside its document is marked there: a line that a
    third of all documents hold reaches the shuffle as one row for each task. The digests of several documents are cut in the
    shared folder, one row each, so that nothing but the join stands behind the shuffle back, whose hot digests Spark's adaptive
    execution splits over tasks.
    """
    rows = unit_rows(docs, config, id_col, text_col).where("doc_id is not null")
    first = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = checkpoint(first)
    later = rows.join(first, ["d1", "d2"], "left").where((F.col("doc_id") > F.col("first")) | F.col("again"))
    gathered = later.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "size", "n_words"))).alias("units"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(x, config.min_words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return gathered.mapInArrow(join, f"doc_id {gathered.dtypes[0][1]}, spans array<struct<start:bigint,end:bigint>>").where(F.size("spans") > 0)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(found: list[dict], min_words: int) -> list[dict]:
    """Neighbouring units as one span; runs of fewer words are left out."""
    out: list[list[int]] = []
    for x in found:
        if out and out[-1][1] == x["at"]:
            out[-1][1] += x["size"]
            out[-1][2] += x["n_words"]
        else:
            out.append([x["at"], x["at"] + x["size"], x["n_words"]])
    return [{"start": a, "end": b} for a, b, w in out if w >= min_words]


def substring_dedup(docs: DataFrame, config: UnitConfig = UnitConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, spans (array of start and end in the original text) and kept (the text without them).

    Units are lines, sentences and stretches of long sentences, equal by their words without ASCII punctuation, ASCII letters in
    lower case. Of equal units the one with the smallest (doc_id, offset) stays; the others go where they make a run of
    `min_words` words. Null text counts as
    empty and is kept as empty. Repeated rows of one id are the same document and never remove each other. Rows with a
    null id stay whole. Other columns aren't read. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    spans = repeated_spans(rows, config)
    both = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                spans = [x or [] for x in part.column(2).to_pylist()]
                kept = []
                for text, found in zip(part.column(1).to_pylist(), spans, strict=True):
                    edges = [0, *(y for x in found for y in (x["start"], x["end"])), len(text)]
                    kept.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, SPANS), pa.array(kept, pa.string())], ["doc_id", "text", "spans", "kept"])

    return both.mapInArrow(cut, f"doc_id {rows.dtypes[0][1]}, text string, spans array<struct<start:bigint,end:bigint>>, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    written = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), written.alias("spans"), F.sha2("kept", 256).alias("kept_sha256"))
