"""Packing token streams into sequences by an order-preserving dynamic programme with a monotone queue."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tesela.llm.common import U64, hash_words, table, trim, utf8, word_edges
from tesela.llm.word_bpe import Merges, Slots

WINDOW = 4096
#: Costs, in padded tokens, of a window that ends at a sentence's end and of one that ends anywhere else in a document.
SENTENCE_COST, ANYWHERE_COST = 4, 512
#: Tokens that are planned at once; a stream is planned in such stretches, each of which ends with a document.
STRETCH = 1 << 19
#: Different pieces of words whose ids a worker remembers; about 100 bytes each, in every worker for as long as it lives.
REMEMBERED = 300_000
#: Bytes of a piece up to which its letters are merged many at once.
SHORT = 32

#: White space that parts words; the tokenizer drops it and never joins across it.
_GAP = np.zeros(256, bool)
_GAP[[*range(9, 14), 32]] = True
#: What a byte is in a simple word: 1 a letter a-z, 2 a mark that begins no contraction or special token, 0 anything else.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*b".,!?;:%&#$*|"]] = 2


class WordTokens:
    """Ids of whole texts by way of the pieces of their words, each of which is tokenised once for as long as it is remembered.

    A simple word is letters that no normal form changes and that have lower case one by one (a to z and Latin-1), with marks
    behind them: the tokenizer parts the two. The letters of many simple words are merged at once, in lower case; marks and other
    words go through the library, a word at a time. Pieces are known by 64-bit hashes, sizes and first eight bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.forget()

    def forget(self) -> None:
        self.known = Slots()
        self.looks = np.zeros((0, 2), U64)  # first bytes and sizes of the pieces
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """The data in lower case, and first byte, end byte and kind of each piece: 1 letters, 2 marks, 0 a whole other word."""
        at, to = word_edges(data, offsets, _GAP)
        kind = _KIND[data]
        low = data.copy()
        big = (data >= 65) & (data <= 90)
        low[big] += 32
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        big = lead[data[lead + 1] < 0x9F] + 1
        low[big] += 32
        seen = np.zeros((3, len(data) + 1), np.int32)
        np.cumsum(kind == 0, out=seen[0, 1:])
        np.cumsum(kind == 2, out=seen[1, 1:])
        back = np.zeros(len(data), bool)
        back[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
        np.cumsum(back, out=seen[2, 1:])
        simple = (seen[0, to] == seen[0, at]) & (kind[at] == 1) & (seen[2, to] == seen[2, at])
        marks = np.where(simple, seen[1, to] - seen[1, at], 0)
        some = np.flatnonzero(marks)
        place = np.concatenate([np.arange(len(at)), some + 0.5])
        order = np.argsort(place, kind="stable")
        begin = np.concatenate([at, to[some] - marks[some]])[order]
        end = np.concatenate([to - marks, to[some]])[order]
        return low, begin, end, np.concatenate([simple.astype(np.int8), np.full(len(some), 2, np.int8)])[order]

    def learn(self, raw: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray, keys: np.ndarray, looks: np.ndarray) -> None:
        size = end - begin
        counts = np.zeros(len(begin), np.int64)
        plain = (kind == 1) & (size <= SHORT)
        found: list = [None] * len(begin)
        rest = np.flatnonzero(~plain)
        text = [(low if kind[i] == 1 else raw)[begin[i] : end[i]].tobytes().decode() for i in rest.tolist()]
        for a in range(0, len(text), 20_000):
            for i, x in zip(rest[a : a + 20_000].tolist(), self.tokenizer.encode_batch_fast(text[a : a + 20_000], add_special_tokens=False), strict=True):
                found[i] = np.array(x.ids, np.int32)
                counts[i] = len(found[i])
        order = np.flatnonzero(plain)
        order = order[np.argsort(size[order], kind="stable")]
        parts = []
        padded = np.concatenate([low, np.zeros(SHORT, np.uint8)])
        for a in range(0, len(order), 8192):
            own = order[a : a + 8192]
            width = max(2, int(size[own[-1]]))
            ids, counts[own] = self.merges.encode(padded[begin[own][:, None] + np.arange(width)], size[own])
            parts.append(ids)
        # merged pieces first, in the order of their sizes, then the others; the table has them as they come
        sequence = np.concatenate([order, rest])
        self.ids = np.concatenate([self.ids, *parts, *(found[i] for i in rest.tolist())])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts[sequence])])
        self.looks = np.concatenate([self.looks, looks[sequence]])
        self.known.add(keys[sequence])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of the texts in them."""
        data, offsets = utf8(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        low, begin, end, kind = self.pieces(data, offsets)
        mixed = np.where(np.repeat(kind, end - begin) > 0, low[_places(begin, end)], data[_places(begin, end)])
        own = np.concatenate([[0], np.cumsum(end - begin)])
        keys = hash_words(mixed, own[:-1], own[1:]) ^ (kind == 1).astype(U64)
        lanes = np.ndarray((len(mixed) + 1,), "<u8", np.concatenate([mixed, np.zeros(8, np.uint8)]), strides=(1,))
        looks = np.stack([lanes[own[:-1]], (end - begin).astype(U64)], axis=1)
        short = end - begin < 8
        looks[short, 0] &= (U64(1) << (U64(8) * looks[short, 1])) - U64(1)
        place = self.known.find(keys)
        if (missing := np.flatnonzero(place < 0)).size:
            if self.known.n + len(missing) > REMEMBERED:
                self.forget()
                missing = np.arange(len(keys))
            first = missing[np.unique(keys[missing], return_index=True)[1]]
            self.learn(data, low, begin[first], end[first], kind[first], keys[first], looks[first])
            place = self.known.find(keys)
        if not (self.looks[place] == looks).all():
            raise ValueError("two pieces of words share a 64-bit hash")
        start = self.ends[place]
        size = self.ends[place + 1] - start
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]
        return ids, to[np.searchsorted(begin, offsets)]


def _places(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0], ..., end[0] - 1, begin[1], ..."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """Ids that end a sentence: full stops and marks at a word's end."""
    vocabulary = word_tokens(path).tokenizer.get_vocab()
    return np.array(sorted(i for x, i in vocabulary.items() if x.endswith("</w>") and x[:-4] and set(x[:-4]) <= set(".!?")), np.int32)


def choose(cuts: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices of the cuts that end the windows, with least padding and cost altogether.

    cuts rises strictly; it begins with 0 and ends with the stream's length, and no two neighbours lie more than a window
    apart. A window [a, b) pads window - (b - a), or nothing if its length is a power of two. So best(b) is the cost of b
    plus the least of best(a) + a over the cuts of a sliding window, plus window - b: a monotone queue yields that in
    constant time for each cut, and the powers of two are looked up beside it. Of equal plans, the longest window wins.
    """
    n = len(cuts)
    pos, cost = cuts.tolist(), costs.tolist()
    index = {p: i for i, p in enumerate(pos)}
    best, back = [0.0] * n, [0] * n
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    queue, keys, head = [0], [0.0], 0
    for j in range(1, n):
        b = pos[j]
        while pos[queue[head]] < b - window:
            head += 1
        least, via = keys[head] + window - b, queue[head]
        for p in powers:
            i = index.get(b - p)
            if i is not None and best[i] < least:
                least, via = best[i], i
        best[j], back[j] = least + cost[j], via
        key = best[j] + b
        while len(queue) > head and keys[-1] > key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return np.array(out[::-1], np.int64)


def plan(ends: np.ndarray, soft: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ends of the windows over a stream: ends are those of its documents, soft those of its sentences.

    Where neither comes for more than half a window, cuts at each 64th token are offered as well, at the higher cost."""
    total = int(ends[-1])
    firm = np.union1d(np.unique(np.concatenate([[0], ends])), soft[(soft > 0) & (soft < total)])
    wide = np.flatnonzero(np.diff(firm) > window // 2)
    step = min(64, window)
    more = [np.arange(firm[i] + step, firm[i + 1], step) for i in wide]
    cuts = np.unique(np.concatenate([firm, *more])).astype(np.int64)
    costs = np.full(len(cuts), float(ANYWHERE_COST))
    costs[np.isin(cuts, soft)] = SENTENCE_COST
    costs[np.isin(cuts, ends)] = 0
    return cuts[choose(cuts, costs, window)]


PIECES = pa.schema([(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Every partition is a stream of its own in stored order, so nothing is shuffled, a lost executor's partition is packed
    alike again, and a hot source or a very long document changes nothing. Null and empty texts are the end id alone.
    Repeated rows and null ids are packed like others. Other columns aren't read. An empty table gives no rows.
    sequence_id holds the partition above bit 40.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, enders = word_tokens(path), sentence_ends(path)
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            if not held:
                return
            names = pa.concat_arrays([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            size = np.concatenate([x[2] for x in held])
            held.clear()
            ends = np.cumsum(size)
            stops = plan(ends, np.flatnonzero(np.isin(ids, enders)) + 1, window)
            edge = np.union1d(ends, stops)
            begin = np.concatenate([[0], edge[:-1]])
            doc = np.searchsorted(ends, begin, "right")
            seq = np.searchsorted(stops, begin, "right")
            raw = ids.astype("<u4")
            sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(begin, edge, strict=True)]
            starts = np.concatenate([[0], stops[:-1]])
            out = [begin - (ends - size)[doc], edge - begin, np.array(sums, np.int64), size[doc], first + seq, begin - starts[seq]]
            columns = [names.take(pa.array(doc)), *map(pa.array, out)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], edge]).astype(np.int32)), pa.array(ids)))
            first += len(stops)
            table_ = pa.RecordBatch.from_arrays(columns, ["doc_id", *PIECES.names, *["ids"] * with_ids])
            for a in range(0, table_.num_rows, 10_000):
                yield table_.slice(a, 10_000)

        waiting = 0
        for batch in batches:
            a, sizes = 0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            while a < batch.num_rows:  # a few MB of text at a time
                b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), 4 << 20)) + a)
                part = batch.slice(a, b - a)
                ids, at = coder.encode(part.column(1))
                size = np.diff(at) + 1
                whole = np.full(size.sum(), end_id, np.int32)
                keep = np.ones(len(whole), bool)
                keep[np.cumsum(size) - 1] = False
                whole[keep] = ids
                held.append((part.column(0), whole, size))
                waiting += len(whole)
                a = b
                if waiting >= STRETCH:
                    yield from flush()
                    waiting = 0
                    trim()
        yield from flush()
        trim()

    schema = f"doc_id {kind}, " + ", ".join(f"{x} long" for x in PIECES.names) + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
