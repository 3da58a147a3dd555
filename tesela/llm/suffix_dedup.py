"""Removal of long byte strings that an earlier document holds, by suffix arrays over shards of shared text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.cells import KEY_BITS, cell_bits, different_texts, found_in, grouped, key_cells, read_keys, shared_keys, unpacked
from tesela.llm.common import ODD, U64, checkpoint, hash_words, mix, table, trim, utf8
from tesela.llm.induced import sort_suffixes


@dataclass(frozen=True)
class SuffixConfig:
    """length: bytes of a string that counts as repeated. gram: bytes of the strings whose least hash deals a window to a shard.
    text_block: bytes of texts that are looked at together. cell: bytes of texts whose keys are counted in one group. shard: bytes
    of texts for each shard. memory: bytes of queue records that a sort holds before they go on disk. names: symbols of a string of
    names that a sort orders in memory; longer ones by recursion. buffer: bytes of pieces that a task gathers before it packs them
    by shard."""

    length: int = 50
    gram: int = 16
    text_block: int = 1 << 20
    cell: int = 8 << 20
    shard: int = 1 << 20
    memory: int = 4 << 20
    names: int = 1 << 24
    buffer: int = 4 << 20


#: Bits of a window's place in its block of texts below the bits of a string's hash.
PLACE_BITS = 28
#: Bits of a hash by which pieces go to shards.
ROUTE_BITS = 64 - PLACE_BITS


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes (8 at least), from unaligned lanes of eight bytes."""
    n = len(data) - size + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.full(n, size, U64)
    for at in [*range(0, size - 8, 8), size - 8]:
        out = mix(out * ODD ^ lanes[at : at + n])
    return out


def window_anchors(data: np.ndarray, config: SuffixConfig) -> np.ndarray:
    """For each window of `length` bytes, hash and place of the string of `gram` bytes in it whose hash is least, the leftmost of
    equals: equal windows have equal hashes there, at the same place inside them."""
    n = len(data) - config.length + 1
    if n <= 0:
        return np.zeros(0, U64)
    place = U64((1 << PLACE_BITS) - 1)
    grams = gram_hashes(data, config.gram)
    least = (grams & ~place) | np.arange(len(grams), dtype=U64)
    width, most = 1, config.length - config.gram + 1
    while width < most:
        step = min(width, most - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least[:n]


def window_runs(data: np.ndarray, offsets: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, route and place in the data of the anchor, of each run of neighbouring windows of a
    row with one anchor."""
    if len(data) >= 1 << PLACE_BITS:
        raise ValueError("a text is longer than 2^28 bytes")
    least = window_anchors(data, config)
    if not len(least):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    count = np.maximum(np.diff(offsets) - config.length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][row]
    least = least[at]
    new = np.ones(len(row), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    least = least[first]
    anchor = (least & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return row[first], at[first] - offsets[row[first]], np.diff(np.append(first, len(row))), (least >> U64(PLACE_BITS)).astype(np.int64), anchor


def side_keys(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, anchor: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each run: hashes of its anchor with the half of a window before it, and with the half behind it; 0 where the row
    ends before. An equal window has one of the halves around the anchor, so two runs with an equal window share a key."""
    half = (config.length - config.gram + 1) // 2
    n = config.gram + half
    if len(data) < n:
        return np.zeros(len(row), U64), np.zeros(len(row), U64)
    every = gram_hashes(data, n)
    before, behind = np.zeros(len(row), U64), np.zeros(len(row), U64)
    some = anchor - half >= offsets[row]
    before[some] = mix(every[anchor[some] - half] ^ ODD)
    some = anchor + n <= offsets[row + 1]
    behind[some] = every[anchor[some]]
    return before, behind


def keys_of(data: np.ndarray, offsets: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    row, _, _, _, anchor = window_runs(data, offsets, config)
    before, behind = side_keys(data, offsets, row, anchor, config)
    keys, rows = np.concatenate([before, behind]), np.concatenate([row, row])
    return keys[keys > 0], rows[keys > 0]


def equal_pieces(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each piece data[begin : begin + size]; equal pieces, and no others, have equal numbers."""
    key = hash_words(data, begin, begin + size, long=1 << 10)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    own = first[number]
    differ = size != size[own]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for at in range(0, int(size.max()) if len(size) else 0, 8):
        step = np.minimum(at, size - 8)
        differ |= lanes[begin + step] != lanes[begin[own] + step]
    odd = np.flatnonzero(differ)  # a chance match of hashes: pieces of their own
    number[odd] = len(first) + np.arange(len(odd))
    return number


PIECES = "cell long, sure boolean, keys binary, docs binary, starts binary, sizes binary, z binary"
COLUMNS = ["cell", "sure", "keys", "docs", "starts", "sizes", "z"]


def pieces(texts: DataFrame, shared: DataFrame, bits: int, shards: int, config: SuffixConfig) -> DataFrame:
    """Pieces of text under runs of windows with a shared key, packed by shard (cell): routes, documents, starts, sizes, bytes.

    Inside a block the documents behind the first holder of a piece lose it for certain: those come as sure, without bytes,
    dealt evenly. So a piece that a third of all documents hold meets others as one row for each block."""
    shift = KEY_BITS - bits
    own = texts.select("block", F.lit(1).alias("kind"), "doc_id", "z", F.lit(None).cast("binary").alias("ranks"))
    theirs = shared.select("block", F.lit(0).alias("kind"), F.col("cell").alias("doc_id"), F.col("keys").alias("z"), "ranks")
    rows = own.unionByName(theirs).repartition("block").sortWithinPartitions("block", "kind", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting, lost = 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if held:
                yield packed_pieces(*(np.concatenate(x) for x in zip(*held, strict=True)), shards, False)
                held.clear()
            if lost:
                docs, starts, sizes = (np.concatenate(x) for x in zip(*lost, strict=True))
                cell = (docs.astype(U64) * ODD >> U64(64 - ROUTE_BITS)).astype(np.int64)
                yield packed_pieces(cell, docs, starts, sizes, np.zeros(0, np.uint8), shards, True)
                lost.clear()
            waiting = 0
            trim()

        for part in grouped(batches, "block"):
            n = int((part["kind"].to_numpy() == 0).sum())
            known, part = part.slice(0, n), part.slice(n)
            sizes = [len(x.as_buffer()) for x in known["ranks"]]
            some = np.concatenate([np.zeros(0, U64), *(read_keys(x.as_buffer(), r, c << shift) for x, r, c in zip(known["z"], sizes, known["doc_id"].to_pylist(), strict=True))])
            if not len(some):
                continue
            data, offsets = unpacked(part["z"])
            row, start, count, route, anchor = window_runs(data, offsets, config)
            before, behind = side_keys(data, offsets, row, anchor, config)
            hit = np.flatnonzero((found_in(before >> U64(64 - KEY_BITS), some) >= 0) | (found_in(behind >> U64(64 - KEY_BITS), some) >= 0))
            if not len(hit):
                continue
            row, start, size, route = row[hit], start[hit], count[hit] + config.length - 1, route[hit]
            begin, doc = offsets[row] + start, part["doc_id"].to_numpy()[row]
            number = equal_pieces(data, begin, size)
            first = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, number, doc)
            later = doc > first[number]
            lost.append((doc[later], start[later], size[later]))
            keep = np.flatnonzero(~later)
            text = data[_spread(begin[keep], size[keep])]
            held.append((route[keep], doc[keep], start[keep], size[keep], text))
            waiting += len(text) + 8 * int(later.sum())
            if waiting >= config.buffer:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, PIECES)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    kind = np.int32 if int(begin.max(initial=0)) + int(size.sum()) < 1 << 31 else np.int64
    return np.arange(size.sum(), dtype=kind) + np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size)


def packed_pieces(route: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, shards: int, sure: bool) -> pa.RecordBatch:
    """A row for each shard: shards are ranges of routes."""
    cell = (route.astype(U64) * U64(shards) >> U64(ROUTE_BITS)).astype(np.int64)
    order = np.lexsort((starts, docs, cell))
    begin = np.cumsum(sizes) - sizes
    cell, route, docs, starts, sizes, begin = (x[order] for x in (cell, route, docs, starts, sizes, begin))
    edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1 if not len(cell) else cell[-1] + 1)).tolist()
    pack = zstandard.ZstdCompressor(level=1).compress
    out: list[list] = [[] for _ in COLUMNS]
    for a, b in zip(edges, edges[1:]):
        raw = text[_spread(begin[a:b], sizes[a:b])].tobytes() if not sure else b""
        values = [int(cell[a]), sure, b"" if sure else pack(route[a:b].tobytes()), pack(docs[a:b].tobytes()), pack(starts[a:b].tobytes()), pack(sizes[a:b].tobytes()), pack(raw)]
        for x, v in zip(out, values, strict=True):
            x.append(v)
    kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], COLUMNS)


def earliest(text: np.ndarray, size: np.ndarray, first: np.ndarray, config: SuffixConfig) -> np.ndarray:
    """For each byte of the joined pieces, the least document (first: of each piece) that holds the window there; the largest
    number where none begins. Pieces are set one symbol apart and sorted as one string."""
    end = np.cumsum(size + 1) - 1
    joined = np.zeros(len(text) + len(size), np.int16)
    owner = np.repeat(np.arange(len(size)), size + 1)
    inside = np.ones(len(joined), bool)
    inside[end] = False
    joined[inside] = text.astype(np.int16) + 1
    order, lcp = sort_suffixes(joined, config.length, config.memory, config.names)
    whole = end[owner[order]] - order >= config.length
    group = np.cumsum(lcp < config.length) - 1
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[whole], first[owner[order[whole]]])
    out = np.full(len(joined), np.iinfo(np.int64).max)
    out[order[whole]] = least[group[whole]]
    return out[inside]


def solved(rows: pa.Table, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and end of what documents lose by one shard's pieces. Equal pieces are sorted once, with their least document;
    a piece that is the only one under its route shares no window with another one of the shard and isn't sorted."""
    unpack = zstandard.ZstdDecompressor().decompress
    column = lambda name, kind: np.frombuffer(b"".join(unpack(x.as_buffer()) for x in rows[name]), kind)
    docs, starts, sizes = column("docs", np.int64), column("starts", np.int64), column("sizes", np.int64)
    route, text = column("keys", np.int64), column("z", np.uint8)
    begin = np.cumsum(sizes) - sizes
    number = equal_pieces(text, begin, sizes)
    kinds = int(number.max()) + 1
    first = np.full(kinds, np.iinfo(np.int64).max)
    np.minimum.at(first, number, docs)
    one = np.zeros(kinds, np.int64)  # a piece of each number
    one[number] = np.arange(len(number))
    by, times = np.unique(route[one], return_counts=True)
    met = np.flatnonzero(times[np.searchsorted(by, route[one])] > 1)
    later = docs > first[number]
    out = [(docs[later], starts[later], starts[later] + sizes[later])]
    if len(met):
        met = met[np.lexsort((one[met], route[one[met]]))]
        size = sizes[one[met]]
        least = earliest(text[_spread(begin[one[met]], size)], size, first[met], config)
        owner = np.repeat(np.arange(len(met)), size)
        lost = (least < first[met][owner]).astype(np.int8)
        place = np.arange(len(lost)) - np.repeat(np.cumsum(size) - size, size)
        edge = np.diff(lost, prepend=0) != 0
        edge |= (lost > 0) & (place == 0)
        a = np.flatnonzero(edge & (lost > 0))
        stop = np.flatnonzero((lost > 0) & np.append((lost[1:] == 0) | (place[1:] == 0), True))
        piece, a, b = owner[a], place[a], place[stop] + config.length
        # every first holder of a piece loses its runs
        holders = np.flatnonzero(~later)
        back = np.full(kinds, -1, np.int64)
        back[met] = np.arange(len(met))
        which = back[number[holders]]
        holders, which = holders[which >= 0], which[which >= 0]
        lo, n = np.searchsorted(piece, which), np.bincount(piece, minlength=len(met))[which]
        at = _spread(lo, n)
        holder = np.repeat(holders, n)
        out.append((docs[holder], starts[holder] + a[at], starts[holder] + b[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def removals(found: DataFrame, config: SuffixConfig) -> DataFrame:
    """doc_id, spans (array of start, end; rising, apart) of what pieces() found, shard by shard."""
    unpack = zstandard.ZstdDecompressor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "cell"):
            out = []
            sure = rows.filter(rows["sure"])
            if sure.num_rows:
                docs, starts, sizes = (np.frombuffer(b"".join(unpack().decompress(x.as_buffer()) for x in sure[c]), np.int64) for c in ("docs", "starts", "sizes"))
                out.append((docs, starts, starts + sizes))
            if sure.num_rows < rows.num_rows:
                out.append(solved(rows.filter(pc.invert(rows["sure"])), config))
                trim()
            yield spans_by_doc(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "bucket"):
            flat = rows["spans"].combine_chunks()
            docs = np.repeat(rows["doc_id"].to_numpy(), np.diff(flat.offsets.to_numpy()))
            flat = flat.flatten()
            yield spans_by_doc(docs, flat.field(0).to_numpy(), flat.field(1).to_numpy())

    kind = "doc_id long, spans array<struct<start:bigint,end:bigint>>"
    each = found.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, kind)
    buckets = each.withColumn("bucket", F.shiftright("doc_id", 10)).repartition("bucket").sortWithinPartitions("bucket")
    return buckets.mapInArrow(merge, kind)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def spans_by_doc(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A row for each document with the maximal runs of its spans."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    # the furthest end so far inside each document: ends are shifted apart by document
    base = np.cumsum(new) * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + base)
    opens = new.copy()
    opens[1:] |= start[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(reach[last] - base[last])], ["start", "end"])
    docs = np.flatnonzero(new[first])
    offsets = pa.array(np.append(docs, len(first)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(doc[first][docs]), pa.ListArray.from_arrays(offsets, spans)], ["doc_id", "spans"])


def repeated_spans(texts: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """doc_id, spans of bytes, for the least document of each different text. texts: as different_texts gives them.

    1. Each window of `length` bytes has an anchor, the short string in it with the least hash, and one of two longer strings
    around the anchor; only runs of windows with such a string that another text has too matter.
    2. Pieces of text under these runs are dealt by anchor, so equal windows meet; of equal pieces of a block only the first
    document's one goes.
    3. Shards of different pieces are sorted by external induced sorting; neighbours with `length` bytes in common are equal
    windows, whose least document is known then.
    4. A later document loses a piece that an earlier one holds, and the first holder what other pieces hold before it.
    """
    bits = cell_bits(texts, config.cell)
    shared = checkpoint(shared_keys(key_cells(texts, bits, lambda data, offsets: keys_of(data, offsets, config)), bits))
    shards = 1 << cell_bits(texts, config.shard)
    return removals(pieces(texts, shared, bits, shards, config), config)


def suffix_dedup(docs: DataFrame, config: SuffixConfig = SuffixConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, spans (array of start and end: maximal runs of removed bytes of the UTF-8 text), n_bytes, kept (binary).

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller id; strings are judged on the
    input and never run from one document into the next. Null text is empty. Repeated rows of one id are the same document
    and never remove each other. Of equal texts all but the first lose everything, if they are long enough for a string. Rows with
    a null id stay whole and remove nothing. Ids are whole numbers. Other columns aren't read. An empty table gives no rows. Texts
    of up to 2^28 bytes.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    known = rows.where("doc_id is not null")
    texts = checkpoint(different_texts(known, config.text_block))
    spans = checkpoint(repeated_spans(texts, config))
    first = texts.select("doc_id", "sha").join(spans, "doc_id", "left").select(F.col("doc_id").alias("first"), "sha", "spans")
    both = known.select("doc_id", "sha").distinct().join(checkpoint(first), "sha").select("doc_id", "sha", F.when(F.col("doc_id") == F.col("first"), F.col("spans")).alias("spans"), (F.col("doc_id") != F.col("first")).alias("copy"))
    both = rows.join(both, ["doc_id", "sha"], "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, offs = utf8(part.column(1))
                spans, kept = [], []
                for i, (found, copy) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    text, left, at = data[offs[i] : offs[i + 1]].tobytes(), [], 0
                    runs = [{"start": 0, "end": len(text)}] if copy and len(text) >= config.length else found or []
                    for x in runs:
                        left.append(text[at : x["start"]])
                        at = x["end"]
                    kept.append(b"".join([*left, text[at:]]))
                    spans.append(runs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, SPANS), pa.array(np.diff(offs)), pa.array(kept, pa.binary())], ["doc_id", "spans", "n_bytes", "kept"])

    return both.mapInArrow(cut, "doc_id long, spans array<struct<start:bigint,end:bigint>>, n_bytes long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def removed_bytes(texts: list[tuple[int, bytes]], length: int) -> dict[int, list[bool]]:
    """The definition, by brute force over (id, text) for tests."""
    seen: dict[bytes, int] = {}
    for i, text in texts:
        for k in range(len(text) - length + 1):
            s = text[k : k + length]
            seen[s] = min(i, seen.get(s, i))
    out = {}
    for i, text in texts:
        gone = [False] * len(text)
        for k in range(len(text) - length + 1):
            if seen[text[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out[i] = gone
    return out
