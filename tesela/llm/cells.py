"""Which keys several texts of the corpus hold: different texts in blocks, their keys packed by cell, and what is shared sent back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import ODD, U64, trim, utf8

#: Bits of a hash by which texts with it are counted; a chance match makes a key look more frequent, no more.
KEY_BITS = 48
#: Rows of one block of texts at most, so that a key and a row fit into 64 bits.
BLOCK_ROWS = 1 << 64 - KEY_BITS


def packed(texts: list[bytes]) -> list[bytes]:
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(x) for x in texts]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in a column of packed ones, and the offsets of the rows."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(x.as_buffer()) for x in column]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def different_texts(rows: DataFrame, text_block: int) -> DataFrame:
    """block, doc_id (the least one with the text), sha, size (bytes), z (the packed text): once for each different text.

    rows: doc_id, sha (SHA-256 of the text), text. Copies are grouped by digest and bytes, with a partial result in every task.
    Blocks are stretches of a partition."""
    unique = rows.groupBy("sha", "text").agg(F.min("doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            data, offs = utf8(batch.column(1))
            own = []
            for size in np.diff(offs).tolist():
                if n and (held + size > text_block or n >= BLOCK_ROWS):
                    block, held, n = block + 1, 0, 0
                held, n = held + size, n + 1
                own.append(block)
            raw, at = data.tobytes(), offs.tolist()
            z = packed([raw[a:b] for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column(2), batch.column(0), pa.array(np.diff(offs)), pa.array(z, pa.binary())], ["block", "doc_id", "sha", "size", "z"])

    return unique.select("sha", "text", "doc_id").mapInArrow(run, "block long, doc_id long, sha binary, size long, z binary")


def cell_bits(texts: DataFrame, size: int) -> int:
    """Bits of keys that tell cells apart, so that a cell holds the keys of about `size` bytes of texts."""
    total = texts.agg(F.sum("size")).first()[0] or 0
    return min(24, max(0, (total // size).bit_length()))


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of one key at a time, from rows that come with equal keys together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            own = tuple(x[a] for x in columns)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def write_keys(keys: np.ndarray, base: int) -> bytes:
    """Rising keys (base is under the first) as steps of as few bytes as the largest one takes. All lowest bytes come first, then
    all next ones, so that the highest, mostly empty ones are compressed in the shuffle."""
    steps = np.diff(keys, prepend=U64(base))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def read_keys(raw: bytes, n: int, base: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    steps[:, : len(planes)] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64) + U64(base)


def found_in(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each key its place in the sorted array `some`, or -1. Most are ruled out by 16 bits for each of `some` at once."""
    out = np.full(len(keys), -1, np.int64)
    if not len(some):
        return out
    slots = U64(1 << max(10, int(len(some)).bit_length() + 4))
    flags = np.zeros(int(slots), bool)
    flags[(some * ODD >> U64(20)) % slots] = True
    maybe = np.flatnonzero(flags[(keys * ODD >> U64(20)) % slots])
    at = np.minimum(np.searchsorted(some, keys[maybe]), len(some) - 1)
    hit = some[at] == keys[maybe]
    out[maybe[hit]] = at[hit]
    return out


def key_cells(texts: DataFrame, bits: int, keys_of: Callable) -> DataFrame:
    """cell, block, keys, counts: the keys of each block of texts and, up to 255, how many of its texts hold each; a cell is all
    keys with the same first bits. keys_of gives 64-bit hashes of a block (bytes, offsets of its rows) and the row of each."""
    shift = KEY_BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "block"):
            block = rows["block"][0].as_py()
            h, row = keys_of(*unpacked(rows["z"]))
            both = (h >> U64(64 - KEY_BITS) << U64(64 - KEY_BITS)) | row.astype(U64)
            both.sort()
            both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            keys = both >> U64(64 - KEY_BITS)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            keys, counts = keys[first], np.minimum(np.diff(np.append(first, len(keys))), 255).astype(np.uint8)
            cell = (keys >> U64(shift)).astype(np.int64)
            edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-2)).tolist()
            out = [[], [], []]
            for a, b in zip(edges, edges[1:]):
                out[0].append(int(cell[a]))
                out[1].append(write_keys(keys[a:b], int(cell[a]) << shift))
                out[2].append(counts[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([block] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["cell", "block", "keys", "counts"])

    return texts.select("block", "z").mapInArrow(run, "cell long, block long, keys binary, counts binary")


def shared_keys(cells: DataFrame, bits: int) -> DataFrame:
    """block, cell, keys, ranks: the keys of each block that several texts of the corpus hold, and a rank that grows with how
    many do: four steps for each doubling."""
    shift = KEY_BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "cell"):
            base = rows["cell"][0].as_py() << shift
            counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows["counts"]]
            keys = [read_keys(x.as_buffer(), len(n), base) for x, n in zip(rows["keys"], counts, strict=True)]
            every = np.concatenate(keys)
            again = [k[n > 1] for k, n in zip(keys, counts, strict=True)]
            times = np.concatenate([n[n > 1] for n in counts]).astype(np.int64) - 1
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            df = np.diff(np.append(first, len(every)))
            some = every[first]
            np.add.at(df, np.searchsorted(some, np.concatenate(again)), times)
            some, df = some[df > 1], df[df > 1]
            rank = np.minimum(np.floor(4 * np.log2(df)), 255).astype(np.uint8)
            out = [[], [], []]
            for block, k in zip(rows["block"].to_pylist(), keys, strict=True):
                at = found_in(k, some)
                at = at[at >= 0]
                if len(at):
                    out[0].append(block)
                    out[1].append(write_keys(some[at], base))
                    out[2].append(rank[at].tobytes())
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([rows["cell"][0].as_py()] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["block", "cell", "keys", "ranks"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "block long, cell long, keys binary, ranks binary")
