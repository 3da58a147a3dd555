"""What the training-data operators share: table reading, lineage cuts and byte-level views of Arrow text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that the vectorised code works on at once; arrays of eight bytes a character follow from it.
BLOCK_BYTES = 2 << 20


def trim() -> None:
    """Freed memory goes back to the system, as several workers share an executor's; without glibc only Arrow's does."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the cluster's shared checkpoint folder, so that the loss of an executor loses no rows.

    The folder is the session's spark.checkpoint.dir; only where none is set and the driver runs all tasks itself (local tests)
    a temporary one is made. Then the driver collects garbage, upon which Spark deletes the shuffle files that only the cut lineage needed; they would stay until
    the driver's heap happens to fill.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesela-checkpoint-"))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    context._jvm.System.gc()
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as its bytes and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row makes a block of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


ODD = U64(0x9E3779B97F4A7C15)
#: Masks of the first k bytes of a lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a word up to which lanes are mixed for many words at once; longer words are hashed one by one.
LONG_WORD = 64


#: Word breaks: space, tab, line feed, vertical tab, form feed, carriage return.
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, in order, and the offsets of the rows in them."""
    hashes, at = word_places(data, offsets, lower)
    return hashes, np.searchsorted(at, offsets).astype(np.int64)


def word_edges(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words of all rows; a row's end ends a word. breaks: which bytes part words."""
    n = len(data)
    solid = ~breaks[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge], ends[edge - 1] = solid[edge], solid[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_places(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, in order, and the bytes where they begin."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    at, to = word_edges(data, offsets, breaks)
    return hash_words(data, at, to), at


def hash_words(data: np.ndarray, at: np.ndarray, to: np.ndarray, long: int = LONG_WORD) -> np.ndarray:
    """64-bit hashes of data[at:to] for each pair. Lanes of eight bytes are mixed, each into what the lanes before it gave, so
    that no arrangement of equal letters cancels out; words of over `long` bytes get XXH3."""
    size = to - at
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(size.astype(U64) * ODD ^ (lanes[at] & _FIRST[np.minimum(size, 8)]))
    left, k = np.flatnonzero((size > 8) & (size <= long)), 8
    while len(left):
        out[left] = mix((out[left] + ODD) ^ (lanes[at[left] + k] & _FIRST[np.minimum(size[left] - k, 8)]))
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > long).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : to[i]])
    return out


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences inside a row and the row of each; a row of one to n-1 words gives its whole sequence."""
    counts = np.diff(offsets)
    factors = [U64((0xD6E8FEB86659FD93 * (2 * k + 3) ** 7 | 1) & (1 << 64) - 1) for k in range(n)]
    row = np.repeat(np.arange(len(counts)), counts)
    m = max(0, len(hashes) - n + 1)
    summed = np.zeros(m, U64)
    for k in range(n):
        summed += hashes[k : k + m] * factors[k]
    inside = offsets[1:][row[:m]] - np.arange(m) >= n
    found, rows = mix(summed[inside] + U64(n)), row[:m][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return found, rows
    whole = counts[short].astype(U64)
    for k in range(n - 1):
        some = counts[short] > k
        whole[some] += hashes[offsets[short[some]] + k] * factors[k]
    order = np.argsort(np.concatenate([rows, short]), kind="stable")
    return np.concatenate([found, mix(whole)])[order], np.concatenate([rows, short])[order]
