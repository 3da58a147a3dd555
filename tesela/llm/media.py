"""Media columns: bytes as PNG, read back through checked chunks, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesela.llm.common import table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Side of the picture that the cosine transform sees and of the block of low frequencies that is kept.
SIDE, LOW = 32, 8
#: Rows of a picture that are worked on at once, so that a long text takes a few bytes of memory for each of its own.
STRETCH = 1 << 14


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(samples: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey picture (rows x columns) as PNG; each row takes the filter of none, sub and up with the least sum."""
    rows = samples.astype(np.uint8)
    lines = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    for a in range(0, len(rows), STRETCH):
        own = rows[a : a + STRETCH]
        left, above = np.zeros_like(own), np.zeros_like(own)
        left[:, 1:] = own[:, :-1]
        above[0] = rows[a - 1] if a else 0
        above[1:] = own[:-1]
        tried = np.stack([own, own - left, own - above])
        cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
        kind = cost.argmin(axis=0)
        lines[a : a + STRETCH, 0] = kind
        lines[a : a + STRETCH, 1:] = tried[kind, np.arange(len(own))]
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG; a bad signature, length or checksum is a ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data):
            raise ValueError("a chunk is cut short")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum in {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("no end")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters of an 8-bit grey picture. Runs of rows with one of the first three filters go at once."""
    out = rows.copy()
    sub = np.flatnonzero(kinds == 1)
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint64).astype(np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):
        kind = kinds[a] if b > a else 0
        if kind == 2:
            out[a:b] = (np.cumsum(rows[a:b], axis=0, dtype=np.uint64) + (out[a - 1] if a else 0)).astype(np.uint8)
        elif kind in (3, 4):
            for i in range(a, b):
                above = out[i - 1].astype(int) if i else np.zeros(rows.shape[1], int)
                left = corner = 0
                for j in range(rows.shape[1]):
                    up = above[j]
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    left, corner = (int(rows[i, j]) + guess) & 255, up
                    out[i, j] = left
        elif kind > 4:
            raise ValueError(f"unknown filter {kind}")
    return out


def png_decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace; anything damaged is a ValueError."""
    head, body, closed = None, [], False
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        closed |= kind == b"IEND"
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not closed:
        raise ValueError("not an 8-bit grey picture")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    lines = raw.reshape(head[1], head[0] + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(k), np.arange(n) + 0.5))


_DCT = _cosines(SIDE, LOW)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 cosine frequencies of the picture, shrunk to 32 x 32, lie above their median."""
    rows, cols = samples.shape
    def edges(n: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(SIDE) * n // SIDE
        return a, np.maximum(a + 1, (np.arange(SIDE) + 1) * n // SIDE)

    (ra, rb), (ca, cb) = edges(rows), edges(cols)
    if rows > STRETCH:  # the same whole numbers without sums at every row
        below = np.stack([samples[a:b].sum(axis=0, dtype=np.float64) for a, b in zip(ra, rb)])
    else:
        area = np.zeros((rows + 1, cols))
        area[1:] = samples.cumsum(axis=0, dtype=np.float64)
        below = area[rb] - area[ra]
    across = np.zeros((SIDE, cols + 1))
    across[:, 1:] = below.cumsum(axis=1)
    total = across[:, cb] - across[:, ca]
    small = total / np.outer(rb - ra, cb - ca)
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """Per row: id, n_bytes, media (PNG), payload (read back from it) and phash (8 bytes). No shuffle.

    Null and empty text give one row of 64 zero samples. Equal texts give equal values. Repeated rows and null ids stay;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    data, n = payload(text)
                    media = png_encode(np.frombuffer(data, np.uint8).reshape(-1, WIDTH), level)
                    back = png_decode(media)
                    rows.append((n, media, back.tobytes(), cosine_hash(back)))
                n, media, back, phash = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.array(phash, pa.binary())], ["doc_id", "n_bytes", "media", "payload", "phash"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary, payload binary, phash binary")


def digests(media: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, stored = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(len, raw), pa.int64()), sha(raw), pa.array([zlib.crc32(x[-64:]) for x in raw], pa.int64()), pa.array(map(len, stored), pa.int64()), sha(stored), pa.array([x.hex() for x in batch.column(4).to_pylist()], pa.string())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, f"doc_id {media.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media_columns(table(spark, sf_dir, "documents")))
