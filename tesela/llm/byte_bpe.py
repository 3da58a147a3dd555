"""Byte-level BPE by a public rank file: long texts in overlapping chunks that are stitched, decoding by raw bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from tesela.llm.common import table

#: Characters in a chunk and characters that it shares with the next one.
CHUNK, OVERLAP = 32_768, 512


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, start: int, stop: int, pattern: str) -> list[int]:
    """Ends of the pre-tokens of text[start:stop], as positions in the text."""
    return [m.end() for m in regex.finditer(pattern, text, pos=start, endpos=stop)]


def cuts(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Positions where the text can be cut without changing a pre-token, the end included.

    Chunks begin `chunk` characters apart and run `overlap` into their successors. Each is pre-tokenised on its own, once,
    whatever the others find. Two neighbours are stitched at the first boundary in their overlap that both have, behind an
    ASCII letter and before a space or line feed: there a pre-token ends whatever stands around it, and in every edition of
    Unicode, so that the encoder, whose tables are not those of `regex`, ends one there too. Where neighbours share no such
    boundary (in a long run, or in scripts without spaces) they stay one piece.
    """
    n = len(text)
    out, known = [], None
    for begin in range(0, n, chunk):
        if begin and n - begin <= overlap:
            break
        own = boundaries(text, begin, min(n, begin + chunk + overlap), pattern)
        if known is not None:
            near = (b for b in own if begin < b < begin + overlap and b in known)
            met = next((b for b in near if text[b - 1].isascii() and text[b - 1].isalpha() and text[b] in " \n"), None)
            if met is not None:
                out.append(met)
        known = {b for b in own if b > begin + chunk}
    return [*out, n]


def encode(text: str, enc: tiktoken.Encoding, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    if len(text) <= chunk + overlap:
        return enc.encode_ordinary(text)
    ids, a = [], 0
    for b in cuts(text, pattern, chunk, overlap):
        ids += enc.encode_ordinary(text[a:b])
        a = b
    return ids


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(ids)


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: id, ids (array of int) and decoded (the bytes behind the ids). No shuffle.

    Null text and empty text give no ids and no bytes. Texts of any length are cut into chunks. Repeated rows and null
    ids stay as they are; other columns are not read. The rank file must be at `path` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [encode(x or "", enc, pattern, chunk, overlap) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, enc) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what byte_bpe returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = [str(i) for i in range(1 << 16)]
        for batch in batches:
            flat, at = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            flat, at = flat.tolist(), (at - at[0]).tolist()
            if flat and max(flat) >= len(decimal):
                decimal = [str(i) for i in range(max(flat) + 1)]
            sha = [hashlib.sha256(",".join([decimal[i] for i in flat[a:b]]).encode()).hexdigest() for a, b in zip(at, at[1:])]
            raw = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b - a for a, b in zip(at, at[1:])], pa.int64()), pa.array(sha, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, f"doc_id {encoded.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return digests(byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
