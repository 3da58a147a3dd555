"""Line deduplication by pairwise alignment: shared rare lines find the pairs, patience diff aligns them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import checkpoint, table


@dataclass(frozen=True)
class LineConfig:
    """min_chars: a single line of fewer characters is no evidence by itself, only together with its neighbour, and an aligned
    block with fewer stays. min_block: lines that an aligned block needs to be deleted. small: cells of the table by which lines
    without an anchor are aligned; larger stretches are aligned greedily."""

    min_chars: int = 20
    min_block: int = 1
    small: int = 1 << 16


def line_units(text: str, min_chars: int) -> set[bytes]:
    """Digests of the units by which documents with common lines are found: lines, and pairs of neighbouring lines of which one
    is too short to be a unit itself. Blank lines are no units of their own."""
    lines = [x.strip() for x in text.split("\n")]
    digests = [xxhash.xxh3_128_digest(x) for x in lines]
    size = [len(x) for x in lines]
    found = {d for d, n in zip(digests, size, strict=True) if n >= min_chars}
    found.update(xxhash.xxh3_128_digest(digests[i] + digests[i + 1]) for i in range(len(lines) - 1) if min(size[i], size[i + 1]) < min_chars <= size[i] + size[i + 1])
    return found


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (line here, line there) that rises on both sides; pairs come sorted, each line once."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, there) in enumerate(pairs):
        i = bisect_left(tails, there)
        back[k] = last[i - 1] if i else -1
        tails[i : i + 1] = [there]
        last[i : i + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_lines(a: list[int], b: list[int], small: int) -> list[tuple[int, int]]:
    """Pairs of places of a common subsequence without anchors: the longest one, or in large stretches a greedy one, which takes
    the next equal line from here on."""
    if len(a) * len(b) <= small:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out, j = [], 0
    for i, x in enumerate(a):
        own = places.get(x, ())
        k = bisect_left(own, j)
        if k < len(own):
            out.append((i, own[k]))
            j = own[k] + 1
    return out


def patience_diff(a: list[int], b: list[int], small: int = 1 << 16) -> list[tuple[int, int]]:
    """Pairs of places of aligned equal lines, rising on both sides. Equal ends of a stretch are aligned first; then lines that
    occur once on each side are anchors as far as they rise on both, and the stretches between them are aligned alike."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        here, there = Counter(a[lo:hi]), Counter(b[low:high])
        at = {x: j for j, x in enumerate(b[low:high], low) if there[x] == 1}
        anchors = patience([(i, at[x]) for i, x in enumerate(a[lo:hi], lo) if here[x] == 1 and x in at])
        if not anchors:
            out += [(lo + i, low + j) for i, j in common_lines(a[lo:hi], b[low:high], small)]
            continue
        out += anchors
        edges = [(lo - 1, low - 1), *anchors, (hi, high)]
        todo += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:])]
    return sorted(out)


def aligned(a: list[int], b: list[int], chars: list[int], config: LineConfig) -> list[int]:
    """Lines of the later document (a; chars: their characters) in blocks that are aligned with the earlier one."""
    out: list[int] = []
    run: list[int] = []
    last = None
    for i, j in [*patience_diff(a, b, config.small), (len(a) + 1, 0)]:
        if run and (i, j) != (last[0] + 1, last[1] + 1):
            if len(run) >= config.min_block and sum(chars[k] for k in run) >= config.min_chars:
                out += run
            run = []
        run.append(i)
        last = i, j
    return out


def line_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hashes and chars of its lines without white space around them; once for each id."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lines = [[x.strip() for x in (text or "").split("\n")] for text in part.column(1).to_pylist()]
                at = pa.array(np.cumsum([0, *map(len, lines)]), pa.int32())
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for own in lines for x in own], np.uint64).view(np.int64)
                chars = np.array([len(x) for own in lines for x in own], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(hashes)), pa.ListArray.from_arrays(at, pa.array(chars))], ["doc_id", "hashes", "chars"])

    rows = docs.where(docs[id_col].isNotNull()).select(id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, hashes array<long>, chars array<int>").dropDuplicates(["doc_id"])


def removed_lines(docs: DataFrame, config: LineConfig = LineConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, partners (array of ids of the earlier documents, the one with the rarest shared unit first), lines (array of int)
    and spans of them (array of start, end): what goes.

    A unit that several documents share pairs each later one with the earliest holder, so pairs grow with the number of
    lines, not with the square of a line's frequency, and no line is too frequent to count. Units only find the pairs: whole
    documents are aligned, once for each pair, with their repeated and short lines. Holders and frequencies are pre-aggregated
    in every task and cut in the shared folder, one row for each shared unit, and so are pairs and lines, so that Spark's
    adaptive execution can split hot units and hot partners in the joins.
    """
    kind = dict(docs.dtypes)[id_col]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                row, found = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = line_units(text or "", config.min_chars)
                    row += [i] * len(own)
                    found += own
                d = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(d[:, 0]), pa.array(d[:, 1])], ["doc_id", "d1", "d2"])

    units = docs.select(id_col, text_col).mapInArrow(explode, f"doc_id {kind}, d1 long, d2 long").where("doc_id is not null")
    first = units.groupBy("d1", "d2").agg(F.min("doc_id").alias("partner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("df")).where("partner < last").drop("last")
    pairs = units.join(checkpoint(first), ["d1", "d2"]).where(F.col("doc_id") > F.col("partner")).groupBy("doc_id", "partner").agg(F.min("df").alias("df"))
    pairs = checkpoint(pairs)
    lines = checkpoint(line_sequences(docs, id_col, text_col))
    theirs = lines.select(F.col("doc_id").alias("partner"), F.col("hashes").alias("theirs"))
    both = pairs.join(theirs, "partner").join(lines, "doc_id").select("doc_id", "partner", "df", "hashes", "theirs", "chars")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                gone = [aligned(a, b, c, config) for a, b, c in zip(*(part.column(x).to_pylist() for x in ("hashes", "theirs", "chars")), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.select(["doc_id", "partner", "df"]).columns, pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "partner", "df", "lines"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            partners, lines, spans = [], [], []
            for found in batch.column(1).to_pylist():
                own = sorted(set().union(*(x["lines"] for x in found)))
                edges = [k for k in range(len(own)) if not k or own[k] != own[k - 1] + 1]
                partners.append([x["partner"] for x in found])
                lines.append(own)
                spans.append([{"start": own[a], "end": own[b - 1] + 1} for a, b in zip(edges, [*edges[1:], len(own)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(partners, pa.list_(batch.column(0).type)), pa.array(lines, pa.list_(pa.int32())), pa.array(spans, SPANS)], ["doc_id", "partners", "lines", "spans"])

    found = both.mapInArrow(align, f"doc_id {kind}, partner {kind}, df long, lines array<int>").where(F.size("lines") > 0)
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "partner", "lines"))).alias("found"))
    return found.mapInArrow(gather, f"doc_id {kind}, partners array<{kind}>, lines array<int>, spans array<struct<start:int,end:int>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def line_dedup(docs: DataFrame, config: LineConfig = LineConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with text without the aligned lines, and partners and lines beside it.

    A document loses the blocks of lines that align, by patience diff, with those of earlier documents (smaller ids) that
    hold one of its lines first; the earliest holder of a line keeps it. Null text stays null, and an emptied text is the empty string. Repeated rows of one id are the same document.
    Rows with a null id stay whole. Columns named like those that are added are replaced in the result. An empty table
    gives no rows.
    """
    gone = removed_lines(docs, config, id_col, text_col).select(F.col("doc_id").alias("__line_doc"), F.col("partners").alias("__partners"), F.col("lines").alias("__lines"), F.col("spans").alias("__spans"))
    both = docs.join(gone, docs[id_col] == F.col("__line_doc"), "left")
    spans = F.col("__spans")
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get(spans, j - 1)["end"])
    end = lambda j, lines: F.when(j == F.size(spans), F.size(lines)).otherwise(F.get(spans, j)["start"])
    between = lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda j: F.slice(lines, begin(j) + 1, end(j, lines) - begin(j))))
    left = F.array_join(F.get(F.transform(F.array(F.split(F.col(text_col), "\n", -1)), between), F.lit(0)), "\n")
    text = F.when(spans.isNull(), F.col(text_col)).otherwise(left)
    own = [F.col(x) for x in docs.columns if x not in (text_col, "partners", "lines")]
    return both.select(*own, text.alias(text_col), F.col("__partners").alias("partners"), F.col("__lines").alias("lines"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<int>")
    return line_dedup(docs).select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"), F.array_join(F.coalesce("lines", none).cast("array<string>"), ",").alias("lines"), F.sha2("text", 256).alias("kept_sha256"))
