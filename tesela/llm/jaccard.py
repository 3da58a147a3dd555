"""Exact n-gram Jaccard join: lists in blocks by size and position, rare shingles first, answers carried over between similar sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.cells import KEY_BITS, cell_bits, different_texts, found_in, grouped, key_cells, read_keys, shared_keys, unpacked
from tesela.llm.common import ODD, U64, blocks, checkpoint, mix, ngrams, table, trim, utf8, words


@dataclass(frozen=True)
class JaccardConfig:
    """n: words of a shingle. percent: least similarity. block: entries of a list whose sizes and positions are looked at as
    one block. text_block: bytes of texts that are counted together. cell: bytes of texts whose shingles are counted in one
    group. part: sets of a component whose links one task counts. star: partners of a set that one task compares."""

    n: int = 5
    percent: int = 75
    block: int = 64
    text_block: int = 1 << 20
    cell: int = 8 << 20
    part: int = 2048
    star: int = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the offsets of the rows in them."""
    h, row = ngrams(*words(data, offsets), n)
    at = np.searchsorted(row, np.arange(len(offsets)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def least_overlap(a, b, percent: int):
    """The least intersection of sets of sizes a and b that link: ceil(percent * (a + b) / (100 + percent))."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(size, percent: int):
    """How many of a set's first tokens hold one that each of its partners shares."""
    return size - -(-percent * size // 100) + 1


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """n_shingles of rows with a text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for a, b in blocks(offs):
                _, at = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at))], ["n_shingles"])

    return docs.mapInArrow(run, "n_shingles long")


def sketch_bytes(size: np.ndarray) -> np.ndarray:
    """Bytes of a set's sketch: a power of two of bits, two to four for each token, 64 bits at least."""
    return 1 << np.maximum(3, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) - 2)


def sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set the parity of its tokens in each of the places that a hash of them gives. Sketches of two sets differ in as
    many places as the sets do, or fewer; folding a sketch in half gives the one of half its size."""
    size = np.diff(at)
    width = sketch_bytes(size)
    row = np.repeat(np.arange(len(size)), size)
    bit = (mix(h + ODD) % (width[row] * 8).astype(U64)).astype(np.int64)
    ends = np.cumsum(width)
    flat = np.bincount((ends - width)[row] * 8 + bit, minlength=int(ends[-1]) * 8 if len(ends) else 0)
    bits = np.packbits((flat & 1).astype(np.uint8), bitorder="little").tobytes()
    return [bits[e - w : e] for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def least_difference(x: bytes, y: bytes) -> int:
    """A bound from below of the tokens in one of two sets only, from their sketches."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


FOUND = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("sketch", pa.binary())])


def list_entries(texts: DataFrame, keys: DataFrame, bits: int, config: JaccardConfig) -> DataFrame:
    """token, doc_id, size, pos, sketch. Rows with a token are entries of its list: it is among the first tokens of the set, in
    the order of (rank, hash), and several texts hold its key. Rows without one tell each set's size and, if it has entries,
    its sketch. Tokens that one text alone holds come first of all and need no list."""
    shift = KEY_BITS - bits
    own = texts.select("block", F.lit(1).alias("kind"), "doc_id", "z", F.lit(None).cast("binary").alias("ranks"))
    theirs = keys.select("block", F.lit(0).alias("kind"), F.col("cell").alias("doc_id"), F.col("keys").alias("z"), "ranks")
    rows = own.unionByName(theirs).repartition("block").sortWithinPartitions("block", "kind", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "block"):
            n = int((part["kind"].to_numpy() == 0).sum())
            known, part = part.slice(0, n), part.slice(n)
            ranks = [np.frombuffer(x.as_buffer(), np.uint8) for x in known["ranks"]]
            some = [read_keys(x.as_buffer(), len(r), c << shift) for x, r, c in zip(known["z"], ranks, known["doc_id"].to_pylist(), strict=True)]
            some, ranks = np.concatenate([np.zeros(0, U64), *some]), np.concatenate([np.zeros(0, np.uint8), *ranks])
            h, at = shingle_sets(*unpacked(part["z"]), config.n)
            size, doc = np.diff(at), part["doc_id"].to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            place = found_in(h >> U64(64 - KEY_BITS), some)
            shared = np.flatnonzero(place >= 0)
            token, row = h[shared], row[shared]
            order = np.lexsort((token, ranks[place[shared]], row))
            token, row = token[order], row[order]
            begin = np.searchsorted(row, np.arange(len(size) + 1))
            pos = np.arange(len(row)) - begin[:-1][row] + (size - np.diff(begin))[row]
            keep = pos < prefix_size(size, config.percent)[row]
            token, row, pos = token[keep], row[keep], pos[keep]
            listed = np.unique(row)
            inside = np.zeros(len(size), bool)
            inside[listed] = True
            some_h = h[np.repeat(inside, size)]
            found = sketches(some_h, np.concatenate([[0], np.cumsum(size[listed])]))
            by_row = dict(zip(listed.tolist(), found, strict=True))
            m = len(size)
            none = np.zeros(len(row), bool)
            columns = [
                pa.concat_arrays([pa.array(token.view(np.int64)), pa.nulls(m, pa.int64())]),
                pa.array(np.concatenate([doc[row], doc])),
                pa.array(np.concatenate([size[row], size]).astype(np.int32)),
                pa.array(np.concatenate([pos, np.zeros(m, np.int64)]).astype(np.int32)),
                pa.array([None] * len(none) + [by_row.get(i) for i in range(m)], pa.binary()),
            ]
            out = pa.RecordBatch.from_arrays(columns, schema=FOUND)
            for a in range(0, out.num_rows, 20_000):
                yield out.slice(a, 20_000)
            trim()

    return rows.mapInArrow(run, "token long, doc_id long, size int, pos int, sketch binary")


def whole_lists(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by the first one, some whole lists of equal values at a time."""
    rest = [np.zeros(0, np.int64) for _ in names]
    for batch in batches:
        columns = [np.concatenate([r, batch.column(c).to_numpy().astype(np.int64)]) for r, c in zip(rest, names, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        rest = [x[cut:] for x in columns]
        if cut:
            yield [x[:cut] for x in columns]
    if len(rest[0]):
        yield rest


def block_pairs(size: np.ndarray, pos: np.ndarray, comp: np.ndarray, config: JaccardConfig) -> Iterator[tuple[int, np.ndarray]]:
    """Candidate pairs of one token's list, sorted by (size, pos): an entry and its partners further on in other components.

    At the first token that two sets share, at places i and j in sets of sizes a <= b, at most 1 + min(a - i - 1, b - j - 1)
    tokens are shared. So a partner's size is bounded by the entry's, and its position by both; blocks whose least size or
    position is beyond the bound are skipped as a whole."""
    percent, block = config.percent, config.block
    own = size - pos
    last = np.searchsorted(size, 100 * size // percent, "right")
    for k in np.flatnonzero((own >= least_overlap(size, size, percent)) & (last > np.arange(len(size)) + 1)).tolist():
        for s in range(k + 1, int(last[k]), block):
            e = min(s + block, int(last[k]))
            need = least_overlap(int(size[k]), size[s:e], percent)
            if own[k] < need[0]:
                break
            ok = (own[k] >= need) & (own[s:e] >= need) & (comp[s:e] != comp[k])
            if ok.any():
                yield k, s + np.flatnonzero(ok)


#: Documents of a list that its other entries are compared with in the first round.
HUBS = 16


def star_pairs(entries: DataFrame, config: JaccardConfig) -> DataFrame:
    """a, b, part: every entry of a list with the list's first document, or with the first of some whose size and place allow a
    link. part numbers stretches of a document's partners.

    One pass over lists sorted by document; of a list, HUBS documents are held, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hubs, seen = None, [], 0
        for batch in batches:
            token, doc, size, pos = (batch.column(c).to_numpy().astype(np.int64) for c in ("token", "doc_id", "size", "pos"))
            edges = np.append(np.flatnonzero(np.diff(token, prepend=token[0] - 1 if len(token) else 0)), len(token))
            place = np.arange(len(token)) - np.repeat(edges[:-1], np.diff(edges))
            carried = int(edges[1]) if len(token) and token[0] == last else 0
            place[:carried] += seen
            pairs = []

            def compare(at: np.ndarray, hub) -> np.ndarray:
                """Which of the entries fit a hub each (arrays of doc, size, pos); the pairs are noted."""
                h_doc, h_size, h_pos = hub
                need = least_overlap(size[at], h_size, config.percent)
                fits = (doc[at] != h_doc) & (np.minimum(size[at] - pos[at], h_size - h_pos) >= need) & (100 * np.minimum(size[at], h_size) >= config.percent * np.maximum(size[at], h_size))
                some = at[fits]
                pairs.append((np.broadcast_to(h_doc, at.shape)[fits], doc[some], place[some] // config.star))
                return at[~fits & (doc[at] != h_doc)]

            left = np.arange(carried)
            for hub in hubs if carried else ():
                left = compare(left, hub)
            used = np.zeros(len(token), np.int64)
            used[:carried] = len(hubs) if carried else 0
            if not carried:
                hubs, seen = [], 0
            left = np.concatenate([left, np.arange(carried, len(token))])
            while len(left := left[used[left] < HUBS]):
                opens = np.flatnonzero(np.diff(token[left], prepend=token[left[0]] - 1))
                own = np.repeat(left[opens], np.diff(np.append(opens, len(left))))
                if token[left[opens[-1]]] == token[-1]:
                    k = left[opens[-1]]
                    if token[k] != last:
                        hubs, last = [], token[k]
                    hubs.append((doc[k], size[k], pos[k]))
                used[left] += 1
                left = compare(left, (doc[own], size[own], pos[own]))
            if len(token):
                if token[-1] != last:
                    hubs = []
                last = token[-1]
                seen = int(place[-1]) + 1
            a, b, part = (np.concatenate(x) if pairs else np.zeros(0, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((),) * 3))
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"a": a, "b": b, "part": part}).groupby(["a", "b"], as_index=False)["part"].min(), preserve_index=False)

    lists = entries.repartition("token").sortWithinPartitions("token", "doc_id")
    return lists.mapInArrow(run, "a long, b long, part long").groupBy("a", "b").agg(F.min("part").alias("part"))


def open_pairs(labelled: DataFrame, config: JaccardConfig) -> DataFrame:
    """a, b, part: all pairs of a list that the bounds allow and whose sets aren't in one component yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, doc, size, pos, comp in whole_lists(batches, "token", "doc_id", "size", "pos", "comp"):
            edges = np.append(np.flatnonzero(np.diff(token, prepend=token[0] - 1)), len(token))
            a, b, part = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                for k, far in block_pairs(size[lo:hi], pos[lo:hi], comp[lo:hi], config):
                    far = far[doc[lo + far] != doc[lo + k]]
                    a.append(np.full(len(far), doc[lo + k]))
                    b.append(doc[lo + far])
                    part.append(np.arange(len(far)) // config.star)
            a, b, part = map(np.concatenate, (a, b, part))
            pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "part": part}).groupby(["a", "b"], as_index=False)["part"].min()
            yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)

    return labelled.mapInArrow(run, "a long, b long, part long").groupBy("a", "b").agg(F.min("part").alias("part"))


def links(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, config: JaccardConfig) -> DataFrame:
    """The pairs that link. Where the sketches differ in more places than linked sets can, they don't; else both whole sets are
    compared. A set is sent once for each of its parts, its partners once for each pair, as packed texts."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
            most = a + b - 2 * least_overlap(a, b, config.percent)
            differ = [least_difference(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            ok = pa.array(np.array(differ, np.int64) <= most)
            yield batch.select(["a", "b", "part"]).filter(ok)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, U64)
        for batch in batches:
            first, second = [], []
            end = np.cumsum([0, *(len(x.as_buffer()) for x in batch.column("z"))])
            for lo, hi in blocks(end, 1 << 19):
                part = batch.slice(lo, hi - lo)
                h, at = shingle_sets(*unpacked(part.column("z")), config.n)
                for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    own = h[at[i] : at[i + 1]]
                    if b is None:
                        centre = own.copy()
                    else:
                        both = int((centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own).sum()) if len(centre) else 0
                        if 100 * both >= config.percent * (len(own) + len(centre) - both):
                            first.append(a)
                            second.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])
            trim()

    left = sizes.select(F.col("doc_id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    right = sizes.select(F.col("doc_id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    pairs = checkpoint(pairs.join(left, "a").join(right, "b").select("a", "b", "part", "na", "sa", "nb", "sb").mapInArrow(likely, "a long, b long, part long"))
    z = texts.select("doc_id", "z")
    partners = pairs.join(z.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "z")
    centres = pairs.select("a", "part").distinct().join(z.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "z")
    rows = centres.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "z").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, comp: the smallest document that each document with an edge reaches. Labels spread along the edges and jump
    to their labels' labels until none changes; every round is cut in the shared folder."""
    both = checkpoint(edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct())
    labels = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("doc_id"), F.least("u", "m").alias("comp")))
    while True:
        near = both.join(labels, both["v"] == labels["doc_id"]).groupBy("u").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels["doc_id"] == near["u"], "left").select("doc_id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("doc_id").alias("k"), F.col("comp").alias("far"))
        grown = spread.join(jump, spread["comp"] == jump["k"], "left").select("doc_id", "old", F.least("comp", "far").alias("comp"))
        grown = checkpoint(grown)
        changed = grown.where("old != comp").limit(1).count()
        labels = grown.select("doc_id", "comp")
        if not changed:
            return labels


def linked_copies(sets: list[np.ndarray], copies: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """For each place in own, the copies of all different sets that link with the set there, itself among them.

    The tokens that most of the sets hold stand in for one set like all of them. Each set is known by its difference from it,
    and the overlap of two sets follows from the overlap of their differences: common - lacks of both + shared difference."""
    k, size = len(sets), np.array([len(x) for x in sets])
    token, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(k), size)
    place = np.where(2 * df > k, np.cumsum(2 * df > k) - 1, -1)[ids]
    common = int((2 * df > k).sum())
    present = np.zeros((common, k), bool)
    present[place[place >= 0], member[place >= 0]] = True
    lack, lacks = np.nonzero(~present)
    missing = np.bincount(lacks, minlength=k)
    rare = place < 0
    key, who = np.concatenate([ids[rare] + common, lack]), np.concatenate([member[rare], lacks])
    order = np.argsort(key, kind="stable")
    _, start, width = np.unique(key[order], return_index=True, return_counts=True)
    held = who[order]
    entry = np.repeat(np.arange(len(start)), width)
    by = np.argsort(held, kind="stable")
    edges = np.searchsorted(held[by], np.arange(k + 1))
    out = np.zeros(len(own), np.int64)
    for i, a in enumerate(own):
        lists = entry[by[edges[a] : edges[a + 1]]]
        n = width[lists]
        at = np.repeat(start[lists] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = common - missing[a] - missing + np.bincount(held[at], minlength=k)
        out[i] = copies[100 * both >= percent * (size[a] + size - both)].sum()
    return out


def link_counts(labels: DataFrame, copies: DataFrame, texts: DataFrame, config: JaccardConfig) -> DataFrame:
    """doc_id, linked: the documents whose sets link with each set that has an edge, its own copies among them.

    All links are inside components (labels: doc_id, comp). A task counts for `part` sets of one component, and holds the whole
    component; larger components go to several tasks. No pairs are written."""
    parts = labels.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / config.part).cast("int").alias("parts"))
    rows = labels.join(parts, "comp").join(copies, "doc_id").join(texts.select("doc_id", "z"), "doc_id")
    rows = rows.select("comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("home"), "doc_id", "copies", "z")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "comp", "part"):
            own = np.flatnonzero(group["home"].to_numpy() == group["part"].to_numpy())
            h, at = shingle_sets(*unpacked(group["z"]), config.n)
            linked = linked_copies([h[a:b] for a, b in zip(at, at[1:])], group["copies"].to_numpy(), own, config.percent)
            yield pa.RecordBatch.from_arrays([group["doc_id"].combine_chunks().take(pa.array(own)), pa.array(linked)], ["doc_id", "linked"])

    return rows.repartition("comp", "part").sortWithinPartitions("comp", "part").mapInArrow(count, "doc_id long, linked long")


def jaccard_components(docs: DataFrame, config: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text", with_links: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links) and, if with_links, n_links.

    Sets link when 100 * intersection >= percent * union. Equal texts are one text, whose answers hold for all its copies.
    Documents are counted by shingle over the whole corpus, as packed keys by block of texts, and every set enters the lists
    of its rarest shingles. A first round compares each entry of a list with the list's first document; sets that link share a
    component, so that the answers of the first document settle those of the sets like it, and a second round compares only
    sets of different components, in blocks by size and position. Rounds compare whole sets, and every pair that the bounds
    allow is in one component or compared, so no link between components is lost. Shingles are compared by 64-bit hashes of
    their words, whose bytes are mixed without algebraic structure.

    n_links counts the other documents whose sets link with the row's set, copies of it among them. It is counted inside the
    components at the end, from the differences of their sets.

    A text without words or null has an empty set and links with nothing: its component is itself. Repeated rows of an id are
    the same document. Rows with a null id have a null component. Other columns aren't read. An empty table gives no rows. Ids
    are whole numbers.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    nameless = set_sizes(rows.where("doc_id is null").select("text"), config.n).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    known = rows.where("doc_id is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    texts = checkpoint(different_texts(known, config.text_block))
    bits = cell_bits(texts, config.cell)
    keys = checkpoint(shared_keys(key_cells(texts, bits, lambda data, offsets: ngrams(*words(data, offsets), config.n)), bits))
    found = checkpoint(list_entries(texts, keys, bits, config))
    entries, sizes = found.where("token is not null").drop("sketch"), found.where("token is null").select("doc_id", "size", "sketch")
    first = checkpoint(links(star_pairs(entries, config), texts, sizes, config))
    label = components(first)
    labelled = entries.join(label, "doc_id", "left").select("token", "doc_id", "size", "pos", F.coalesce("comp", "doc_id").alias("comp"))
    ends = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    lists = labelled.join(ends, "token", "left_semi").repartition("token").sortWithinPartitions("token", "size", "pos", "doc_id")
    second = checkpoint(links(open_pairs(lists, config), texts, sizes, config))
    final = components(first.unionByName(second))
    of_text = texts.select("doc_id", "sha").join(sizes.drop("sketch"), "doc_id").join(final, "doc_id", "left")
    names = []
    if with_links:
        names = ["n_links"]
        copies = known.select("doc_id", "sha").distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("copies"))
        of_text = checkpoint(of_text.join(copies, "sha"))
        counted = link_counts(final, of_text.select("doc_id", "copies"), texts, config)
        of_text = of_text.join(counted, "doc_id", "left")
        of_text = of_text.withColumn("n_links", F.when(F.col("size") > 0, F.coalesce("linked", "copies") - 1).otherwise(0))
    own = F.when(F.col("size") > 0, F.coalesce("comp", "doc_id"))
    of_text = checkpoint(of_text.select("sha", F.col("size").cast("long").alias("n_shingles"), own.alias("comp"), *names))
    out = known.select("doc_id", "sha").join(of_text, "sha").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), *names)
    return out.unionByName(nameless.withColumns({x: F.lit(0).cast("long") for x in names}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
