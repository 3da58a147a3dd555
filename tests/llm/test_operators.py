"""The operators over small tables with nulls, empty, repeated and long texts, ties and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesela.llm import byte_bpe, common, exact_dedup, induced, jaccard, line_dedup, media, packing, pii, quality, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, lines string, score string, start string"


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = passage(rng, 120)
    common = passage(rng, 30)
    near = base.split()
    near[60] = "changed"
    out = [base, " ".join(near), base, None, "", "   \n\t ", "one two", "one two", "One TWO", base.upper()]
    out += [f"{passage(rng, 40)}\n{common}\n{passage(rng, 25)}" for _ in range(6)]
    out += ["a" * 300, "ab" * 200, "x", "mail me at joe.doe@mail.example.com or +1 (523) 555-1055 now", "é" * 120 + " ünï " + "é" * 120]
    out += [passage(rng, 3000) + "\n" + common, "host 10.0.0.255 and 300.1.1.1 card 4111 1111 1111 1111, 4111111111111112"]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, x, None, "s", 1, "k", "l", "s", "t") for i, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, [*texts, (None, texts[0][1]), texts[7]])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, texts, none):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, keep="largest").collect() if r.doc_id is not None}
    rows = [*texts, (None, texts[0][1]), texts[7]]
    for i, x in texts:
        same = [j for j, y in rows if (y or "") == (x or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(j for j in same if j is not None), len(same), i == max(j for j in same if j is not None))
        assert r.text_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_suffix_dedup(docs, texts, none):
    want = suffix_dedup.removed_bytes([(i, (x or "").encode()) for i, x in texts], 50)
    for r in suffix_dedup.suffix_dedup(docs).collect():
        if r.doc_id is not None:
            raw = (texts[r.doc_id][1] or "").encode()
            gone = want[r.doc_id]
            assert bytes(r.kept) == bytes(b for b, g in zip(raw, gone) if not g)
            assert sum(s.end - s.start for s in r.spans) == sum(gone)
        else:
            assert not r.spans
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_of_small_shards(spark, texts):
    """Blocks, cells, shards and buffers of about a text; queues that go on disk at once; names that are sorted by recursion. Texts
    share passages at all offsets, with changes inside, periodic ones among them."""
    rng = random.Random(17)
    parts = [passage(rng, 30) for _ in range(6)] + ["ab" * 90, "x" * 120, passage(rng, 9) * 8]
    rows = [(i, rng.choice(["", " ", "é"]).join(x[rng.randint(0, 40) :] if rng.random() < 0.5 else x for x in rng.choices(parts, k=rng.randint(0, 5)))) for i in range(70)]
    rows += [(1000 + i, x) for i, x in texts] + [(2000 + i, x) for i, (_, x) in enumerate(rows[:9])]
    config = suffix_dedup.SuffixConfig(text_block=700, cell=1 << 9, shard=1 << 9, memory=128, names=2, buffer=1 << 9)
    want = suffix_dedup.removed_bytes([(i, (x or "").encode()) for i, x in rows], 50)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), config).collect()}
    for i, x in rows:
        assert bytes(got[i].kept) == bytes(b for b, g in zip((x or "").encode(), want[i]) if not g), i


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([0, 200, 1 << 20]), st.sampled_from([0, 4, 1 << 20]))
def test_induced_sorting(values, memory, base):
    text = np.array(values, np.int16)
    order, lcp = induced.sort_suffixes(text, 64, memory, base)
    want = sorted(range(len(values)), key=lambda i: values[i:])
    assert order.tolist() == want
    for k in range(1, len(want)):
        a, b = values[want[k - 1] :], values[want[k] :]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_components(texts, percent=75):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard(docs, texts, none):
    want = brute_components(texts)
    for r in jaccard.jaccard_components(docs).collect():
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (want[0][0], None))
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_chains(spark):
    """Groups of near copies in which only neighbours link, and texts that share a frequent passage alone."""
    rng = random.Random(9)
    rows, base = [], passage(rng, 80).split()
    for k in range(60):
        base = list(base)
        base[rng.randrange(80)] = f"w{k}"
        rows.append((k, " ".join(base)))
    shared = passage(rng, 40)
    rows += [(100 + k, f"{passage(rng, rng.randint(5, 30))} {shared}") for k in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def brute_links(rows, percent=75):
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return {i: sum(j != i and 100 * len(a & b) >= percent * len(a | b) > 0 for j, b in sets.items()) for i, a in sets.items()}


@pytest.mark.parametrize("part", [7, 2048])
def test_jaccard_counts_all_links(spark, part):
    """Near copies that all link, chains in which some do, copies of both and repeated rows, in one and in several tasks."""
    rng = random.Random(12)
    rows, base = [], passage(rng, 120).split()
    for k in range(30):
        near = list(base)
        near[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(near)))
    for k in range(40):
        base = list(base)
        base[rng.randrange(120)] = f"w{k}"
        rows.append((100 + k, " ".join(base)))
    rows += [(200 + k, rows[rng.randrange(70)][1]) for k in range(20)] + [(300, "a b c"), (301, "a b c"), (302, None), (303, "d")]
    config = jaccard.JaccardConfig(part=part)
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_components(frame(spark, [*rows, rows[3], rows[50]]), config).collect()}
    assert got == brute_links(rows)


def test_jaccard_small_blocks(spark):
    """Texts of one to six words in partitions of one row each, and blocks, cells and parts of the least size."""
    rows = [(i, " ".join("ab"[(i >> k) & 1] for k in range(i % 7))) for i in range(40)] + [(50, None), (51, " ")]
    config = jaccard.JaccardConfig(text_block=1, cell=8, part=2, star=1, block=1)
    for parts in (1, 42):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), config).collect()}
        assert got == brute_components(rows)


def test_jaccard_long_lists(spark):
    """Lists of over 64 entries whose sets have many sizes, and more different texts in a list than there are hubs."""
    rng = random.Random(31)
    shared = passage(rng, 60).split()
    rows = []
    for i in range(150):
        own = shared[: rng.randint(8, 60)]
        rows.append((i, " ".join([*own, *passage(rng, rng.randint(0, 6)).split()])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), jaccard.JaccardConfig(block=4, star=3), with_links=False).collect()}
    assert got == brute_components(rows)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_of_equal_letters(spark):
    """Words that polynomials modulo a power of two take for one another."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, f"{x} c d e f g"), (2, f"{y} c d e f g"), (3, x), (4, y)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()} and got[4] == 4
    units = [thue_morse(1024, "a ", "b "), thue_morse(1024, "b ", "a ")]
    kept = {r.doc_id: r.kept for r in substring_dedup.substring_dedup(frame(spark, list(enumerate(units)))).collect()}
    assert kept == dict(enumerate(units))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n.é"), max_size=40), max_size=8), st.integers(1, 6))
def test_ngrams(rows, n):
    raw = [x.encode() for x in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found, row = common.ngrams(*common.words(data, offsets), n)
    by: dict = {}
    for i, x in enumerate(raw):
        w = x.split()
        want = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
        own = found[row == i].tolist()
        assert len(own) == len(want)
        for h, g in zip(own, want):
            assert by.setdefault(h, g) == g
    assert len(set(by.values())) == len(by)


def test_sketches_bound_differences():
    rng = np.random.RandomState(1)
    for _ in range(50):
        a = np.unique(rng.randint(0, 1 << 40, rng.randint(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.rand(len(a)) < 0.8], rng.randint(0, 1 << 40, rng.randint(1, 200)).astype(np.uint64)]))
        x, y = jaccard.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert jaccard.least_difference(x, y) <= len(np.setxor1d(a, b))


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(k, m[0])] for k, p in BASE}


def test_pii_patterns(spark, docs, texts, none):
    odd = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 01.002.0003.255", "4111 1111-1111 1111 4111111111111111 x", "+1 2 3 4 5 6 7 8 +12345678. +1(234)5678-", "é@b.co ü 9.9.9.9é", "." * 3000 + "@a", "1" * 5000, "x@y", "@@a@b.cc@d.ee", "+" * 50 + "1234567890", "12 " * 4000]
    rows = [*texts, *enumerate(odd, 1000)]
    for r in pii.pii_spans(frame(spark, rows)).collect():
        want = base_spans(dict(rows)[r.doc_id] or "")
        assert {k: [(x.start, x.end) for x in r[k]] for k in pii.KINDS} == want, r.doc_id
    assert pii.pii_spans(none).count() == 0


def test_pii_terms_and_redaction(spark):
    rows = [(i, f"call Quentin at q.xy@mail.example.com for case {w}\nplain words here") for i, w in enumerate(["alpha", "bravo", "delta", "gamma"])]
    rows += [(i, f"words here for case number {i}") for i in range(10, 60)] + [(99, None), (100, "")]
    df = frame(spark, rows)
    out = {r.doc_id: r for r in pii.pii_spans(df).collect()}
    assert [x.match for x in out[0].term if x.match == "Quentin"] == ["Quentin"] and not out[20].term
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert "[EMAIL]" in clean[0].text and "Quentin" not in clean[0].text and clean[20].text == rows[14][1] and clean[99].text is None
    assert clean[0].kept == "k"


def brute_terms(rows, config):
    """entity, term: by counting contexts in Python, from the definition of PMI and information content."""
    from math import log

    lines, both, term_n, entity_n, seen = 0, {}, {}, {}, {}
    for i, x in rows:
        for line in (x or "").split("\n"):
            for context in ([line] if len(line) <= pii.CONTEXT else re.findall(pii.STRETCH.replace(r"\p{L}", "[a-zA-Z]"), line, re.S)):
                lines += 1
                entities = {context[a:b] for own in base_spans(context).values() for a, b in own}
                plain = context
                for e in entities:
                    plain = plain.replace(e, " ")
                clean = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
                terms = {t for w in re.split(r"[\t-\r ]", plain) if len(t := clean(w)) >= config.min_chars}
                for t in {clean(w) for w in re.split(r"[\t-\r ]", context)}:
                    term_n[t] = term_n.get(t, 0) + 1
                for e in entities:
                    entity_n[e] = entity_n.get(e, 0) + 1
                    for t in terms:
                        both[e, t] = both.get((e, t), 0) + 1
                        seen.setdefault((e, t), set()).add(context)
    return {(e, t) for (e, t), n in both.items() if len(seen[e, t]) >= config.min_contexts and log(n / max(term_n[t], n)) >= (1 - config.alpha) * log(entity_n[e] / lines)}


def test_pii_terms_by_brute_force(spark):
    """People with an address each, nicknames that only stand by it, and words that stand everywhere; long lines as well."""
    rng = random.Random(14)
    people = [(f"user{k}@mail.example.com", f"Nick{''.join(rng.choice('abcdefgh') for _ in range(5))}") for k in range(6)]
    rows = []
    for i in range(120):
        own = passage(rng, rng.randint(3, 9))
        if i % 2:
            mail, nick = people[i % 6]
            own = f"{own} {nick if rng.random() < 0.9 else 'Someone'} wrote from {mail}"
        rows.append((i, "\n".join([own, passage(rng, 4)])))
    rows.append((500, " ".join(f"{passage(rng, 60)} {people[k % 6][1]} wrote from {people[k % 6][0]}" for k in range(12))))
    config = pii.DisclosureConfig()
    got = {(r.entity, r.term) for r in pii.disclosing_terms(frame(spark, rows), config).collect()}
    assert got == brute_terms(rows, config) and len({t for _, t in got if t.startswith("nick")}) >= 3
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    told = {t for _, t in got}
    assert all("@" not in x for x in clean.values()) and not any(w.lower() in told for i, x in clean.items() for w in x.split() if i % 2)


def test_packing(docs, texts, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, window=256, with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    seqs, pieces = {}, {}
    for r in rows:
        assert r.length == len(r.ids) > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for i, x in texts:
        want = [*tok.encode(x or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.start)
        times = 2 if i == 7 else 1
        assert sum(r.length for r in own) == len(want) * times and all(r.doc_tokens == len(want) for r in own)
        if times == 1:
            assert [t for r in own for t in r.ids] == want
    assert packing.pack(none, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(0, 3))
def test_packing_plan_is_best(sizes, seed):
    window = 16
    ends = np.cumsum(sizes)
    rng = np.random.RandomState(seed)
    soft = np.unique(rng.randint(1, ends[-1] + 1, 5))
    cuts = np.unique(np.concatenate([[0], ends, soft, np.arange(0, ends[-1], 7)]))
    costs = rng.randint(0, 5, len(cuts)).astype(float)
    pad = lambda n: 0 if n & (n - 1) == 0 else window - n
    best = {0: 0.0}
    for j in range(1, len(cuts)):
        best[j] = min(best[i] + pad(int(cuts[j] - cuts[i])) for i in range(j) if cuts[j] - cuts[i] <= window) + costs[j]
    chosen = [0, *packing.choose(cuts, costs, window)]
    assert chosen[-1] == len(cuts) - 1
    assert sum(pad(int(cuts[b] - cuts[a])) + costs[b] for a, b in zip(chosen, chosen[1:])) == pytest.approx(best[len(cuts) - 1])


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'stré1\n\t.  中\x1c"), max_size=300))
def test_byte_bpe_cuts(text):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = byte_bpe.encoding(path, pattern)
    ids = byte_bpe.encode(text, enc, pattern, chunk=24, overlap=12)
    assert ids == enc.encode_ordinary(text) and byte_bpe.decode(ids, enc) == text.encode()


def test_byte_bpe_where_unicode_tables_differ():
    """A letter that one engine knows and the other doesn't, at the real size of chunks, and runs without a place to cut."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = byte_bpe.encoding(path, pattern)
    for text in ("\U00016ea8's" * 20_000, "a" * 100_000, "word and  then\n some\t" * 5000, "中" * 40_000 + " x" * 40_000):
        assert byte_bpe.encode(text, enc, pattern) == enc.encode_ordinary(text)
    assert len(byte_bpe.cuts("word and then some " * 20_000, pattern)) > 8


def test_byte_bpe(docs, texts, none):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.encoding(path, pattern)._mergeable_ranks, special_tokens={})
    for r in byte_bpe.byte_bpe(docs, path, pattern, chunk=512, overlap=64).collect():
        x = (texts[r.doc_id if r.doc_id is not None else 0][1]) or ""
        assert r.ids == enc.encode_ordinary(x) and bytes(r.decoded) == x.encode()
    assert byte_bpe.digests(byte_bpe.byte_bpe(none, path, pattern)).count() == 0


def test_media(docs, texts, none):
    rows = media.media_columns(docs).collect()
    by_text = {}
    for r in rows:
        x = texts[r.doc_id if r.doc_id is not None else 0][1] or ""
        raw = bytes(r.payload)
        assert raw[: r.n_bytes] == x.encode() and not any(raw[r.n_bytes :]) and len(raw) % 64 == 0 and len(raw) > 0
        assert by_text.setdefault(x, (r.media, r.phash)) == (r.media, r.phash)
    damaged = bytearray(rows[0].media)
    damaged[40] ^= 1
    for bad in (bytes(damaged), bytes(rows[0].media)[:-5], b"", b"x" * 60):
        with pytest.raises(ValueError):
            media.png_decode(bad)
    assert media.digests(media.media_columns(none)).count() == 0


def brute_cosine_hash(samples):
    """The definition: mean of each cell of 32 x 32, the cosine transform by its double sum, bits above the median."""
    rows, cols = samples.shape
    cell = lambda n, k: (k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32))
    small = np.array([[samples[slice(*cell(rows, i)), slice(*cell(cols, j))].mean() for j in range(32)] for i in range(32)])
    wave = lambda u, x: np.cos(np.pi / 32 * u * (x + 0.5))
    low = [round(sum(small[x, y] * wave(u, x) * wave(v, y) for x in range(32) for y in range(32)), 6) for u in range(8) for v in range(8)]
    return np.packbits(np.array(low) > np.median(low[1:])).tobytes()


@pytest.mark.parametrize("rows", [1, 2, 33, 100, media.STRETCH + 77])
def test_cosine_hash(rows):
    samples = np.random.RandomState(rows).randint(0, 256, (rows, 64)).astype(np.uint8)
    assert media.cosine_hash(samples) == brute_cosine_hash(samples)
    assert (media.png_decode(media.png_encode(samples)) == samples).all()


@given(st.integers(0, 2**32 - 1), st.integers(1, 9))
@settings(max_examples=20, deadline=None)
def test_png_filters(seed, rows):
    rng = np.random.RandomState(seed)
    samples = rng.randint(0, 256, (rows, 7)).astype(np.uint8)
    assert (media.png_decode(media.png_encode(samples)) == samples).all()
    kinds, lines = rng.randint(0, 5, rows).astype(np.uint8), np.zeros((rows, 7), np.uint8)
    for i in range(rows):
        for j in range(7):
            left, up = int(samples[i, j - 1]) if j else 0, int(samples[i - 1, j]) if i else 0
            corner = int(samples[i - 1, j - 1]) if i and j else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= min(abs(p - up), abs(p - corner)) else up if abs(p - up) <= abs(p - corner) else corner
            lines[i, j] = (int(samples[i, j]) - (0, left, up, (left + up) // 2, paeth)[kinds[i]]) & 255
    assert (media.unfilter(kinds, lines) == samples).all()


def test_substring_dedup(docs, texts, none):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect() if r.doc_id is not None}
    assert got[0].spans == [] and got[2].kept == "" and got[9].kept == "" and got[3].kept == ""
    first = texts[10][1].split("\n")[1]
    assert first in got[10].kept and all(first not in got[i].kept and len(got[i].spans) == 1 for i in range(11, 16))
    for i, r in got.items():
        x = texts[i][1] or ""
        assert len(r.kept) + sum(s.end - s.start for s in r.spans) == len(x)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_units_in_long_sentences(spark):
    """A passage without full stops that is pasted into different sentences goes, but for its ends."""
    rng = random.Random(41)
    pasted = passage(rng, 90)
    rows = [(i, f"{passage(rng, rng.randint(3, 20))} {pasted} {passage(rng, rng.randint(3, 20))}") for i in range(8)]
    for r in substring_dedup.substring_dedup(frame(spark, rows)).collect():
        left = sum(w in r.kept.split() for w in pasted.split())
        assert r.kept == rows[r.doc_id][1] if r.doc_id == 0 else left < 50


def brute_units(rows, config):
    """Spans by counting the units of Python strings: the first (doc_id, offset) of equal units stays."""
    found, seen = {}, set()
    for i, x in sorted((i, x or "") for i, x in rows):
        raw = x.encode()
        _, begin, end, n, digest = substring_dedup.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), config)
        own = []
        for a, b, w, d in zip(begin, end, n, digest):
            plain = tuple(re.sub(r"[^\x80-\U0010ffffa-z0-9]+", " ", raw[a:b].decode().lower() if raw[a:b].isascii() else raw[a:b].decode()).split())
            if plain in seen:
                own.append({"at": len(raw[:a].decode()), "size": len(raw[a:b].decode()), "n_words": int(w)})
            seen.add(plain)
        found[i] = [(s["start"], s["end"]) for s in substring_dedup.merged(own, config.min_words)]
    return found


def test_substring_dedup_by_brute_force(spark):
    rng = random.Random(6)
    pool = [f"{passage(rng, rng.randint(1, 14))}{rng.choice('.!?')}" for _ in range(30)] + [passage(rng, 60) for _ in range(3)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == brute_units(rows, substring_dedup.UnitConfig()) and sum(map(bool, got.values())) > 20


def test_line_dedup(docs, texts, none):
    rows = [r for r in line_dedup.line_dedup(docs).collect()]
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[2].text == "" and got[2].partners == [0] and got[0].lines is None and got[3].text is None and got[0].kept == "k"
    common = texts[10][1].split("\n")[1]
    assert common in got[10].text and all(common not in got[i].text and got[i].partners == [10] for i in range(11, 16))
    assert len(rows) == len(texts) + 2 and line_dedup.line_dedup(none).count() == 0


def test_patience_keeps_order():
    assert line_dedup.patience([(0, 5), (1, 1), (2, 2), (3, 0), (4, 9)]) == [(1, 1), (2, 2), (4, 9)]
    assert line_dedup.patience([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14), st.sampled_from([0, 1 << 16]))
def test_patience_diff(a, b, small):
    """A common subsequence; all of both where they are equal, and the longest one where there is no anchor and no equal end."""
    pairs = line_dedup.patience_diff(a, b, small)
    assert all(a[i] == b[j] for i, j in pairs) and all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
    assert len(line_dedup.patience_diff(a, a, small)) == len(a)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    assert len(pairs) <= best[0][0] and len(line_dedup.common_lines(a, b, 1 << 16)) == best[0][0]


def brute_lines(rows, config):
    """Partners are the first holders of a document's units; every pair is aligned, and what aligns goes."""
    texts = {i: x or "" for i, x in rows if i is not None}
    units = {i: line_dedup.line_units(x, config.min_chars) for i, x in texts.items()}
    out = {}
    for i, x in texts.items():
        lines = [y.strip() for y in x.split("\n")]
        partners = {min(j for j in units if u in units[j]) for u in units[i]} - {i}
        gone = set()
        for j in partners:
            gone |= set(line_dedup.aligned(*([hash(y) for y in z] for z in (lines, [y.strip() for y in texts[j].split("\n")])), [len(y) for y in lines], config))
        out[i] = "\n".join(y for k, y in enumerate(x.split("\n")) if k not in gone)
    return out


def test_line_dedup_is_whole(spark):
    """Repeated long lines, short lines, crossing blocks, exact copies and lines that many documents share, against brute force."""
    rng = random.Random(21)
    pool = [passage(rng, rng.randint(1, 12)) for _ in range(40)] + ["", "  ", "ok", "yes"]
    rows = [(i, "\n".join(rng.choice(pool[:k]) for _ in range(rng.randint(0, 12)))) for k in (6, 20, 44) for i in range(k * 100, k * 100 + 40)]
    rows += [(9000 + i, x) for i, (_, x) in enumerate(rows[::7])] + [(9500, "\n".join([passage(rng, 9)] * 6))]
    rows += [(9501, rows[-1][1]), (9502, None), (9503, "")]
    got = {r.doc_id: r.text or "" for r in line_dedup.line_dedup(frame(spark, [*rows, rows[3]])).collect()}
    assert got == brute_lines(rows, line_dedup.LineConfig())
    assert got[9501] == "" and got[9500] == rows[-4][1]


def test_quality(spark, docs, none):
    rng = random.Random(3)
    known = passage(rng, 150).split()
    good = [(i, " ".join(rng.choice(known) for _ in range(60))) for i in range(300)]
    bad = [(i, " ".join(f"{rng.choice(known).upper()}!!" for _ in range(60))) for i in range(300, 360)]
    df = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality_scores(df, labels).collect()}
    held_out = [i for i in kept if i % 2]
    assert sum(kept[i] == (i < 300) for i in held_out) >= 0.97 * len(held_out)
    again = {r.doc_id for r in quality.keep_quality(df, labels).collect()}
    assert again == {i for i in kept if kept[i]}
    assert quality.quality_scores(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_quality(none, labels).count() == 0


def test_quality_rejects_toxic_prose(spark):
    """Toxic texts of ordinary words with a few telling ones go, labelled or not."""
    rng = random.Random(8)
    known, telling = passage(rng, 150).split(), [f"vile{c}" for c in "abcdef"]
    rows = []
    for i in range(480):
        own = [rng.choice(known) for _ in range(80)]
        if i % 6 == 0:
            for at in rng.sample(range(80), 4):
                own[at] = f"{rng.choice(telling)},"
        rows.append((i, " ".join(own)))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(480) if i % 4 < 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality_scores(frame(spark, rows), labels).collect()}
    held_out = [i for i in kept if i % 4 >= 2]
    assert sum(kept[i] for i in held_out if i % 6 == 0) <= 2
    assert sum(kept[i] for i in held_out if i % 6) >= 0.95 * sum(i % 6 > 0 for i in held_out)
    assert {r.doc_id for r in quality.keep_quality(frame(spark, rows), labels).collect()} == {i for i in kept if kept[i]}


def test_kth_largest(spark):
    values = [random.Random(4).randint(-(10**9), 10**9) for _ in range(500)] + [7] * 20
    df = spark.createDataFrame([(v,) for v in values], "z long")
    for k in (1, 3, 260, 520, 900):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert quality.kth_largest(df, 0) is None


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0.4 * docs.count() < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] > 0


def test_pipeline_edges(spark, docs, texts, none):
    """Nulls in every column, repeated rows, null ids and clashing names go through every stage; so does an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows, empty = docs.unionByName(docs.limit(4)), none
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows, empty = common.checkpoint(stage(spark, rows, sf)), stage(spark, empty, sf)
        assert rows.columns == empty.columns == docs.columns, name
        assert empty.count() == 0, name
        assert rows.where("doc_id is null").count() and rows.where("doc_id = 3 and text is null").count(), name
    kept = [r.doc_id for r in rows.select("doc_id").collect()]
    assert 0 in kept and 2 not in kept and 8 not in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
