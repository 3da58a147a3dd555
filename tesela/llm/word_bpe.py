"""A word-level BPE for many words at once, in numpy: the ids that the tokenizer's own file defines."""

from __future__ import annotations

import json

import numpy as np

from tesela.llm.common import ODD, U64

NONE = np.int32(1 << 30)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else one past 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(more)) for b in range(256)]


class Slots:
    """A hash table from 64-bit keys to places 0, 1, 2 ..., in open addressing, read and written for many keys at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.places = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        shift = U64(64 - self.bits)
        slot = (keys * ODD >> shift).astype(np.int64)
        out = self.places[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            at = slot[open_]
            out[open_] = self.places[at]
            open_ = open_[(out[open_] >= 0) & (self.keys[at] != keys[open_])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New, different keys; they get the next places."""
        while 3 * (self.n + len(keys)) > 1 << self.bits:
            used = np.flatnonzero(self.places >= 0)
            old = np.empty(self.n, U64)
            old[self.places[used]] = self.keys[used]
            self.__init__(self.bits + 1)
            self.add(old)
        places = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slot = (keys * ODD >> U64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.places[slot[left]] < 0]
            self.places[slot[free]] = places[free]  # of several at one slot the last one stays
            won = free[self.places[slot[free]] == places[free]]
            self.keys[slot[won]] = keys[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1


class Merges:
    """Applies the merges of a vocabulary with an end-of-word mark to whole words (UTF-8, already normalised)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, mark = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + mark] for c in letters], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        key = np.array([(vocabulary[a] + 1) << 20 | (vocabulary[b] + 1) for a, b in pairs], U64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        first = np.sort(np.unique(key, return_index=True)[1])  # a pair that comes twice has its first rank
        self.slots = Slots(18)
        self.slots.add(key[first])
        self.ranks, self.made = first.astype(np.int32), made

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for pairs that don't merge or are past a word's end (-1)."""
        place = self.slots.find((a.astype(np.int64) + 1).astype(U64) << U64(20) | (b.astype(np.int64) + 1).astype(U64))
        return np.where(place >= 0, self.ranks[place], NONE)

    def encode(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has. raw: a row of bytes for each word; size: how many of them count, one at least.

        In every round each word merges its pair of least rank, the leftmost of equals. Words lie in columns."""
        n, width = raw.shape
        which, sym = np.arange(n), self.inner[raw.T]
        sym[size - 1, which] = self.last[raw[which, size - 1]]
        sym[np.arange(width)[:, None] >= size] = -1
        out, count = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        pairs = np.full((width, n), NONE, np.int32)
        for j in range(width - 1):
            pairs[j] = self.rank(sym[j], sym[j + 1])
        while len(which):
            least, at = pairs[0].copy(), np.zeros(len(which), np.int64)
            for j in range(1, width - 1):
                less = pairs[j] < least
                least[less], at[less] = pairs[j][less], j
            done = least == NONE
            if done.any():
                out[which[done]] = sym[:, done].T
                count[which[done]] = (sym[:, done] >= 0).sum(axis=0)
                go = ~done
                which, sym, pairs, at, least = which[go], sym[:, go], pairs[:, go], at[go], least[go]
                if not len(which):
                    break
            k = np.arange(len(which))
            for j in range(1, width - 1):
                behind = at < j
                sym[j] = np.where(behind, sym[j + 1], sym[j])
                pairs[j] = np.where(behind, pairs[j + 1], pairs[j])
            sym[width - 1] = -1
            sym[at, k] = self.made[least]
            pairs[at, k] = self.rank(sym[at, k], sym[at + 1, k])
            left = np.flatnonzero(at > 0)
            pairs[at[left] - 1, left] = self.rank(sym[at[left] - 1, left], sym[at[left], left])
        return out[out >= 0], count
