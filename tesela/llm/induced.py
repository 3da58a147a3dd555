"""External induced suffix sorting in numpy: disk-backed queues carry suffixes and their common prefixes.

A suffix is small (S) if it sorts before the one that follows it in the text, else large (L). Once the leftmost small
suffixes (a small one behind a large one) are sorted, one scan upwards induces the order of the large ones and one scan
downwards that of the small ones: whatever is scanned hands its predecessor in the text to the queue of the
predecessor's first symbol. What is handed to one queue arrives in sorted order, so the priority queue of the scan is a row of
first-in-first-out queues, one for each symbol, and all that a queue holds is scanned at once. The common prefix of two
neighbours in a queue is one symbol more than the least common prefix between those that handed them over.

The leftmost small suffixes are sorted by the same two scans over their substrings, which get names, and by recursion on
the string of names; a string of names of up to `base` symbols is sorted in memory by doubling prefixes.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

RECORD = np.dtype([("pos", "<i8"), ("lcp", "<i4")])
FAR = np.iinfo(np.int32).max
#: Suffixes that a scan hands on at once.
STRETCH = 1 << 16


class Queues:
    """First-in-first-out queues of records by symbol. Beyond `memory` bytes new records go to one unnamed file, which only
    this task sees and which ends with it."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: dict[int, deque] = {}
        self.spilled = 0

    def put(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        record = np.empty(len(pos), RECORD)
        record["pos"], record["lcp"] = pos, lcp
        if self.held + record.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(record.tobytes())
            self.spilled += record.nbytes
            self.parts.setdefault(symbol, deque()).append((at, len(record)))
        else:
            self.held += record.nbytes
            self.parts.setdefault(symbol, deque()).append(record)

    def take(self, symbol: int) -> np.ndarray | None:
        """The oldest records of a queue, as many parts as fit into a quarter of the memory and one at least, or None."""
        queue, out, size = self.parts.get(symbol), [], 0
        while queue and (not out or 4 * size < self.memory):
            part = queue.popleft()
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(part[1] * RECORD.itemsize), RECORD)
            else:
                self.held -= part.nbytes
            out.append(part)
            size += part.nbytes
        return np.concatenate(out) if out else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def small_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are small. Behind the text stands a symbol less than all others."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1:] = -1
    near = np.where(step != 0, np.arange(n), n)
    near = np.minimum.accumulate(near[::-1])[::-1]
    return step[near] > 0


def run_prefix(text: np.ndarray, a: int, b: int) -> int:
    """Symbols that the suffixes at a and b have in common, by direct comparison."""
    out, width, n = 0, 64, len(text)
    while True:
        m = min(width, n - a - out, n - b - out)
        if m <= 0:
            return out
        differ = np.flatnonzero(text[a + out : a + out + m] != text[b + out : b + out + m])
        if len(differ):
            return out + int(differ[0])
        out += m
        width *= 4


class Minima:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values[a:b] for each pair; b > a."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            values = self.levels[k]
            out[at] = np.minimum(values[a[at]], values[b[at] - (1 << int(k))])
        return out


class Scan:
    """Hands the predecessors of scanned suffixes to the queues of their first symbols."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: np.ndarray, queues: Queues, cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.index = symbols
        self.carry = np.full(len(symbols), FAR, np.int32)  # least prefix since a queue last grew

    def hand(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """pos in scan order; lcp: prefix in common with the suffix scanned just before. A stretch at a time, so that what a scan
        holds besides the queues is bounded."""
        for a in range(0, len(pos), STRETCH):
            self.hand_stretch(pos[a : a + STRETCH], lcp[a : a + STRETCH])

    def hand_stretch(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        at = np.flatnonzero((pos > 0) & self.wanted[before])
        least = int(lcp.min()) if len(lcp) else FAR
        if not len(at):
            self.carry = np.minimum(self.carry, least)
            return
        before = before[at]
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        first = np.flatnonzero(np.diff(symbol, prepend=symbol[0] - 1))
        last = np.append(first[1:], len(at)) - 1
        begin = np.empty(len(at), np.int64)
        begin[1:] = at[:-1] + 1
        begin[first] = 0
        minima = Minima(lcp)
        found = minima.least(begin, at + 1)
        kind = np.searchsorted(self.index, symbol[first])
        found[first] = np.minimum(found[first], self.carry[kind])
        self.carry = np.minimum(self.carry, least)
        rest = np.full(len(last), FAR, np.int32)
        more = at[last] + 1 < len(lcp)
        rest[more] = minima.least(at[last][more] + 1, np.full(more.sum(), len(lcp)))
        self.carry[kind] = rest
        found = np.minimum(np.where(found == FAR, 0, found.astype(np.int64) + 1), self.cap).astype(np.int32)
        for a, b in zip(first, last, strict=True):
            self.queues.put(int(symbol[a]), before[a : b + 1], found[a : b + 1])


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, memory: int, cap: int, named: bool) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order and the common prefixes of neighbours, from the sorted leftmost small suffixes.

    With `named`, seeds are taken as strings of one symbol and only the small suffixes come back: that sorts their substrings."""
    symbols = np.unique(text)
    n = len(text)
    queues = Queues(memory)
    scan = Scan(text, ~small, symbols, queues, cap)
    begin = np.searchsorted(text[seeds], symbols)  # seeds come in the order of their first symbols
    end = np.append(begin[1:], len(seeds))
    large: list[tuple[np.ndarray, np.ndarray]] = []
    scan.hand(np.array([n]), np.zeros(1, np.int32))
    for k, c in enumerate(symbols):
        pos, lcp, fresh = [], [], True
        while (part := queues.take(int(c))) is not None:
            p, x = part["pos"].copy(), part["lcp"].copy()
            if fresh:
                x[0], fresh = 0, False
            scan.hand(p, x)
            pos.append(p)
            lcp.append(x)
        large.append((np.concatenate(pos), np.concatenate(lcp)) if pos else (np.zeros(0, np.int64), np.zeros(0, np.int32)))
        own = slice(begin[k], end[k])
        if end[k] > begin[k]:
            x = seed_lcp[own].copy()
            x[0] = 0
            if pos:
                x[0] = 1 if named else min(cap, run_prefix(text, int(large[-1][0][-1]), int(seeds[own][0])))
            scan.hand(seeds[own], x)
    queues.close()
    queues = Queues(memory)
    scan = Scan(text, small, symbols, queues, cap)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(len(symbols) - 1, -1, -1):
        pos, lcp, fresh = [], [], True
        while (part := queues.take(int(symbols[k]))) is not None:
            p, x = part["pos"].copy(), part["lcp"].copy()
            if fresh:
                x[0], fresh = 0, False
            scan.hand(p, x)
            pos.append(p)
            lcp.append(x)
        down = (np.concatenate(pos), np.concatenate(lcp)) if pos else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        l_pos, l_lcp = large[k]
        border = min(cap, run_prefix(text, int(l_pos[-1]), int(down[0][-1]))) if len(l_pos) and pos else 0
        if len(l_pos):
            x = np.empty(len(l_pos), np.int32)
            x[0], x[1:] = border, l_lcp[:0:-1]
            scan.hand(l_pos[::-1], x)
        up = np.empty(len(down[0]), np.int32)
        up[:1] = border
        up[1:] = down[1][:0:-1]
        if named:
            out.append((down[0][::-1], up))
        else:
            out.append((np.concatenate([l_pos, down[0][::-1]]), np.concatenate([l_lcp, up])))
    queues.close()
    out.reverse()
    return np.concatenate([x[0] for x in out] or [np.zeros(0, np.int64)]), np.concatenate([x[1] for x in out] or [np.zeros(0, np.int32)])


def by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffix order of a short string, in memory."""
    n, width = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        if not n or rank[order[-1]] == n - 1:
            return order
        width *= 2


def prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to cap."""
    out = np.zeros(len(order), np.int32)
    alive = np.arange(1, len(order))
    a, b = order[:-1], order[1:]
    for k in range(cap):
        inside = np.maximum(a, b) + k < len(text)
        alive, a, b = alive[inside], a[inside], b[inside]
        same = text[a + k] == text[b + k]
        alive, a, b = alive[same], a[same], b[same]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


def sort_suffixes(text: np.ndarray, cap: int = 64, memory: int = 64 << 20, base: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order, and the common prefix of each with the one before, counted up to cap.

    text holds whole numbers. A string that ends sorts before its continuations. memory: bytes of records that the queues hold
    before they go on disk. base: symbols of a string of names that is sorted in memory; a longer one is sorted by recursion.
    """
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int32)
    small = small_types(text)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(first):
        seeds = first[np.argsort(text[first], kind="stable")]
        order, lcp = induce(text, small, seeds, np.ones(len(seeds), np.int32), memory, FAR - 1, True)
        is_first = np.zeros(n, bool)
        is_first[first] = True
        at = np.flatnonzero(is_first[order])
        least = np.zeros(len(at), np.int64)
        least[1:] = Minima(lcp).least(at[:-1] + 1, at[1:] + 1) if len(at) > 1 else 0
        order = order[at]
        length = np.full(n, FAR, np.int64)
        length[first[:-1]] = np.diff(first) + 1
        size = length[order]
        equal = np.zeros(len(order), bool)
        equal[1:] = (size[1:] == size[:-1]) & (least[1:] >= size[1:])
        name = np.empty(n, np.int64)
        name[order] = np.cumsum(~equal)
        names = name[first]
        if equal.any():
            rank = by_doubling(names) if len(names) <= base else sort_suffixes(names, 1, memory, base)[0]
            seeds = first[rank]
        else:
            seeds = order
    else:
        seeds = first
    return induce(text, small, seeds, prefixes(text, seeds, cap), memory, cap, False)
