"""Repeated windows of a block of texts by a run-length index.

The block's Burrows-Wheeler transform is run-compressed, and suffix
positions are kept only at the ends of its runs: for every run, the text
position at its head, the position just before it in suffix order (the tail
of the previous run) and the length of their common prefix. Streaming over
the text, the matching statistics of every position against its neighbour in
suffix order follow from the last sample before it: the match source moves
along with the position and the match length falls by one.
"""

from __future__ import annotations

import numpy as np


def _suffix_order(sym: np.ndarray, rem: np.ndarray, longest: int) -> np.ndarray:
    """Positions in suffix order; a text ends before its terminator, equal
    suffixes keep the order of their texts. Prefix doubling from packed
    symbols of nine bits."""
    n = len(sym)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([sym, np.zeros(7, dtype=np.int64)])
    for j in range(7):
        key = (key << 9) | np.where(rem > j, padded[j:j + n], 0)
    step = 7
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if step >= longest or rank[order[-1]] == n - 1:
            break
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:max(0, n - step)] = rank[step:] + 1
        nxt[rem <= step] = 0
        key = rank * (n + 1) + nxt
        step *= 2
    return np.argsort(rank * n + np.arange(n))


def _common_prefix(data: np.ndarray, rem: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    limit = np.minimum(rem[a], rem[b])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), dtype=np.uint64)
    for j in range(8):
        word |= padded[j:j + len(data)].astype(np.uint64) << np.uint64(8 * j)
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        x = word[a[live] + out[live]] ^ word[b[live] + out[live]]
        low = x & (~x + np.uint64(1))               # lowest differing bit
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        out[live] += same
        live = live[(same == 8) & (out[live] < limit[live])]
    return np.minimum(out, limit)


class RunIndex:
    """Run-compressed transform of a list of byte strings with sampled run
    ends. Only the samples are kept."""

    def __init__(self, texts: list[bytes]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.start = np.cumsum(lens) - lens
        data = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
        self.size = n = len(data)
        self.rem = np.repeat(self.start + lens - 1, lens) - np.arange(n)
        sym = data.astype(np.int64) + 1
        sym[self.rem == 0] = 0
        order = _suffix_order(sym, self.rem, int(lens.max()))
        before = np.zeros(n, dtype=np.int64)        # the transform: the symbol before each suffix
        before[1:] = sym[:-1]
        bwt = before[order]
        head = np.ones(n, dtype=bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        j = np.flatnonzero(head[1:]) + 1
        self.runs = len(j) + 1
        heads, tails = order[j], order[j - 1]
        self.head = np.zeros(n, dtype=bool)
        self.head[heads] = True
        self.head[order[0]] = True
        self.tail = np.zeros(n, dtype=np.int64)
        self.tail[heads] = tails
        self.lcp = np.zeros(n, dtype=np.int64)
        self.lcp[heads] = _common_prefix(data, self.rem, heads, tails)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Per position: length of the match with its predecessor in suffix
        order and where that starts, streamed from the samples."""
        at = np.arange(self.size)
        last = np.maximum.accumulate(np.where(self.head, at, 0))
        return self.lcp[last] - (at - last), self.tail[last] + (at - last)

    def later_copies(self, length: int) -> np.ndarray:
        """Per position: is the ``length`` bytes from here also at a smaller
        position? Positions with matches that long form chains; the
        smallest position of a chain is the first occurrence."""
        match, source = self.matching_statistics()
        at = np.arange(self.size)
        long_ = match >= length
        root = np.where(long_, source, at)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        first = np.full(self.size, self.size, dtype=np.int64)
        inside = np.flatnonzero(self.rem >= length)
        np.minimum.at(first, root[inside], inside)
        out = np.zeros(self.size, dtype=bool)
        out[inside] = inside > first[root[inside]]
        return out
