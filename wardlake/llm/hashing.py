"""Vectorised hashes of words, k-grams and windows, and minimiser anchors.

All arithmetic is modulo 2**64. The hashes depend on content only, so equal words and
equal windows have equal hashes in every task and every run.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of two independent rolling hashes.
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes outside words once A-Z are lower case: what is neither a-z, 0-9 nor above 0x7F.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """The first ``n`` values of a fixed sequence of odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)``, by doubling."""
    out = np.ones(max(n, 1), U)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * step
            done += more
            step = step * step
    return out[:n]


def inverse(base: np.uint64) -> np.uint64:
    x = int(base)
    return U(pow(x, -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of a symbol sequence, from running sums."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = BASES[0]):
        n = len(symbols)
        self.back = powers(inverse(base), n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * powers(base, n), out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k consecutive symbols, by first position."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.back[: n - k + 1] + U(k))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


class Words:
    """Words of a slice of texts: where they lie and two hashes of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes = WHITESPACE, fold: bool = False):
        if fold:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data | np.uint8(32), data)
        inside = np.ones(256, bool)
        inside[np.frombuffer(separators, np.uint8)] = False
        word = inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = word[:-1]
        begins = word & (~before | edge[:-1])
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = word & (~after | edge[1:])
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        #: First word of every text, with the number of words as last entry.
        self.first = np.searchsorted(self.start, offsets)
        self._at = np.flatnonzero(word)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """One 64-bit hash per word: a sum of bytes, each times a number fixed by its place."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, U)
        head = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=head[1:])
        place = np.arange(int(size.sum())) - np.repeat(head, size)
        factor = randoms(int(size.max()), seed)
        value = (self.data[self._at].astype(U) + U(1)) * factor[place]
        return mix(np.add.reduceat(value, head) + size.astype(U))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling steps."""
    if len(values) < width:
        return values[:0]
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


#: Low bits of a key that carry a position, so that the least key names its place; the
#: leftmost of equal k-grams wins, which is the same choice in every copy of a window.
PLACE_BITS = 24


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` k-grams the position of its least one."""
    place = U((1 << PLACE_BITS) - 1)
    most = max(int(place), 2 * width)
    if len(grams) > most:
        # Parts of a very long slice overlap by a stretch less one, so each stretch lies in one part.
        step = most - width + 1
        parts = [anchors(grams[i : i + most], width) + i for i in range(0, len(grams) - width + 1, step)]
        return np.concatenate(parts)
    keyed = (grams & ~place) | np.arange(len(grams), dtype=U)
    return (sliding_min(keyed, width) & place).astype(np.int64)


def anchor_runs(grams: np.ndarray, first: np.ndarray, window: int, k: int):
    """Runs of consecutive windows that share their anchor, never across two texts.

    ``first`` holds the first symbol of every text and the end. Returns per run the
    text, the first window, the number of windows and the anchor's position. Equal
    windows have their anchors at the same offset, so they lie in runs whose anchor
    k-grams are equal.
    """
    n = int(first[-1])
    if n < window or len(grams) < window - k + 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at = anchors(grams, window - k + 1)[: n - window + 1]
    start = np.arange(len(at))
    text = np.searchsorted(first, start, "right") - 1
    ok = start + window <= first[text + 1]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    change &= ok
    head = np.flatnonzero(change)
    if not len(head):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    # A run ends where the next begins or where its text has no further window.
    nxt = np.append(head[1:], len(at))
    last = np.minimum(nxt, first[text[head] + 1] - window + 1)
    return text[head], head, last - head, at[head]
