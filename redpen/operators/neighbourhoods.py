"""Words within two edits of each other, and word pairs with their counts, as flat arrays in files that tasks map into memory. NumPy only."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

#: Deletion keys are made of words up to this length; longer ones are joined by parts elsewhere.
WIDTH = 32
_M = 1 << 64
_BASE = 0x9E3779B97F4A7C15
B0, B1, B2 = (np.uint64(pow(_BASE, e, _M)) for e in (1, -1, -2))
#: Keys that are looked up, and pairs of words whose distance is worked out, at once.
KEYS, PAIRS = 1 << 18, 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of each number (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words up to WIDTH letters, filled up with 0, and their lengths."""
    n = np.fromiter(map(len, words), np.int32, len(words))
    return np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH), n


def deletion_keys(c: np.ndarray) -> np.ndarray:
    """For words of one length, hashes of each and of what is left after one or two deletions. Equal strings have equal hashes; the converse is for the distance to tell."""
    m, n = c.shape
    power = np.ones(n, np.uint64)
    power[1:] = B0
    at = np.zeros((m, n + 1), np.uint64)
    np.cumsum(mixed(c) * np.cumprod(power, dtype=np.uint64), axis=1, out=at[:, 1:])
    all_, (i, j) = at[:, -1:], np.triu_indices(n, 1)
    once = at[:, :-1] + B1 * (all_ - at[:, 1:])
    twice = at[:, i] + B1 * (at[:, j] - at[:, i + 1]) + B2 * (all_ - at[:, j + 1])
    return np.concatenate([all_, once, twice], axis=1)


def index(c: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) of all words, sorted by key."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k in np.unique(n):
        rows = np.flatnonzero(n == k)
        x = deletion_keys(c[rows, :k])
        keys.append(x.ravel())
        owners.append(np.repeat(ids[rows].astype(np.int32), x.shape[1]))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key)
    return key[order], owner[order]


def distances(a: np.ndarray, n: int, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Damerau-Levenshtein distances of pairs, 3 for more than 2. ``a`` has n rows of letters, ``b`` at least n + 3; a column is a pair, whose lengths differ by 2 at most.

    Five diagonals of the table for swaps of neighbours; one letter more between the swapped ones is the only other way within two edits.
    """
    size = a.shape[1]
    big = np.full(size, 3, np.uint8)
    before, row, was = {}, {d: (np.full(size, d, np.uint8) if d >= 0 else big) for d in range(-2, 3)}, {}
    for i in range(1, n + 1):
        same = {d: a[i - 1] == b[i + d - 1] for d in range(-3, 3) if i + d >= 1}
        same[3] = a[i - 1] == b[i + 2]
        new = {}
        for d in range(-2, 3):
            j = i + d
            if j <= 0:
                new[d] = np.full(size, i, np.uint8) if j == 0 else big
                continue
            x = row[d] + ~same[d]
            if d < 2:
                np.minimum(x, row[d + 1] + np.uint8(1), out=x)
            if d > -2:
                np.minimum(x, new[d - 1] + np.uint8(1), out=x)
            if i > 1 and j > 1:
                np.minimum(x, np.where(same[d - 1] & was[d + 1], before[d] + np.uint8(1), np.uint8(3)), out=x)
            new[d] = np.minimum(x, np.uint8(3), out=x)
        before, row, was = row, new, same
    out = np.full(size, 3, np.uint8)
    for d in range(-2, 3):
        np.copyto(out, row[d], where=nb == n + d)
    for d in (-1, 1):  # xy and y?x
        cols = np.flatnonzero((nb == n + d) & (out == 3))
        if len(cols):
            p, q = (a[:, cols], b[: n + 1, cols]) if d == 1 else (b[: n - 1, cols], a[:, cols])
            out[cols[gapped(p, q)]] = 2
    return out


def gapped(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether q is p but for two neighbouring letters that change places and get a letter between them."""
    n, size = p.shape
    if n < 2:
        return np.zeros(size, bool)
    same = p == q[:n]
    first = np.where(same.all(0), n, same.argmin(0))  # difference
    at, i = np.arange(size), np.minimum(first, n - 2)
    rest = (p == q[1:]) | (np.arange(n)[:, None] < i + 2)
    return (first < n - 1) & (p[i, at] == q[i + 2, at]) & (p[i + 1, at] == q[i, at]) & rest.all(0)


def nearest(asked: tuple[np.ndarray, np.ndarray], own: np.ndarray, known: tuple[np.ndarray, np.ndarray], blocks: Iterable, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance): known words within two edits of each asked one, itself left out; of ``most`` and more of them, at least the most frequent.

    ``asked`` and ``known`` are codes and lengths, ``own`` the ids of the asked words. Ids follow frequency, and so do the ``blocks`` of the index (key, id), none of which begins
    amid words of one count; so a word that has enough is done.
    """
    (a, na), (b, nb) = asked, known
    found = np.zeros(len(na), np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8))]
    for key, owner in blocks:
        for n in np.unique(na):
            rows = np.flatnonzero((na == n) & (found < most))
            for some in np.array_split(rows, len(rows) * (1 + n + n * (n - 1) // 2) // KEYS + 1):
                keys = deletion_keys(a[some, :n])
                order = np.argsort(keys, axis=None)
                lo, hits = np.empty(keys.size, np.int64), np.empty(keys.size, np.int64)
                inorder = keys.ravel()[order]  # neighbours in the index share cache lines
                lo[order] = first = np.searchsorted(key, inorder)
                hits[order] = np.searchsorted(key, inorder, "right") - first
                total = np.cumsum(hits.reshape(keys.shape).sum(1))
                cuts = np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) + 1 if len(some) else []
                for part in np.split(np.arange(len(some)), cuts):
                    k = slice(part[0] * keys.shape[1], (part[-1] + 1) * keys.shape[1]) if len(part) else slice(0)
                    h, of = hits[k], np.repeat(some[part], keys.shape[1])
                    y = owner[np.repeat(lo[k] - np.cumsum(h) + h, h) + np.arange(h.sum())]
                    pair = np.unique((np.repeat(of, h) << 32) | y)
                    x, y = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)
                    fit = np.flatnonzero((np.abs(nb[y] - n) <= 2) & (own[x] != y))
                    x, y = x[fit], y[fit]
                    letters = np.zeros((n + 4, len(y)), b.dtype)
                    width = min(n + 4, b.shape[1])
                    letters[:width] = b[y, :width].T
                    dist = distances(np.ascontiguousarray(a[x, :n].T), n, letters, nb[y])
                    near = dist <= 2
                    out.append((x[near], y[near], dist[near]))
                    found += np.bincount(x[near], minlength=len(na))
    row, word, dist = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, word, dist


def ranked(row: np.ndarray, word: np.ndarray, dist: np.ndarray, cnt: np.ndarray, n_rows: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each row, id, distance), the ``most`` first of each row by frequency, distance and id."""
    order = np.lexsort((word, dist, -cnt[word], row))
    row, word, dist = row[order], word[order], dist[order]
    n = np.bincount(row, minlength=n_rows)
    keep = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < most
    return np.minimum(n, most), word[keep].astype(np.int32), dist[keep].astype(np.uint8)


class Pairs:
    """Counts of word pairs, sorted by a hash from which the key can be told: a bit for each, which most pairs that never occur fail at once, and where each bucket of hashes begins."""

    def __init__(self, folder: str):
        read = lambda x, t: np.asarray(np.memmap(f"{folder}/pairs.{x}", t, "r")) if os.path.getsize(f"{folder}/pairs.{x}") else np.zeros(0, t)
        self.hash, self.cnt, self.bits, self.start = read("hash", np.uint64), read("cnt", np.int64), read("bits", np.uint8), read("start", np.int64)
        if len(self.hash):
            self.bit_shift, self.shift = np.uint64(64 - (len(self.bits).bit_length() + 2)), np.uint64(64 - (len(self.start) - 2).bit_length())

    @staticmethod
    def hashes(key: np.ndarray) -> np.ndarray:
        return key.view(np.uint64) * B0

    @staticmethod
    def write(folder: str, rows: int, batches: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        """The files, from (hash, cnt) in the order of the hashes."""
        size = max(4, (rows * 2 - 1).bit_length()) if rows else 0
        bits, start = np.zeros(1 << size if rows else 0, np.uint8), np.zeros((1 << max(1, size - 2)) + 1 if rows else 0, np.int64)  # 16 bits a pair and more; up to two pairs a bucket
        with open(f"{folder}/pairs.hash", "wb") as a, open(f"{folder}/pairs.cnt", "wb") as b:
            for h, cnt in batches:
                h.tofile(a)
                cnt.tofile(b)
                slot = h >> np.uint64(64 - size - 3)
                np.bitwise_or.at(bits, slot >> np.uint64(3), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))
                bucket, n = np.unique(h >> np.uint64(64 - (len(start) - 2).bit_length()), return_counts=True)
                start[bucket + np.uint64(1)] += n
        np.cumsum(start, out=start)
        bits.tofile(f"{folder}/pairs.bits")
        start.tofile(f"{folder}/pairs.start")

    def counts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``key`` of pairs that occur, and their counts. Negative keys are no pairs."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self.hashes(key)
        slot = h >> self.bit_shift
        place = np.flatnonzero((self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
        h = h[place]
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out, seen = [place[:0]], [self.cnt[:0]]
        while len(place):
            left = at < end
            place, h, at, end = place[left], h[left], at[left], end[left]
            same = self.hash[at] == h
            out.append(place[same])
            seen.append(self.cnt[at[same]])
            place, h, at, end = place[~same], h[~same], at[~same] + 1, end[~same]
        return np.concatenate(out), np.concatenate(seen)
