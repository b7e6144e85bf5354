"""Blocks of labels compared in bulk, with Numpy: which pairs can reach a score.

Three bounds come before a score: how many of each character both labels have, how
many characters can stand in the same order in both, and then how many Jaro's ratio
lets meet. The first is by pair of labels, one or two nanoseconds each; the others are
only for pairs that the one before leaves. Memory is that of two blocks and of tables
of _KEYS rows for some characters each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789 "  # what label_key leaves
_WIDE = 64  # characters that one number has a bit for
_ROWS, _TILE, _PAIRS, _SOME = 512, 32, 1 << 16, 1 << 13
_KEYS = 256  # rows that a table of sums has at most
_HEADS = range(5)


class Labels:
    """Keys in their order: counts of their characters, first four, and places of each character as bits."""

    def __init__(self, keys: list[str]):
        self.keys = sorted(keys)
        self.n = np.array([len(k) for k in self.keys], np.int64)
        lut = np.zeros(128, np.int64)
        lut[list(ALPHABET)] = np.arange(len(ALPHABET))
        flat = lut[np.frombuffer("".join(self.keys).encode("ascii"), np.uint8)]
        row = np.repeat(np.arange(len(keys)), self.n)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        size = len(ALPHABET)
        counts = np.bincount(row * size + flat, minlength=len(keys) * size).reshape(len(keys), size)
        self.counts = np.ascontiguousarray(counts.T)
        head = np.zeros((len(keys), 4), np.uint8)
        head[row[at < 4], at[at < 4]] = np.frombuffer("".join(k[:4] for k in self.keys).encode("ascii"), np.uint8)
        self.head = head.view(">u4").ravel().astype(np.int64)
        near = at < _WIDE
        # One more character, that no label has, behind the end of each.
        self.codes = np.full((_WIDE, len(keys)), size, np.uint8)
        self.codes[at[near], row[near]] = flat[near]
        places = np.zeros((len(keys), size + 1), np.uint64)
        every = np.arange(len(keys))
        for k in range(min(_WIDE, int(self.n.max(initial=0)))):
            places[every, self.codes[k]] |= np.uint64(1 << k)
        places[:, size] = 0
        self.places = places.ravel()


def _need(least: float, head: int) -> float:
    """What m / |a| + m / |b| must reach if `head` leading characters are the same."""
    return 3 * (least - 0.1 * head) / (1 - 0.1 * head) - 1


def _fitting(m: np.ndarray, a: np.ndarray, b: np.ndarray, same: np.ndarray, least: float) -> np.ndarray:
    """Whether labels with m characters that meet can have the least score."""
    best = (m / a + m / b + 1) / 3
    return (m > 0) & (best + 0.1 * same * (1 - best) >= least - 1e-9)


def _sums(x: Labels, y: Labels, kind: type) -> tuple[list[tuple[np.ndarray, list[int]]], list[tuple[np.ndarray, list[int]]]]:
    """(table, its row for each label of x) for groups of characters: how many of these each label of y has in common with such a label of x; and (counts of y, counts of x) of characters with more than _KEYS counts."""
    groups: list[tuple[list, np.ndarray, np.ndarray]] = []
    single = []
    for c in sorted(range(len(ALPHABET)), key=lambda c: int(x.counts[c].max(initial=0))):
        values, own = np.unique(np.minimum(x.counts[c], y.counts[c].max(initial=0)), return_inverse=True)
        theirs = np.minimum(y.counts[c], values.max(initial=0)).astype(kind)
        if len(values) > _KEYS:
            single.append((theirs, values[own].tolist()))
            continue
        if not values.any():
            continue
        part = (np.minimum(values.astype(kind)[:, None], theirs), own)
        if groups:
            # With the group before, if both together still have few different counts.
            _, first, at = np.unique(groups[-1][1] * len(values) + own, return_index=True, return_inverse=True)
            if len(first) <= _KEYS:
                groups[-1] = [*groups[-1][0], part], at, first
                continue
        groups.append(([part], own, np.unique(own, return_index=True)[1]))
    tables = []
    for parts, at, first in groups:
        table = np.zeros((len(first), len(y.keys)), kind)
        for met, own in parts:
            table += met[own[first]]
        tables.append((table, at.tolist()))
    return tables, single


def _common(x: Labels, y: Labels, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in both of the pairs that have enough characters in common, how many these are, and how many first ones are the same; of one block with itself, each pair once."""
    longest = min(int(x.n.max(initial=0)), int(y.n.max(initial=0)))
    kind = np.uint8 if longest < 2**8 else np.uint16 if longest < 2**16 else np.uint32
    most = np.iinfo(kind).max
    needs = np.array([max(0.0, _need(least, h)) for h in _HEADS])[:, None]
    lengths, length = np.unique(y.n, return_inverse=True)
    begin, end = ([np.searchsorted(y.head >> 8 * (4 - h), x.head >> 8 * (4 - h), side).tolist() for h in _HEADS] for side in ("left", "right"))
    tables, single = _sums(x, y, kind)
    enough: dict[int, np.ndarray] = {}
    for start in range(0, len(x.keys), _ROWS):
        skip = start if x is y else 0
        parts = [([*table[:, skip:]], at) for table, at in tables]
        size = len(y.keys) - skip
        for top in range(start, min(start + _ROWS, len(x.keys)), _TILE):
            rows = range(top, min(top + _TILE, start + _ROWS, len(x.keys)))
            m, fits = np.zeros((len(rows), size), kind), np.empty((len(rows), size), bool)
            for r, met, fit in zip(rows, m, fits, strict=True):
                for table, at in parts:
                    met += table[at[r]]
                for theirs, own in single:
                    met += np.minimum(theirs[skip:], own[r])
                n = int(x.n[r])
                if n not in enough:
                    if len(enough) >= 128:
                        enough.clear()
                    enough[n] = np.clip(np.ceil(needs * n * lengths / (n + lengths) - 1e-6), 1, most).astype(kind)[:, length]
                # Labels with one head lie side by side, and need fewer characters the longer it is.
                np.greater_equal(met, enough[n][0, skip:], out=fit)
                for h in _HEADS[1:]:
                    low, high = max(begin[h][r] - skip, 0), end[h][r] - skip
                    if low >= high:
                        break
                    np.greater_equal(met[low:high], enough[n][h, skip + low : skip + high], out=fit[low:high])
            at = np.flatnonzero(fits)  # many times as fast as nonzero of rows and columns
            m, i, j = m.ravel()[at].astype(np.int64), at // size + top, at % size + skip
            apart = x.head[i] ^ y.head[j]
            same = np.minimum(sum(apart >> 8 * (4 - h) == 0 for h in _HEADS[1:]), np.minimum(x.n[i], y.n[j]))
            good = _fitting(m, x.n[i], y.n[j], same, least)
            if x is y:
                good &= i < j
            yield i[good], j[good], m[good], same[good]


def _ordered(x: Labels, i: np.ndarray, y: Labels, j: np.ndarray, m: np.ndarray, same: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs with m characters in common can have the least score, by the longest sequence that stands in both.

    Characters that meet and are not moved are such a sequence. With m of them meeting,
    Jaro's ratio is (m / |a| + m / |b| + 1 / 2 + kept / 2m) / 3, so fewer that meet must
    be kept more; and the k-th one lies at most |b| - m places further in b than in a.
    No label has over _WIDE.
    """
    one, full, wide = np.uint64(1), np.uint64(2**64 - 1), len(ALPHABET) + 1
    a, b = x.n[i], y.n[j]
    weight = 1 / a + 1 / b
    ratio = 3 * (least - 0.1 * same) / (1 - 0.1 * same)
    fewest = (ratio - 1) / weight
    kept = np.minimum(fewest, 2 * m * (ratio - 0.5 - m * weight)) - 1e-6
    ahead = np.floor(b - np.maximum(fewest, 0) + 1e-6).astype(np.int64)
    left, base, at = np.full(len(i), full), j * wide, np.arange(len(i))
    for k in range(1, int(a.max(initial=0)) + 1):
        place = y.places.take(base + x.codes[k - 1].take(i))
        met = left & place
        left = (left + met) | (left & ~place)
        if k % 8 == 0 and k > 8 and len(at):
            # What stands in both so far, and all that is to come.
            window = full >> (_WIDE - np.clip(k + ahead, 1, _WIDE)).astype(np.uint64)
            some = np.flatnonzero(np.bitwise_count(~left & window) + np.maximum(a - k, 0) >= kept)
            if len(some) < 0.8 * len(at):
                left, base, at, i, a, kept, ahead = left[some], base[some], at[some], i[some], a[some], kept[some], ahead[some]
    return at[np.bitwise_count(~left) >= kept]


def _scores(x: Labels, i: np.ndarray, y: Labels, j: np.ndarray, same: np.ndarray, least: float) -> np.ndarray:
    """jaro_winkler from x[i] to y[j], or 0 where too few characters meet for the least score. No label has over _WIDE."""
    a, b = x.n[i], y.n[j]
    reach = np.maximum(np.maximum(a, b) // 2 - 1, 0)
    one, full, wide = np.uint64(1), np.uint64(2**64 - 1), len(ALPHABET) + 1
    free, left, base = np.full(len(i), full), np.zeros(len(i), np.uint64), j * wide
    for k in range(int(a.max(initial=0))):
        window = (full << np.maximum(k - reach, 0).astype(np.uint64)) & (full >> (_WIDE - 1 - np.minimum(k + reach, _WIDE - 1)).astype(np.uint64))
        fit = y.places[base + x.codes[k, i]] & free & window
        free &= ~(fit & (~fit + one))
        left |= (fit != 0).astype(np.uint64) << np.uint64(k)
    m = np.bitwise_count(left).astype(np.int64)
    out = np.zeros(len(i))
    good = np.flatnonzero(_fitting(m, a, b, same, least))
    a, b, m, left, right, same = a[good], b[good], m[good], left[good], ~free[good], same[good]
    moved = np.zeros(len(good), np.int64)
    for k in range(int(m.max(initial=0))):
        # The next place of both that met; behind the last one that is the same place of neither.
        p, q = (np.minimum(np.bitwise_count((z & (~z + one)) - one), _WIDE - 1) for z in (left, right))
        moved += (k < m) & (x.codes[p, i[good]] != y.codes[q, j[good]])
        left, right = left & (left - one), right & (right - one)
    ratio = (m / a + m / b + (m - moved / 2) / m) / 3
    out[good] = ratio + same * 0.1 * (1 - ratio)
    return out


def scored(x: Labels, y: Labels, least: float, score: Callable[[list[str], list[str]], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both, and the scores from x to y and from y to x, or 0 where that can't be the least one; some ten thousand pairs at a time. score: for long labels."""
    waiting: list[tuple] = []

    def tried(i, j, m, same):
        short = (x.n[i] <= _WIDE) & (y.n[j] <= _WIDE)
        few = np.flatnonzero(short)
        kept = [some[_ordered(x, i[some], y, j[some], m[some], same[some], least)] for some in (few[k : k + _SOME] for k in range(0, len(few), _SOME))]
        some = np.concatenate([np.flatnonzero(~short), *kept])
        i, j, same, short = i[some], j[some], same[some], short[some]
        there, back = np.zeros(len(i)), np.zeros(len(i))
        for out, (u, f), (v, t) in ((there, (x, i), (y, j)), (back, (y, j), (x, i))):
            out[short] = _scores(u, f[short], v, t[short], same[short], least)
            out[~short] = score([u.keys[k] for k in f[~short]], [v.keys[k] for k in t[~short]])
        some = (there > 0) | (back > 0)
        return i[some], j[some], there[some], back[some]

    def whole():
        return (np.concatenate(parts) for parts in zip(*waiting, strict=True))

    for found in _common(x, y, least):
        if len(found[0]):
            waiting.append(found)
        if sum(len(w[0]) for w in waiting) >= _PAIRS:
            every = [*whole()]
            waiting.clear()
            for at in range(0, len(every[0]), _PAIRS):
                yield tried(*(z[at : at + _PAIRS] for z in every))
    if waiting:
        yield tried(*whole())
