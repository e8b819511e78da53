"""How much of two word sequences lies in matching blocks.

The blocks are those of the longest common run, then of what lies left and right of it, and so on; of runs
of one length the first in `a` counts, then the first in `b`. Since the longest comes first, short runs
matter only in parts that no long run cuts. So a part looks for equal stretches of 2 ** k words, from large
k to small, numbered exactly by doubling, and only parts without one look for shorter ones. The runs of
a part are stretches of diagonals, found from an index of places; what they are cut into goes on with the
parts they reach into. Pairs of equal stretches pass in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20  # pairs of equal stretches held at once
SMALL = 1 << 12  # parts of so many pairs of words look for single words at once


def numbers(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers, equal words having the same."""
    known: dict[str, int] = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in x], np.int64) for x in (a, b))


def common_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts in a, starts in b, lengths) of all maximal common runs."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    upto = np.cumsum(high - low)
    starts, ends, done = [], [], 0
    before_a, after_a = np.append(-1, a[:-1]), np.append(a[1:], -1)
    before_b, after_b = np.append(-2, b[:-1]), np.append(b[1:], -2)
    while done < len(a):
        end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + BLOCK, "right")))
        count = (high - low)[done:end]
        i = np.repeat(np.arange(done, end), count)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[done:end], count)]
        first, last = before_a[i] != before_b[j], after_a[i] != after_b[j]
        starts.append((i[first], j[first]))
        ends.append((i[last], j[last]))
        done = end
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    (si, sj), (ei, ej) = (tuple(np.concatenate(x) for x in zip(*p, strict=True)) for p in (starts, ends))
    s, e = np.lexsort((si, si - sj)), np.lexsort((ei, ei - ej))  # along each diagonal starts and ends alternate
    return si[s], sj[s], ei[e] - si[s] + 1


def doubled(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the stretches of 1, 2, 4, ... words of both, as long as both have one."""
    out, size = [(a, b)], 1
    while 2 * size <= min(len(a), len(b)):
        pairs = [x[:-size] * (len(a) + len(b) + 1) + x[size:] for x in out[-1]]
        both = np.unique(np.concatenate(pairs), return_inverse=True)[1]
        out.append((both[: len(pairs[0])], both[len(pairs[0]) :]))
        size *= 2
    return out


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """The number of words in matching blocks."""
    if not len(a) or not len(b):
        return 0
    numbered = doubled(a, b)
    total, parts = 0, [(0, len(a), 0, len(b), len(numbered) - 1, None)]
    while parts:
        a0, a1, b0, b1, k, runs = parts.pop()
        if (a1 - a0) * (b1 - b0) <= SMALL and k and runs is None:
            k = 0
        while runs is None and k >= 0:
            size = 1 << k
            if size <= min(a1 - a0, b1 - b0):
                i, j, n = common_runs(numbered[k][0][a0 : a1 - size + 1], numbered[k][1][b0 : b1 - size + 1])
                if len(i):
                    runs = i + a0, j + b0, n + size - 1
                    break
            k -= 1
        if runs is None:
            continue
        i, j, n = runs
        best = np.flatnonzero(n == n.max())
        c = best[np.lexsort((j[best], i[best]))[0]]
        x, y, size = int(i[c]), int(j[c]), int(n[c])
        total += size
        for p0, p1, r0, r1 in ((a0, x, b0, y), (x + size, a1, y + size, b1)):
            if p0 < p1 and r0 < r1:
                cut = np.maximum(0, np.maximum(p0 - i, r0 - j))
                left = np.minimum(n - cut, np.minimum(p1 - i, r1 - j) - cut)
                own = left >= 1 << k
                if own.any():
                    parts.append((p0, p1, r0, r1, k, (i[own] + cut[own], j[own] + cut[own], left[own])))
                elif k:
                    parts.append((p0, p1, r0, r1, k - 1, None))
    return total


def ratio(a: list[str], b: list[str]) -> float:
    """Twice the matched words over all words; 1 for two empty sequences."""
    if not a and not b:
        return 1.0
    return 2.0 * matched(*numbers(a, b)) / (len(a) + len(b))
