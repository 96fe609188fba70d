"""Sequential kernels on one pattern's rows: removal of rows too close, growth outward, splits at necks."""

from __future__ import annotations

import heapq

import numpy as np


def without_close(at: np.ndarray, green: np.ndarray, spacing: float, share: float = 0.7) -> np.ndarray:
    """Indices kept so that no gap is below ``share`` of the spacing: the narrowest gap (the leftmost of equal ones) loses its less green end (the right one of equal ones), and so on.

    Gaps wait in a heap and rows are linked to their neighbours, so that a removal costs the logarithm of the rows.
    """
    order = np.argsort(at, kind="stable").tolist()
    n, least = len(order), share * spacing
    before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
    gap = lambda i, j: (float(at[order[j]] - at[order[i]]), i, j)
    waiting = [gap(i, i + 1) for i in range(n - 1)]
    heapq.heapify(waiting)
    while waiting and waiting[0][0] < least:
        _, i, j = heapq.heappop(waiting)
        if gone[i] or gone[j]:
            continue
        loser = i if green[order[i]] < green[order[j]] else j
        gone[loser] = True
        left, right = before[loser], after[loser]
        if left >= 0:
            after[left] = right
        if right < n:
            before[right] = left
        if left >= 0 and right < n:
            heapq.heappush(waiting, gap(left, right))
    return np.sort(np.array([k for k, out in zip(order, gone, strict=True) if not out], int))


def grown(evidence: np.ndarray, start: tuple[int, int], level: float, lapse: int) -> tuple[int, int]:
    """[lo, hi) of a stretch grown from a seed along a profile, until evidence has lapsed for more than ``lapse`` steps on either side."""
    lo, hi = start
    for step in (-1, 1):
        at, good = (lo, lo) if step < 0 else (hi - 1, hi - 1)
        while 0 <= at + step < len(evidence) and abs(at + step - good) <= lapse + 1:
            at += step
            if evidence[at] >= level:
                good = at
        if step < 0:
            lo = good
        else:
            hi = good + 1
    return lo, hi


def grown_rows(evidence: np.ndarray, seed: int, level: float) -> list[int]:
    """Rows reached outward from a seed row, each next one with enough evidence (its mean)."""
    strong = evidence.mean(1) >= level
    rows = [seed] if strong[seed] else []
    for step in (-1, 1):
        k = seed + step
        while rows and 0 <= k < len(evidence) and strong[k]:
            rows.append(k)
            k += step
    return sorted(rows)


def split_at_necks(width: np.ndarray, share: float, least: int, base: int = 0) -> list[tuple[int, int]]:
    """[start, end) parts of a body given by its width along an axis: cut at the deepest neck below ``share`` of the smaller side's peak, both sides at least ``least`` long, and so on in the parts."""
    n, best = len(width), None
    for i in range(least, n - least):
        peak = min(width[:i].max(), width[i + 1 :].max()) if i + 1 < n else 0
        if peak > 0 and width[i] < share * peak and (best is None or width[i] / peak < best[0]):
            best = (width[i] / peak, i)
    if best is None:
        return [(base, base + n)]
    i = best[1]
    return split_at_necks(width[:i], share, least, base) + split_at_necks(width[i:], share, least, base + i)
