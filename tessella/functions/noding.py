"""Kernels for edges (g, x0, y0, x1, y1) of small groups on a whole-number grid, several groups at a time: the steps of ``operators.outlines`` in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HALF = 1 << 30  # beyond twice any coordinate


def _ranges(start: np.ndarray, end: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), start[i] <= j < end[i], about ``most`` at a time."""
    n = np.maximum(end - start, 0)
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + most, "right")))
        m = n[lo:hi]
        skip = np.cumsum(m) - m
        yield np.repeat(np.arange(lo, hi), m), np.arange(int(m.sum())) + np.repeat(start[lo:hi] - skip, m)
        lo = hi


def _turn(ax, ay, bx, by, px, py) -> np.ndarray:
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _rounded(v: np.ndarray) -> np.ndarray:
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns, first one first, and where a new value begins in it."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in columns], axis=0)
    return order, new


def merged(g: np.ndarray, e: np.ndarray, n: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges by their ends, the smaller end first, with the sums of n and net."""
    back = (e[0] > e[2]) | ((e[0] == e[2]) & (e[1] > e[3]))
    e, net = np.where(back, e[[2, 3, 0, 1]], e), np.where(back, -net, net)
    order, new = distinct(g, *e)
    at = np.flatnonzero(new)
    return g[order][at], e[:, order][:, at], np.add.reduceat(n[order], at), np.add.reduceat(net[order], at)


def cuts(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edge, x, y): distinct points inside edges at which another edge of the group crosses or ends."""
    lo, hi = np.minimum(e[:2], e[2:]), np.maximum(e[:2], e[2:])
    base = g * (4 * HALF) + HALF
    order = np.argsort(base + lo[0], kind="stable")
    first = (base + lo[0])[order]
    ends = np.searchsorted(first, (base + hi[0])[order], "right")
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    for i, j in _ranges(np.arange(1, len(g) + 1), ends):
        a, b = order[i], order[j]
        near = (lo[1][a] <= hi[1][b]) & (lo[1][b] <= hi[1][a])
        a, b = a[near], b[near]
        p, q = e[:, a], e[:, b]
        t = [_turn(*q, *p[:2]), _turn(*q, *p[2:]), _turn(*p, *q[:2]), _turn(*p, *q[2:])]
        for mine, at, other, r, box in ((t[0], p[:2], b, q, b), (t[1], p[2:], b, q, b), (t[2], q[:2], a, p, a), (t[3], q[2:], a, p, a)):
            on = np.flatnonzero(mine == 0)
            x, y, o = at[0][on], at[1][on], box[on]
            on_box = (x >= lo[0][o]) & (x <= hi[0][o]) & (y >= lo[1][o]) & (y <= hi[1][o])
            for c, v in zip(found, (other[on], x, y), strict=True):
                c.append(v[on_box])
        cross = np.flatnonzero((t[0] * t[1] == -1) & (t[2] * t[3] == -1))
        p, q = p[:, cross], q[:, cross]
        (ax, ay), (bx, by) = p[2:] - p[:2], q[2:] - q[:2]
        along = ((q[0] - p[0]) * by - (q[1] - p[1]) * bx).astype(float) / (ax * by - ay * bx).astype(float)
        x, y = _rounded(p[0] + along * ax), _rounded(p[1] + along * ay)
        for c, v in zip(found, ((a[cross], b[cross]), (x, x), (y, y)), strict=True):
            c += v
    edge, x, y = (np.concatenate(c) for c in found)
    inside = ((x != e[0][edge]) | (y != e[1][edge])) & ((x != e[2][edge]) | (y != e[3][edge]))
    edge, x, y = edge[inside], x[inside], y[inside]
    order, new = distinct(edge, x, y)
    return tuple(c[order][new] for c in (edge, x, y))


def noded(g: np.ndarray, e: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """``merged`` edges of which no two of a group cross or touch but at their ends; groups without cuts are done."""
    one = np.ones(len(g), np.int64)
    g, e, n, net = merged(g, e, one, one)
    done: list[tuple[np.ndarray, ...]] = []
    for _ in range(rounds):
        edge, x, y = cuts(g, e)
        if not len(edge):
            done.append((g, e, n, net))
            return tuple(np.concatenate(c, axis=-1) for c in zip(*done, strict=True))
        rest = ~np.isin(g, g[edge])
        done.append((g[rest], e[:, rest], n[rest], net[rest]))
        whole = np.flatnonzero(~rest)
        # a crossing that was moved may lie beside its edge: the order along the edge is that of its projection
        edge, x, y = np.concatenate((edge, whole, whole)), np.concatenate((x, e[0][whole], e[2][whole])), np.concatenate((y, e[1][whole], e[3][whole]))
        along = (x - e[0][edge]) * (e[2] - e[0])[edge] + (y - e[1][edge]) * (e[3] - e[1])[edge]
        order = np.lexsort((y, x, along, edge))
        edge, x, y = edge[order], x[order], y[order]
        same = np.flatnonzero(edge[1:] == edge[:-1])
        of = edge[same]
        g, e, n, net = merged(g[of], np.stack((x[same], y[same], x[same + 1], y[same + 1])), n[of], net[of])
    raise RuntimeError(f"edges still cross after {rounds} rounds")


def boundary(g: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (g, ends) that bound the even-odd area, directed so that it lies on their left. What covers an edge's middle is counted along a ray just above it."""
    odd = n % 2 == 1
    g, e = g[odd], e[:, odd]
    up = e[3] > e[1]
    px, py = e[0] + e[2], e[1] + e[3]
    base = g * (4 * HALF) + HALF
    order = np.argsort(base + py, kind="stable")
    points = (base + py)[order]
    low, high = 2 * np.minimum(e[1], e[3]), 2 * np.maximum(e[1], e[3])
    cover = np.zeros(len(g), np.int64)
    for f, j in _ranges(np.searchsorted(points, base + low), np.searchsorted(points, base + high)):
        p = order[j]
        side = _turn(2 * e[0][f], 2 * e[1][f], 2 * e[2][f], 2 * e[3][f], px[p], py[p])
        cover += np.bincount(p[np.where(up[f], side < 0, side > 0)], minlength=len(g))
    left = cover + ~(up | (e[1] == e[3]))
    return g, np.where(left % 2 == 1, e, e[[2, 3, 0, 1]])


def turns(g: np.ndarray, e: np.ndarray, clockwise: bool = True) -> np.ndarray:
    """The next edge, clockwise or not, at the end of each."""
    m = len(g)
    d = np.concatenate((e[2:] - e[:2], e[:2] - e[2:]), axis=1)
    a, b = np.abs(d).astype(float)
    quarter = np.where((d[0] >= 0) & (d[1] >= 0), 0, np.where((d[0] < 0) & (d[1] >= 0), 1, np.where(d[0] < 0, 2, 3)))
    odd = (a >= b) == (quarter % 2 == 1)
    ratio = np.minimum(a, b) / np.maximum(a, b)
    at = (np.tile(g, 2), np.concatenate((e[0], e[2])), np.concatenate((e[1], e[3])))
    order = np.lexsort((np.where(odd, -ratio, ratio), 2 * quarter + odd, at[2], at[1], at[0]))
    new = np.ones(2 * m, bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in at], axis=0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], 2 * m) - 1
    # ends in and out alternate, so the one beside an end in is an end out
    beside = np.arange(2 * m) + (-1 if clockwise else 1)
    if clockwise:
        beside[starts] = ends
    else:
        beside[ends] = starts
    into = order >= m
    following = np.zeros(m, np.int64)
    following[order[into] - m] = order[beside[into]]
    return following
