"""NumPy kernels over rings, lines and boxes; planar metres, float64.

Rings are arrays of (x, y), open or closed. Where a result is an area of arbitrary polygons, it is exact: the plane
is cut at every vertex and crossing, and between two cuts everything is a trapezoid.
"""

from __future__ import annotations

import math

import numpy as np


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2)


def length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum())


def clip_line(p: np.ndarray, q: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray] | None:
    """The part of a segment inside a box (by its parameter interval), or None."""
    d, t0, t1 = q - p, 0.0, 1.0
    for axis, lo, hi in ((0, box[0], box[2]), (1, box[1], box[3])):
        if d[axis] == 0:
            if not lo <= p[axis] <= hi:
                return None
            continue
        a, b = sorted(((lo - p[axis]) / d[axis], (hi - p[axis]) / d[axis]))
        t0, t1 = max(t0, a), min(t1, b)
    return (p + t0 * d, p + t1 * d) if t0 < t1 else None


def clip_polygon(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut by a box's four half planes; empty where nothing is left."""
    out = np.asarray(ring, float)
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(out):
            break
        inside = sign * (out[:, axis] - bound) >= 0
        nxt, nin = np.roll(out, -1, 0), np.roll(inside, -1)
        pts = []
        for a, b, ina, inb in zip(out, nxt, inside, nin, strict=True):
            if ina:
                pts.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                pts.append(a + t * (b - a))
        out = np.array(pts).reshape(-1, 2)
    return out


def contains(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Ray casting, even-odd."""
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    x0, y0 = ring[:, 0], ring[:, 1]
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    crosses = (y0 > y) != (y1 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x0 + (y - y0) / (y1 - y0) * (x1 - x0)
    return (crosses & (x < at)).sum(1) % 2 == 1


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """(ring, x0, y0, x1, y1) with x0 < x1; upright edges bound no trapezoid."""
    out = []
    for k, r in enumerate(rings):
        s = np.roll(r, -1, 0)
        flip = r[:, 0] > s[:, 0]
        a, b = np.where(flip[:, None], s, r), np.where(flip[:, None], r, s)
        keep = a[:, 0] < b[:, 0]
        out.append(np.column_stack((np.full(keep.sum(), k), a[keep], b[keep])))
    return np.concatenate(out) if out else np.empty((0, 5))


def sweep_area(groups: list[list[np.ndarray]], need: int) -> float:
    """Area covered by at least ``need`` of the groups."""
    rings = [r for g in groups for r in g]
    owner = np.array([k for k, g in enumerate(groups) for _ in g])
    e = _edges(rings)
    if not len(e):
        return 0.0
    xs = set(e[:, 1]) | set(e[:, 3])
    slope = (e[:, 4] - e[:, 2]) / (e[:, 3] - e[:, 1])
    base = e[:, 2] - slope * e[:, 1]
    for i in range(len(e)):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base - base[i]) / (slope[i] - slope)
        ok = np.isfinite(x) & (x > np.maximum(e[:, 1], e[i, 1])) & (x < np.minimum(e[:, 3], e[i, 3]))
        xs |= set(x[ok])
    cuts, total = np.array(sorted(xs)), 0.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mid = (a + b) / 2
        on = (e[:, 1] <= a) & (e[:, 3] >= b)
        y = base[on] + slope[on] * mid
        ring = e[on, 0].astype(int)
        order = np.argsort(y, kind="stable")
        inside, depth, last = np.zeros(len(rings), bool), np.zeros(len(groups), int), 0.0
        for n, k in zip(y[order], ring[order], strict=True):
            if (depth > 0).sum() >= need:
                total += (n - last) * (b - a)
            inside[k] ^= True
            depth[owner[k]] += 1 if inside[k] else -1
            last = n
    return float(total)


def union_area(rings: list[np.ndarray]) -> float:
    return sweep_area([[r] for r in rings], 1)


def intersection_area(a: np.ndarray, b: np.ndarray) -> float:
    return sweep_area([[a], [b]], 2)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    """Of the even-odd areas, so a ring that crosses itself is like itself."""
    either = union_area([a, b])
    return intersection_area(a, b) / either if either > 0 else 0.0


def inside_capsule(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float) -> float:
    """Metres of segment pq within ``reach`` of segment ab: the quadratics of the two discs and the strip's linear bounds."""
    d, total = q - p, math.hypot(*(q - p))
    if total == 0:
        return 0.0
    spans = []
    for c in (a, b):
        f = p - c
        A, B, Cc = d @ d, 2 * (f @ d), f @ f - reach * reach
        disc = B * B - 4 * A * Cc
        if disc > 0:
            spans.append(((-B - math.sqrt(disc)) / (2 * A), (-B + math.sqrt(disc)) / (2 * A)))
    n = b - a
    size = math.hypot(*n)
    if size > 0:
        u = n / size
        lo, hi = -math.inf, math.inf
        for axis, least, most in ((u, 0.0, size), (np.array([-u[1], u[0]]), -reach, reach)):
            s, v = (p - a) @ axis, d @ axis
            if abs(v) < 1e-15:
                if not least <= s <= most:
                    lo, hi = 1.0, 0.0
            else:
                t = sorted(((least - s) / v, (most - s) / v))
                lo, hi = max(lo, t[0]), min(hi, t[1])
        if lo < hi:
            spans.append((lo, hi))
    covered, at = 0.0, 0.0
    for lo, hi in sorted(spans):
        lo, hi = max(lo, at), min(hi, 1.0)
        if hi > lo:
            covered += hi - lo
            at = hi
    return covered * total


def axis_share(a: np.ndarray, b: np.ndarray, reach: float = 0.4) -> float:
    """Least share of either line's length within ``reach`` of the other; zero for empty lines."""
    la, lb = length(a), length(b)
    if la == 0 or lb == 0:
        return 0.0
    return min(_near(a, b, reach) / la, _near(b, a, reach) / lb)


def _near(a: np.ndarray, b: np.ndarray, reach: float, step: float = 0.05) -> float:
    """Metres of polyline a within reach of polyline b; exact where b is one segment, by fine samples otherwise."""
    if len(b) == 2:
        return sum(inside_capsule(p, q, b[0], b[1], reach) for p, q in zip(a[:-1], a[1:], strict=True))
    total = 0.0
    for p, q in zip(a[:-1], a[1:], strict=True):
        n = max(1, math.ceil(math.hypot(*(q - p)) / step))
        t = (np.arange(n) + 0.5)[:, None] / n
        total += math.hypot(*(q - p)) * float((line_distance(p + t * (q - p), b) <= reach).mean())
    return total


def line_distance(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    a, d = line[:-1], np.diff(line, axis=0)
    n = (d * d).sum(1)
    rel = points[:, None, :] - a[None]
    t = np.clip((rel * d).sum(2) / np.where(n > 0, n, 1), 0, 1)
    return np.sqrt(((rel - t[..., None] * d) ** 2).sum(2)).min(1)


def length_in(line: np.ndarray, ring: np.ndarray) -> float:
    """Metres of a polyline inside a ring, segment by segment, so a stretch walked twice counts twice."""
    total = 0.0
    r, s = ring, np.roll(ring, -1, 0)
    for p, q in zip(line[:-1], line[1:], strict=True):
        d, e = q - p, s - r
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        w = r - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den
            u = (w[:, 0] * d[1] - w[:, 1] * d[0]) / den
        cut = np.unique(np.concatenate(([0.0, 1.0], t[(den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)])))
        mid = p + ((cut[:-1] + cut[1:]) / 2)[:, None] * d
        total += float((np.diff(cut) * contains(ring, mid)).sum()) * math.hypot(*d)
    return total


def min_rectangle(points: np.ndarray) -> tuple[float, float]:
    """(long, short) side of the smallest-area rotated rectangle, over the hull's edge directions."""
    h = hull(points)
    if len(h) < 3:
        return (float(np.hypot(*(h[-1] - h[0]))), 0.0)
    best = None
    for d in np.roll(h, -1, 0) - h:
        n = math.hypot(*d)
        if n == 0:
            continue
        u = d / n
        a, b = np.ptp(h @ u), np.ptp(h @ np.array([-u[1], u[0]]))
        if best is None or a * b < best[0]:
            best = (a * b, max(a, b), min(a, b))
    return float(best[1]), float(best[2])


def hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(map(tuple, np.unique(np.asarray(points, float), axis=0)))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Keeps the ends and, between them, what deviates more than the tolerance."""
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d = line_distance(line[i + 1 : j], line[[i, j]])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[sorted(keep)]


def offset_quad(p0: np.ndarray, p1: np.ndarray, q0: np.ndarray, q1: np.ndarray, inset: float = 0.3) -> np.ndarray:
    """Quadrilateral between two axes, inset from both."""
    side = (q0 + q1) / 2 - (p0 + p1) / 2
    n = side / math.hypot(*side)
    return np.array([p0 + inset * n, p1 + inset * n, q1 - inset * n, q0 - inset * n])


# Transverse Mercator by Krueger's series to the third flattening's sixth order is below a nanometre in a zone;
# four orders are enough for a millimetre. WGS 84 and the UTM scheme.
SEMI_MAJOR, INVERSE_FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 298.257223563, 0.9996, 500_000.0


def _series() -> tuple[float, float, list[float], list[float]]:
    f = 1 / INVERSE_FLATTENING
    n = f / (2 - f)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return math.sqrt(f * (2 - f)), radius, alpha, beta


def to_utm(lon: np.ndarray, lat: np.ndarray, zone: int = 35) -> tuple[np.ndarray, np.ndarray]:
    e, radius, alpha, _ = _series()
    phi, lam = np.radians(lat), np.radians(lon) - math.radians(6 * zone - 183)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(alpha, 1):
        x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * radius * x, SCALE * radius * y


def from_utm(x: np.ndarray, y: np.ndarray, zone: int = 35) -> tuple[np.ndarray, np.ndarray]:
    e, radius, _, beta = _series()
    xi0, eta0 = np.asarray(y) / (SCALE * radius), (np.asarray(x) - FALSE_EASTING) / (SCALE * radius)
    xi, eta = xi0.copy(), eta0.copy()
    for j, b in enumerate(beta, 1):
        xi -= b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
        eta -= b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
    t0 = np.sin(xi) / np.sqrt(np.sinh(eta) ** 2 + np.cos(xi) ** 2)
    t = t0.copy()
    for _ in range(6):  # Newton on the conformal latitude
        s = np.sinh(e * np.arctanh(e * t / np.sqrt(1 + t * t)))
        now = t * np.sqrt(1 + s * s) - s * np.sqrt(1 + t * t)
        t += (t0 - now) / np.sqrt(1 + now * now) * (1 + (1 - e * e) * t * t) / ((1 - e * e) * np.sqrt(1 + t * t))
    return np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))) + 6 * zone - 183, np.degrees(np.arctan(t))


def pieces(groups: list[list[np.ndarray]], keep) -> list[np.ndarray]:
    """Single rings that tile the places where ``keep`` (of a boolean for each group) holds: trapezoids between upright cuts,
    joined along the axis while the same two edges bound them. No piece has a hole.
    """
    rings = [r for g in groups for r in g]
    owner = np.array([k for k, g in enumerate(groups) for _ in g])
    e = _edges(rings)
    if not len(e):
        return []
    slope = (e[:, 4] - e[:, 2]) / (e[:, 3] - e[:, 1])
    base = e[:, 2] - slope * e[:, 1]
    xs = set(e[:, 1]) | set(e[:, 3])
    for i in range(len(e)):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base - base[i]) / (slope[i] - slope)
        xs |= set(x[np.isfinite(x) & (x > np.maximum(e[:, 1], e[i, 1])) & (x < np.minimum(e[:, 3], e[i, 3]))])
    open_: dict[tuple[int, int], float] = {}
    out: list[np.ndarray] = []

    def close(pair: tuple[int, int], a: float, b: float) -> None:
        lo, hi = pair
        y = lambda k, x: base[k] + slope[k] * x
        ring = np.array([[a, y(lo, a)], [b, y(lo, b)], [b, y(hi, b)], [a, y(hi, a)]])
        if area(ring) > 1e-12:
            out.append(ring)

    cuts = sorted(xs)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        on = np.flatnonzero((e[:, 1] <= a) & (e[:, 3] >= b))
        order = on[np.argsort(base[on] + slope[on] * (a + b) / 2, kind="stable")]
        inside, depth, low, now = np.zeros(len(rings), bool), np.zeros(len(groups), int), None, {}
        for k in order:
            r = int(e[k, 0])
            inside[r] ^= True
            depth[owner[r]] += 1 if inside[r] else -1
            holds = bool(keep(depth > 0))
            if holds and low is None:
                low = k
            elif not holds and low is not None:
                now[(int(low), int(k))] = open_.get((int(low), int(k)), a)
                low = None
        for pair, since in open_.items():
            if pair not in now:
                close(pair, since, a)
        open_ = now
    for pair, since in open_.items():
        close(pair, since, cuts[-1])
    return out


def difference(a: np.ndarray, others: list[np.ndarray], least: float = 0.0) -> list[np.ndarray]:
    """What is left of a ring without the others, as single rings of at least an area."""
    return [r for r in pieces([[a], others], lambda inside: inside[0] and not inside[1]) if area(r) >= least]


def intersection(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    return pieces([[a], [b]], lambda inside: inside.all())


def slices(ring: np.ndarray, direction: np.ndarray, step: float) -> list[tuple[int, float, np.ndarray]]:
    """(bin, area, centre) of a ring cut in stretches of ``step`` along a direction."""
    u = direction / math.hypot(*direction)
    turn = np.array([[u[0], u[1]], [-u[1], u[0]]])
    p = ring @ turn.T
    out = []
    for k in range(math.floor(p[:, 0].min() / step), math.floor(p[:, 0].max() / step) + 1):
        part = clip_polygon(p, (k * step, p[:, 1].min(), (k + 1) * step, p[:, 1].max()))
        if len(part) > 2 and area(part) > 0:
            x, y = part[:, 0], part[:, 1]
            cross = x * np.roll(y, -1) - np.roll(x, -1) * y
            centre = np.array([((x + np.roll(x, -1)) * cross).sum(), ((y + np.roll(y, -1)) * cross).sum()]) / (3 * cross.sum())
            out.append((k, area(part), centre @ turn))
    return out


def moved_edges(ring: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A convex ring with every edge moved outward by its own distance (inward where negative) and neighbours cut again; empty where an edge is left without length."""
    if area(ring) == 0:
        return np.empty((0, 2))
    r = np.asarray(ring, float)
    if np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]) < 0:
        r, by = r[::-1], np.roll(by[::-1], -1)
    d = np.roll(r, -1, axis=0) - r
    d /= np.hypot(d[:, 0], d[:, 1])[:, None]
    at = r + np.stack((d[:, 1], -d[:, 0]), 1) * np.asarray(by, float)[:, None]  # a point of each moved edge
    p, e = np.roll(at, 1, axis=0), np.roll(d, 1, axis=0)  # the edge before
    cross = e[:, 0] * d[:, 1] - e[:, 1] * d[:, 0]
    w = at - p
    straight = np.abs(cross) < 1e-12
    t = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / np.where(straight, 1.0, cross)
    out = np.where(straight[:, None], at, p + e * t[:, None])
    along = ((np.roll(out, -1, axis=0) - out) * d).sum(1)
    return out if (along > 0).all() else np.empty((0, 2))


def shortest_line(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points of two rings; the same point twice where they meet."""
    if intersection_area(a, b) > 0:
        p = np.asarray(intersection(a, b)[0][0], float)
        return p, p
    best = (np.inf, a[0], b[0])
    for first, second, turned in ((a, b, False), (b, a, True)):
        p, q = second, np.roll(second, -1, axis=0)
        d = q - p
        for v in np.asarray(first, float):
            t = np.clip(((v - p) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
            foot = p + d * t[:, None]
            far = np.hypot(*(foot - v).T)
            k = int(far.argmin())
            if far[k] < best[0]:
                best = (far[k], foot[k], v) if turned else (far[k], v, foot[k])
    return best[1], best[2]
