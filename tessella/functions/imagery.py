"""Detectors composed of the raster kernels: colour evidence, canopy masks, planted regions, trees, bright blobs.

Images are (height, width, 3) arrays of 0 to 255; all thresholds are parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from . import rasters as R


def excess_green(rgb: np.ndarray, dark: float = 30.0) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    total = r + g + b
    return np.where(total > dark, (2 * g - r - b) / np.maximum(total, 1), 0.0)


def visible(rgb: np.ndarray, dark: float = 30.0) -> np.ndarray:
    """Pixels with light, and dark ones enclosed by them."""
    return R.without_holes(rgb.astype(int).sum(-1) > dark)


def background(a: np.ndarray, size: int) -> np.ndarray:
    """Median over size x size neighbourhoods, borders mirrored."""
    p = np.pad(a, size // 2, mode="reflect")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size))[: a.shape[0], : a.shape[1]], axis=(2, 3))


def evidence(rgb: np.ndarray, coarse: int, size: int) -> dict[str, np.ndarray]:
    """Per pixel how much lighter, more colourful and darker it is than its surroundings' median on a coarse grid."""
    lum = rgb.astype(float).mean(-1)
    chroma = rgb.max(-1).astype(float) - rgb.min(-1)

    def around(x: np.ndarray) -> np.ndarray:
        b = R.repeat(background(R.block_mean(x, coarse), size), coarse)
        return np.pad(b, [(0, x.shape[0] - b.shape[0]), (0, x.shape[1] - b.shape[1])], mode="edge")

    dl, dc = lum - around(lum), chroma - around(chroma)
    return {"white": np.maximum(0, dl - np.maximum(0, dc)), "colour": np.maximum(0, dc), "black": np.maximum(0, -dl)}


def bright_blobs(rgb: np.ndarray, px: float, white: float = 60.0, coarse: int = 8, size: int = 5, least_m2: float = 0.02) -> pd.DataFrame:
    """Blobs of white evidence with their shape and the green share of a ring around them."""
    e = evidence(rgb, coarse, size)["white"]
    lab, n = R.labels(e >= white)
    f = R.blob_features(lab, n, e, px)
    green = excess_green(rgb) > 0.1
    ring = [float(green[R.dilate(lab == k, R.disk(4)) & (lab == 0)].mean()) for k in f["label"]]
    return f.assign(ring_green=ring)[f["area_m2"] >= least_m2].reset_index(drop=True)


def canopy_mask(rgb: np.ndarray, tube: np.ndarray, px: float, green: float = 0.1, close_m: float = 0.15, least_m2: float = 0.2, most_strip_m: float = 12.0, lively: float = 6.0) -> np.ndarray:
    """Green pixels in a tube around the rows, closed, holes filled; specks go, and so do long pale strips (grass)."""
    mask = R.without_holes(R.closed((excess_green(rgb) > green) & tube, R.disk(max(1.0, close_m / px)))) & tube
    lab, n = R.labels(mask)
    f = R.blob_features(lab, n, rgb[..., 1].astype(float) - rgb[..., 0], px)
    drop = (f["area_m2"] < least_m2) | ((f["length_m"] > most_strip_m) & (f["value"] < lively))
    return mask & ~np.isin(lab, f.loc[drop, "label"])


def planted_regions(near: np.ndarray, wide: np.ndarray, orientation: np.ndarray, px: float, level: float, ratio: float = 1.0, open_m: float = 4.0, least_m2: float = 400.0, least_share: float = 0.2, apart: int = 3) -> list[tuple[np.ndarray, int]]:
    """(mask, orientation bin) of regions whose texture is of rows: enough energy, more of it near the vine spacing than the orchard's, split by direction.

    A region's 12-bin histogram of directions, smoothed around the circle, gives its modes: at least a fifth of the pixels, three bins apart.
    """
    mask = R.opened((near > level) & (near > ratio * wide), R.disk(max(1.0, open_m / px)))
    lab, n = R.labels(mask)
    out = []
    for k in range(1, n + 1):
        own = lab == k
        if own.sum() * px * px < least_m2:
            continue
        h = np.bincount(orientation[own], minlength=12).astype(float)
        h = (np.roll(h, 1) + 2 * h + np.roll(h, -1)) / 4
        modes: list[int] = []
        for b in np.argsort(-h, kind="stable"):
            if h[b] >= least_share * own.sum() / 2 and all(min((b - m) % 12, (m - b) % 12) >= apart for m in modes):
                modes.append(int(b))
        modes = modes or [int(h.argmax())]
        gap = np.stack([np.minimum((orientation - m) % 12, (m - orientation) % 12) for m in modes])
        side = gap.argmin(0)
        out += [(own & (side == i), m) for i, m in enumerate(modes) if (own & (side == i)).any()]
    return out


def trees(rgb: np.ndarray, px: float, radius_m: float = 2.2, green: float = 0.1, dark: float = 60.0) -> pd.DataFrame:
    """Round green bodies wider than rows: opening by a disk; shape, shadow share of a ring, texture and a confidence."""
    g = excess_green(rgb) > green
    body = R.opened(g, R.disk(radius_m / px))
    lab, n = R.labels(body)
    f = R.blob_features(lab, n, rgb[..., 1].astype(float), px)
    lum = rgb.astype(float).mean(-1)
    shadow, texture = [], []
    for k in f["label"]:
        own = lab == k
        ring = R.dilate(own, R.disk(max(1.0, 1.0 / px))) & ~own
        shadow.append(float((lum[ring] < dark).mean()))
        texture.append(float(lum[own].std()))
    f = f.assign(shadow_share=shadow, texture=texture)
    round_ = f["width_m"] / f["length_m"].clip(lower=1e-9)
    return f.assign(confidence=(0.5 * round_ + 0.5 * np.minimum(1.0, np.array(shadow) / 0.2)).round(2))


def row_angle(a: np.ndarray, px: float, low: float, high: float, coarse: float = 5.0, fine: float = 0.5) -> tuple[float, float]:
    """(degrees, spacing) of rows in a patch: the direction whose across profile has the largest amplitude at its period, coarse then fine."""
    h, w = a.shape
    y, x = np.mgrid[:h, :w] * px
    y, x = y - y.mean(), x - x.mean()

    def strength(deg: float) -> tuple[float, float]:
        t = np.radians(deg)
        v = np.round((-x * np.sin(t) + y * np.cos(t)) / px).astype(int)
        v -= v.min()
        n = np.bincount(v.ravel())
        p = np.bincount(v.ravel(), a.ravel()) / np.maximum(n, 1)
        keep = n >= 0.3 * n.max()
        p = p[keep]
        spacing, _ = R.profile_spacing(p, px, low, high)
        if spacing != spacing:
            return 0.0, spacing
        return float(abs(np.mean((p - p.mean()) * np.exp(-2j * np.pi * np.arange(len(p)) * px / spacing)))), spacing

    best = max(np.arange(0, 180, coarse), key=lambda d: strength(d)[0])
    best = max(np.arange(best - coarse, best + coarse + fine, fine), key=lambda d: strength(d)[0])
    return float(best % 180), strength(best)[1]
