"""Array kernels on small images, and their Arrow-batched operators. Images are binary columns with h and w."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The derivative and smoothing taps of the named gradient filters.
FARID3 = ((0.229879, 0.540242, 0.229879), (0.425287, 0.0, -0.425287))
FARID5 = ((0.037659, 0.249153, 0.426375, 0.249153, 0.037659), (0.109604, 0.276691, 0.0, -0.276691, -0.109604))


def convolve1(img: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Convolution along one axis with edge values repeated."""
    r = len(taps) // 2
    pad = [(0, 0)] * img.ndim
    pad[axis] = (r, len(taps) - 1 - r)
    p = np.pad(img, pad, mode="edge")
    n = img.shape[axis]
    return sum(t * np.take(p, np.arange(len(taps) - 1 - k, len(taps) - 1 - k + n), axis) for k, t in enumerate(taps))


def gaussian_taps(sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    g = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    return g / g.sum()


def gradients(img: np.ndarray, kind: str = "central", sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(d/dx, d/dy) of the last two axes (rows, columns)."""
    img = np.asarray(img, float)
    if kind == "gaussian":
        g = gaussian_taps(sigma)
        smooth, derive = g, -np.arange(-(len(g) // 2), len(g) // 2 + 1) * g / sigma**2
        derive = derive / -(np.arange(-(len(g) // 2), len(g) // 2 + 1) * derive).sum()
    else:
        smooth, derive = {
            "central": ((1.0,), (0.5, 0.0, -0.5)), "hypomode": ((0.5, 0.5), (1.0, -1.0)), "farid3": FARID3, "farid5": FARID5
        }[kind]
    s, d = np.asarray(smooth), np.asarray(derive)
    return convolve1(convolve1(img, d, -1), s, -2), convolve1(convolve1(img, s, -1), d, -2)


def hog(img: np.ndarray, cell: int, bins: int, grad: str = "central", sigma: float = 1.0, norm: str | None = "patch", clip: float = 0.2) -> np.ndarray:
    """(cells, bins) histogram of unsigned gradient angles, shared between the two nearest bins, weighted by magnitude."""
    gx, gy = gradients(img, grad, sigma)
    mag = np.hypot(gx, gy)
    at = (np.arctan2(gy, gx) % math.pi) / math.pi * bins
    lo = np.floor(at).astype(int)
    part = at - lo
    h, w = img.shape[0] // cell, img.shape[1] // cell
    out = np.zeros((h * w, bins))
    which = (np.minimum(np.arange(img.shape[0]) // cell, h - 1)[:, None] * w + np.minimum(np.arange(img.shape[1]) // cell, w - 1)[None, :])
    np.add.at(out, (which, lo % bins), mag * (1 - part))
    np.add.at(out, (which, (lo + 1) % bins), mag * part)
    return normalise(out, norm, clip)


def normalise(h: np.ndarray, norm: str | None, clip: float = 0.2) -> np.ndarray:
    """L2, clip, L2 over the whole patch or each cell; a zero norm gives NaN."""
    if norm is None:
        return h
    axis = None if norm == "patch" else 1
    with np.errstate(invalid="ignore", divide="ignore"):
        n = np.minimum(h / np.sqrt((h * h).sum(axis, keepdims=True)), clip)
        return n / np.sqrt((n * n).sum(axis, keepdims=True))


def label_components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected foreground pieces numbered from 1 in scan order (8- or 4-connected)."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        before = lab.copy()
        for dy, dx in steps:
            a = (slice(0, -dy or None), slice(max(0, -dx), -dx if dx > 0 else None))
            b = (slice(dy, None), slice(max(0, dx), dx if dx < 0 else None))
            both = (lab[a] > 0) & (lab[b] > 0)
            low = np.minimum(lab[a], lab[b])
            lab[a][both] = low[both]
            lab[b][both] = np.minimum(lab[b], low)[both]
        flat = lab.ravel()
        root = np.concatenate(([0], np.arange(1, mask.size + 1)))
        np.minimum.at(root, np.arange(1, mask.size + 1)[mask.ravel()], flat[mask.ravel()])
        lab = np.where(mask, root[flat].reshape(mask.shape), 0)
        if (lab == before).all():
            break
    names = np.unique(lab[lab > 0])
    return np.where(lab > 0, np.searchsorted(names, lab) + 1, 0), len(names)


def ink_filter(mask: np.ndarray, min_ink: int = 50, min_hole: int = 50) -> np.ndarray:
    """Small foreground pieces removed, small enclosed holes filled."""
    lab, n = label_components(mask)
    keep = np.concatenate(([False], np.bincount(lab.ravel(), minlength=n + 1)[1:] >= min_ink))
    mask = keep[lab]
    holes, k = label_components(~mask, diagonal=False)
    edge = set(np.unique(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]])).tolist())
    size = np.bincount(holes.ravel(), minlength=k + 1)
    fill = np.array([i > 0 and i not in edge and size[i] < min_hole for i in range(k + 1)])
    return mask | fill[holes]


def threshold_of(img: np.ndarray, method: str = "otsu", bins: int = 256) -> float:
    """Global threshold by otsu, mean, isodata, li, triangle, minimum or yen."""
    x = np.asarray(img, float).ravel()
    if method == "mean":
        return float(x.mean())
    h, edge = np.histogram(x, bins)
    mid = (edge[:-1] + edge[1:]) / 2
    p = h / max(h.sum(), 1)
    w0 = np.cumsum(p)
    m0 = np.cumsum(p * mid)
    with np.errstate(invalid="ignore", divide="ignore"):
        if method == "otsu":
            between = (m0[-1] * w0 - m0) ** 2 / (w0 * (1 - w0))
            return float(mid[int(np.nanargmax(np.where(np.isfinite(between), between, -1)))])
        if method == "isodata":
            half = (m0 / w0 + (m0[-1] - m0) / (1 - w0)) / 2
            ok = np.flatnonzero(np.isfinite(half) & (half >= mid) & (half < mid + (edge[1] - edge[0])))
            return float(mid[ok[0]]) if len(ok) else float(x.mean())
        if method == "yen":
            s1, s2 = np.cumsum(p * p), np.cumsum((p * p)[::-1])[::-1]
            crit = np.log((w0[:-1] * (1 - w0[:-1])) ** 2 / (s1[:-1] * s2[1:]))
            return float(mid[int(np.nanargmax(np.where(np.isfinite(crit), crit, -np.inf)))])
    if method == "li":
        x0 = x - x.min()
        t = x0.mean()
        for _ in range(200):
            a, b = x0[x0 > t], x0[x0 <= t]
            if not len(a) or not len(b) or b.mean() <= 0:
                break
            new = (b.mean() - a.mean()) / (np.log(b.mean()) - np.log(a.mean()))
            if abs(new - t) < 1e-6:
                break
            t = new
        return float(t + x.min())
    if method == "triangle":
        peak, used = int(h.argmax()), np.flatnonzero(h)
        lo, hi = int(used[0]), int(used[-1])
        far = hi if hi - peak >= peak - lo else lo
        i = np.arange(min(peak, far), max(peak, far) + 1)
        d = np.abs((h[peak] - h[far]) * (i - far) - (peak - far) * (h[i] - h[far]))
        return float(mid[i[int(d.argmax())]])
    if method == "minimum":
        s = h.astype(float)
        for _ in range(10_000):
            peaks = np.flatnonzero((s[1:-1] > s[:-2]) & (s[1:-1] >= s[2:])) + 1
            if len(peaks) <= 2:
                break
            s = np.convolve(s, np.ones(3) / 3, "same")
        return float(mid[peaks[0] + int(s[peaks[0] : peaks[1] + 1].argmin())]) if len(peaks) == 2 else float(x.mean())
    raise ValueError(method)


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Largest distance from a pixel of one mask to the other, both ways; inf if exactly one or both are empty."""
    p, q = np.argwhere(a), np.argwhere(b)
    if not len(p) or not len(q):
        return math.inf
    d = ((p[:, None, :] - q[None, :, :]) ** 2).sum(2)
    return math.sqrt(max(d.min(1).max(), d.min(0).max()))


def dice(a, b) -> float:
    return float(2 * (a & b).sum() / (a.sum() + b.sum() + 1e-8))


def jaccard(a, b) -> float:
    return float((a & b).sum() / ((a | b).sum() + 1e-8))


def hamming(a, b) -> float:
    return float((a != b).mean())


METRICS: dict[str, Callable] = {"dice": dice, "jaccard": jaccard, "hamming": hamming, "hausdorff": hausdorff}


def distance_matrix(masks: list[np.ndarray], metric: Callable | str, diagonal: float = 0.0, failed: float = 999.0) -> np.ndarray:
    """Symmetric matrix from the upper triangle; a metric that raises counts as ``failed``."""
    f = METRICS[metric] if isinstance(metric, str) else metric
    n = len(masks)
    out = np.full((n, n), diagonal)
    for i in range(n):
        for j in range(i + 1, n):
            try:
                out[i, j] = out[j, i] = f(masks[i], masks[j])
            except Exception:
                out[i, j] = out[j, i] = failed
    return out


def mahalanobis_2d(dx: Column, dy: Column, a: float, b: float, c: float) -> Column:
    """Squared length of (dx, dy) under the inverse of the tensor [[a, b], [b, c]], in closed form."""
    det = a * c - b * b
    return (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det


def otsu_cut(values: DataFrame, col: str, bins: int) -> DataFrame:
    """Otsu's threshold of a column by histogram and running sums; one row. Only the histogram is windowed."""
    lim = F.broadcast(values.agg(F.min(col).alias("lo"), F.max(col).alias("hi")))
    b = F.least(F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    h = values.crossJoin(lim).groupBy(b.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    w = Window.orderBy("bin")
    every = Window.partitionBy()
    t = h.select("bin", mid.alias("mid"), "n").select("bin", "mid", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("mid")).over(w).alias("m0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("mid")).over(every).alias("m"))
    between = F.pow(F.col("m") * F.col("w0") / F.col("w") - F.col("m0"), 2) / (F.col("w0") * (F.col("w") - F.col("w0")))
    return t.where("w0 < w").select("bin", "mid", F.round(between, 6).alias("between")).orderBy(F.desc("between"), "bin").limit(1).select("bin", F.col("mid").alias("threshold"))


def per_image(df: DataFrame, fn: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows (id, image array<array<double>>) through ``fn``; id first in the output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", *[c.strip().split(" ")[0] for c in schema.split(",")]]
        for b in batches:
            rows = [(i, *r) for i, img in zip(b.id, b.image, strict=True) for r in fn(np.array([np.asarray(x, float) for x in img]))]
            yield pd.DataFrame(rows, columns=names)

    return df.select("id", "image").mapInPandas(run, "id long, " + schema)


def pca(x: np.ndarray, k: int, standardise: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(projections, explained variance shares); each axis points where its largest loading is positive."""
    c = x - x.mean(0)
    if standardise:
        c = c / np.where(c.std(0) > 0, c.std(0), 1)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    k = min(k, len(s))
    sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])
    total = (s * s).sum()
    return u[:, :k] * s[:k] * sign, (s * s / total)[:k] if total else np.zeros(k)


def crop(img: np.ndarray, left: int, top: int, width: int, height: int, mask: np.ndarray | None = None, fill: float = 0.0) -> np.ndarray:
    """A box of an image, what lies beyond the edge filled; with a mask, pixels outside it are filled too."""
    out = np.full((height, width), fill, img.dtype)
    y0, x0 = max(top, 0), max(left, 0)
    y1, x1 = min(top + height, img.shape[0]), min(left + width, img.shape[1])
    if y0 < y1 and x0 < x1:
        part = img[y0:y1, x0:x1]
        out[y0 - top : y1 - top, x0 - left : x1 - left] = part if mask is None else np.where(mask[y0:y1, x0:x1], part, fill)
    return out


def place(canvas: np.ndarray, img: np.ndarray, left: int, top: int) -> np.ndarray:
    """A copy of the canvas with the image at (left, top), clipped to the canvas."""
    out = canvas.copy()
    y0, x0 = max(top, 0), max(left, 0)
    y1, x1 = min(top + img.shape[0], out.shape[0]), min(left + img.shape[1], out.shape[1])
    if y0 < y1 and x0 < x1:
        out[y0:y1, x0:x1] = img[y0 - top : y1 - top, x0 - left : x1 - left]
    return out


def barycentre(mask: np.ndarray) -> tuple[float, float]:
    """(x, y) centre of mass; the middle of an empty mask."""
    m = np.asarray(mask, float)
    total = m.sum()
    if total == 0:
        return (m.shape[1] - 1) / 2, (m.shape[0] - 1) / 2
    return float((m.sum(0) * np.arange(m.shape[1])).sum() / total), float((m.sum(1) * np.arange(m.shape[0])).sum() / total)


def watershed(score: np.ndarray, low: float, high: float) -> tuple[np.ndarray, int]:
    """Pieces of score > high grown over score > low, highest score first; a pixel joins the piece that reaches it first."""
    seeds, n = label_components(score > high, diagonal=False)
    out = seeds.copy()
    heap = [(-float(score[y, x]), k, int(y), int(x)) for k, (y, x) in enumerate(zip(*np.nonzero(seeds), strict=True))]
    heapq.heapify(heap)
    k = len(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for v, u in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= v < out.shape[0] and 0 <= u < out.shape[1] and not out[v, u] and score[v, u] > low:
                out[v, u] = out[y, x]
                heapq.heappush(heap, (-float(score[v, u]), k, v, u))
                k += 1
    return out, n
