"""Planar registration on small images: transforms, pyramids, inverse-compositional solver, coarse to fine, alignment trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from patchweave.operators.images import convolve1, gaussian_taps, gradients

PARAMETERS = {"translation": 2, "euclidean": 3, "similarity": 4, "affinity": 6, "homography": 8}


def matrix(kind: str, p: np.ndarray) -> np.ndarray:
    """(..., 3, 3) matrices of parameter vectors (..., k); zeros are the identity."""
    p = np.asarray(p)
    m = np.broadcast_to(np.eye(3, dtype=p.dtype), (*p.shape[:-1], 3, 3)).copy()
    if kind == "translation":
        m[..., 0, 2], m[..., 1, 2] = p[..., 0], p[..., 1]
    elif kind == "euclidean":
        c, s = np.cos(p[..., 2]), np.sin(p[..., 2])
        m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1] = c, -s, s, c
        m[..., 0, 2], m[..., 1, 2] = p[..., 0], p[..., 1]
    elif kind == "similarity":
        m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1] = 1 + p[..., 2], -p[..., 3], p[..., 3], 1 + p[..., 2]
        m[..., 0, 2], m[..., 1, 2] = p[..., 0], p[..., 1]
    else:
        m[..., 0, 0], m[..., 0, 1], m[..., 0, 2] = 1 + p[..., 0], p[..., 1], p[..., 2]
        m[..., 1, 0], m[..., 1, 1], m[..., 1, 2] = p[..., 3], 1 + p[..., 4], p[..., 5]
        if kind == "homography":
            m[..., 2, 0], m[..., 2, 1] = p[..., 6], p[..., 7]
    return m


def unit(m: np.ndarray) -> np.ndarray:
    return m / m[..., 2:, 2:]


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First b, then a."""
    return unit(a @ b)


def inverse(m: np.ndarray) -> np.ndarray:
    return unit(np.linalg.inv(m))


def rescale(m: np.ndarray, factor: float) -> np.ndarray:
    """The same motion on an image whose pixels are ``factor`` times as many in each direction."""
    s = np.diag([factor, factor, 1.0]).astype(m.dtype)
    return unit(s @ m @ np.linalg.inv(s))


def points(m: np.ndarray, xy: np.ndarray) -> np.ndarray:
    q = np.concatenate([xy, np.ones_like(xy[..., :1])], -1) @ np.swapaxes(m, -1, -2)
    return q[..., :2] / q[..., 2:]


def grid(h: int, w: int) -> np.ndarray:
    y, x = np.mgrid[:h, :w].astype(float)
    return np.stack([x.ravel(), y.ravel()], -1)


def visible(m: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels whose image under m lies in the frame."""
    p = points(m, grid(h, w))
    return ((p[:, 0] >= 0) & (p[:, 0] <= w - 1) & (p[:, 1] >= 0) & (p[:, 1] <= h - 1)).reshape(h, w)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at -1, 0, 1, 2 for an offset t, cubic convolution with a = -0.5."""
    a = -0.5
    d = np.stack([t + 1, t, 1 - t, 2 - t])
    near = (a + 2) * d**3 - (a + 3) * d**2 + 1
    far = a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
    return np.where(d <= 1, near, far)


def warp(img: np.ndarray, m: np.ndarray) -> np.ndarray:
    """img sampled at m(x), bicubic, edges repeated; channels lead if there are any."""
    h, w = img.shape[-2:]
    p = points(m, grid(h, w))
    x0, y0 = np.floor(p[:, 0]), np.floor(p[:, 1])
    wx, wy = _cubic(p[:, 0] - x0), _cubic(p[:, 1] - y0)
    out = np.zeros((*img.shape[:-2], h * w))
    for j in range(4):
        yy = np.clip(y0 + j - 1, 0, h - 1).astype(int)
        for i in range(4):
            out += img[..., yy, np.clip(x0 + i - 1, 0, w - 1).astype(int)] * (wx[i] * wy[j])
    return out.reshape(img.shape)


def robust(r2: np.ndarray, kind: str, lam: float) -> np.ndarray:
    l2 = lam * lam
    return {"l2": lambda: np.ones_like(r2), "lorentzian": lambda: 1 / (l2 + r2), "geman_mcclure": lambda: l2 / (l2 + r2) ** 2, "charbonnier": lambda: 1 / np.sqrt(l2 + r2)}[kind]()


def steepest(img: np.ndarray, kind: str, grad: str = "farid5") -> np.ndarray:
    """Jacobian of the template's values in the parameters at the identity: (pixels, k)."""
    gx, gy = (g.ravel() for g in gradients(img, grad))
    x, y = grid(*img.shape).T
    cols = {
        "translation": (gx, gy), "euclidean": (gx, gy, -y * gx + x * gy), "similarity": (gx, gy, x * gx + y * gy, -y * gx + x * gy),
        "affinity": (x * gx, y * gx, gx, x * gy, y * gy, gy),
    }
    if kind == "homography":
        e = x * gx + y * gy
        return np.stack([x * gx, y * gx, gx, x * gy, y * gy, gy, -x * e, -y * e], 1)
    return np.stack(cols[kind], 1)


def solve(template: np.ndarray, moving: np.ndarray, kind: str = "homography", start: np.ndarray | None = None, erf: str = "lorentzian", lam0: float = 80.0, decay: float = 0.9, lam_min: float = 5.0, rounds: int = 30, tol: float = 1e-3, grad: str = "farid5", scale: float = 255.0) -> tuple[np.ndarray, float]:
    """Inverse-compositional registration: (matrix m with moving(m(x)) ~ template(x), rms residual).

    The Jacobian and its outer products are made once; each round only weights them anew. The scale of the robust
    function goes from lam0 down to lam_min.
    """
    m = np.eye(3) if start is None else start.copy()
    t = template * scale
    jac = steepest(t, kind, grad)
    outer = jac[:, :, None] * jac[:, None, :]
    h, w = template.shape
    resid = np.zeros(h * w)
    for k in range(rounds):
        seen = visible(m, h, w).ravel()
        resid = np.where(seen, (warp(moving, m) * scale - t).ravel(), 0.0)
        wt = robust(resid * resid, erf, max(lam0 * decay**k, lam_min)) * seen
        hess = np.einsum("p,pij->ij", wt, outer)
        try:
            step = np.linalg.solve(hess + 1e-9 * np.trace(hess) / len(hess) * np.eye(len(hess)), jac.T @ (wt * resid))
        except np.linalg.LinAlgError:
            return np.eye(3), math.inf
        m = compose(m, inverse(matrix(kind, step)))
        if not np.isfinite(m).all():
            return np.eye(3), math.inf
        corners = np.array([[0.0, 0], [w - 1, 0], [0, h - 1], [w - 1, h - 1]])
        if np.abs(points(matrix(kind, step), corners) - corners).max() < tol:
            break
    return m, float(np.sqrt((resid**2).mean()) / scale)


def pyramid(img: np.ndarray, levels: int, sigma: float = 0.8) -> list[np.ndarray]:
    """Gaussian pyramid, finest first; each level is blurred and halved (odd sizes round up)."""
    out = [img]
    for _ in range(levels - 1):
        g = gaussian_taps(sigma)
        b = convolve1(convolve1(out[-1], g, -1), g, -2)
        out.append(b[..., ::2, ::2])
    return out


def multiscale(template: np.ndarray, moving: np.ndarray, kind: str = "homography", levels: int = 3, **options) -> tuple[np.ndarray, float]:
    """Coarse to fine: each level starts from the one below."""
    a, b = pyramid(template, levels), pyramid(moving, levels)
    m, r = np.eye(3), math.inf
    for k in range(levels - 1, -1, -1):
        if k < levels - 1:
            m = rescale(m, 2.0)
        m, r = solve(a[k], b[k], kind, m, **options)
    return m, r


def tree_align(images: list[np.ndarray], kind: str = "similarity", neighbours: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Aligns a cluster along a minimum spanning tree of registration residuals: transforms to the root, median template."""
    n = len(images)
    rough = np.array([[((a - b) ** 2).mean() for b in images] for a in images])
    cost: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    for i in range(n):
        for j in np.argsort(rough[i], kind="stable")[1 : neighbours + 1].tolist():
            a, b = min(i, j), max(i, j)
            if (a, b) not in cost:
                m, r = solve(images[a], images[b], kind)
                cost[a, b] = (r, m)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    tree: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
    for (a, b), (_, m) in sorted(cost.items(), key=lambda x: (x[1][0], x[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree[a].append((b, m))
            tree[b].append((a, inverse(m)))
    centre = int(rough.sum(1).argmin())
    out: list[np.ndarray | None] = [None] * n
    out[centre] = np.eye(3)
    stack = [centre]
    while stack:
        a = stack.pop()
        for b, m in tree[a]:
            if out[b] is None:
                out[b] = compose(m, out[a])
                stack.append(b)
    done = [m if m is not None else np.eye(3) for m in out]
    return done, np.median([warp(i, m) for i, m in zip(images, done, strict=True)], 0)


def congeal(images: list[np.ndarray], kind: str = "similarity", rounds: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Alternates a median template and the registration of every image to it."""
    m = [np.eye(3)] * len(images)
    template = np.median(images, 0)
    for _ in range(rounds):
        found = [solve(template, i, kind, k) for i, k in zip(images, m, strict=True)]
        m = [new if math.isfinite(r) else old for (new, r), old in zip(found, m, strict=True)]
        template = np.median([warp(i, k) for i, k in zip(images, m, strict=True)], 0)
    return m, template


def register_pairs(pairs: DataFrame, kind: str = "translation", levels: int = 1) -> DataFrame:
    """(id, m array<double> of 9, residual) of image pairs (id, a, b as array<array<double>>); failures are identity, inf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arr = lambda v: np.array([np.asarray(r, float) for r in v])
        for t in batches:
            rows = []
            for i, a, b in zip(t.id, t.a, t.b, strict=True):
                m, r = multiscale(arr(a), arr(b), kind, levels)
                rows.append((i, m.ravel().tolist(), r))
            yield pd.DataFrame(rows, columns=["id", "m", "residual"])

    return pairs.select("id", "a", "b").mapInPandas(run, "id long, m array<double>, residual double")


def registered(metric, kind: str = "similarity", skip_above: float = math.inf, levels: int = 1):
    """A metric of two masks after registration of the second to the first.

    Pairs that are further apart than ``skip_above`` as they are need no registration, which is the slow part; a failed
    registration counts as the identity.
    """

    def distance(a: np.ndarray, b: np.ndarray) -> float:
        before = metric(a, b)
        if before > skip_above:
            return before
        m, r = multiscale(a.astype(float), b.astype(float), kind, levels)
        if not math.isfinite(r):
            return before
        return metric(a, warp(b.astype(float), m) > 0.5)

    return distance
