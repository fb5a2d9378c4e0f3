"""External clustering metrics from the contingency table; pair counts are sums, so nothing grows with n squared."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.operators.labels import contingency


def pair_sums(df: DataFrame, cluster: str = "cluster", label: str = "label", extra: list[str] | None = None) -> DataFrame:
    """One row (for each value of ``extra``) of the sums that all native metrics need."""
    by = extra or []
    c = df.where(F.coalesce(F.col(label), F.lit("▯")) != "▯").where(F.col(cluster).isNotNull()).groupBy(*by, F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    c2 = lambda x: x * (x - 1) / 2
    nln = lambda x: x * F.ln(x)
    n = F.col("n")
    cells = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(c2(n)).alias("s"), F.sum(nln(n)).alias("h_ij"))
    side = lambda key, p: (
        c.groupBy(*by, key).agg(F.sum("n").alias("n"), F.max("n").alias("m")).groupBy(*by)
        .agg(F.sum(c2(n)).alias(f"{p}2"), F.sum(nln(n)).alias(f"h_{p}"), F.sum("m").alias(f"max_{p}"), F.count("*").alias(f"k_{p}"))
    )
    a, b = side("label", "a"), side("cluster", "b")
    if by:
        return cells.join(a, by).join(b, by)
    return cells.crossJoin(a).crossJoin(b)


def scores(df: DataFrame, cluster: str = "cluster", label: str = "label", extra: list[str] | None = None) -> DataFrame:
    """ari, nmi, fmi, homogeneity, completeness, v_measure, purity, inverse_purity, pair_f1 over known labels.

    Conventions: ari is 1 when its denominator vanishes (identical partitions), nmi and v are 1 when both sides have
    one group, fmi and pair_f1 are 0 without shared pairs, homogeneity and completeness are 1 at zero entropy.
    """
    s, a, b, n = F.col("s"), F.col("a2"), F.col("b2"), F.col("n")
    t = n * (n - 1) / 2
    ha, hb = F.ln(n) - F.col("h_a") / n, F.ln(n) - F.col("h_b") / n
    mi = F.greatest(F.col("h_ij") / n - F.col("h_a") / n - F.col("h_b") / n + F.ln(n), F.lit(0.0))
    ari_den = (a + b) / 2 - F.when(t > 0, a * b / t).otherwise(0.0)
    hom = F.when(ha > 1e-12, mi / ha).otherwise(1.0)
    com = F.when(hb > 1e-12, mi / hb).otherwise(1.0)
    return pair_sums(df, cluster, label, extra).where("n > 0").select(
        *(extra or []),
        F.when(F.abs(ari_den) > 1e-12, (s - F.when(t > 0, a * b / t).otherwise(0.0)) / ari_den).otherwise(1.0).alias("ari"),
        F.when(ha + hb > 1e-12, 2 * mi / (ha + hb)).otherwise(1.0).alias("nmi"),
        F.when((s > 0), s / F.sqrt(a * b)).otherwise(0.0).alias("fmi"),
        hom.alias("homogeneity"), com.alias("completeness"),
        F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0).alias("v_measure"),
        (F.col("max_b") / n).alias("purity"), (F.col("max_a") / n).alias("inverse_purity"),
        F.when(a + b > 0, 2 * s / (a + b)).otherwise(0.0).alias("pair_f1"),
    )


def table_of(df: DataFrame, cluster: str = "cluster", label: str = "label") -> tuple[np.ndarray, list, list]:
    """Dense contingency of known labels on the driver: an aggregate of clusters x labels, not of rows."""
    rows = contingency(df, cluster, label, False).collect()
    labels, clusters = sorted({r.label for r in rows}), sorted({r.cluster for r in rows})
    li, ci = {x: i for i, x in enumerate(labels)}, {x: i for i, x in enumerate(clusters)}
    m = np.zeros((len(labels), len(clusters)), np.int64)
    for r in rows:
        m[li[r.label], ci[r.cluster]] = r.n
    return m, labels, clusters


def expected_mi(a: np.ndarray, b: np.ndarray) -> float:
    """Expected mutual information of two partitions with these marginals under random pairing."""
    n = int(a.sum())
    lg = np.array([math.lgamma(k + 1) for k in range(n + 1)])
    total = 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    for x, kx in zip(ua.tolist(), ca.tolist(), strict=True):
        for y, ky in zip(ub.tolist(), cb.tolist(), strict=True):
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            p = lg[x] + lg[y] + lg[n - x] + lg[n - y] - lg[n] - lg[k] - lg[x - k] - lg[y - k] - lg[n - x - y + k]
            total += kx * ky * float((k / n * np.log(n * k / (x * y)) * np.exp(p)).sum())
    return total


def ami(m: np.ndarray) -> float:
    """Adjusted mutual information with the arithmetic mean of entropies; 1 if both sides are trivial."""
    n = m.sum()
    a, b = m.sum(1), m.sum(0)
    if n == 0 or (len(a) == 1 and len(b) == 1) or (len(a) == n and len(b) == n):
        return 1.0
    h = lambda v: -float((v / n * np.log(v / n)).sum())
    i, j = np.nonzero(m)
    mi = float((m[i, j] / n * np.log(n * m[i, j] / (a[i] * b[j]))).sum())
    e = expected_mi(a, b)
    den = (h(a) + h(b)) / 2 - e
    return (mi - e) / (den if abs(den) > 1e-15 else math.copysign(1e-15, den))


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-cost one-to-one assignment of the smaller side (rows, columns), by shortest augmenting paths."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            r = match[j0]
            free = ~used[1:]
            cur = c[r - 1] - u[r] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[1:][free] -= d
            j0 = j1
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    cols = np.flatnonzero(match[1:])
    rows = match[1:][cols] - 1
    order = np.argsort(rows)
    return (cols[order], rows[order]) if flipped else (rows[order], cols[order])


def hungarian_accuracy(m: np.ndarray) -> float:
    if not m.size:
        return 0.0
    i, j = assignment(-m.astype(float))
    return float(m[i, j].sum() / m.sum())


def per_class(m: np.ndarray, labels: list) -> list[tuple]:
    """(label, precision, recall, f1) with each label's cluster taken from the best assignment; 0 without one."""
    i, j = assignment(-m.astype(float)) if m.size else (np.zeros(0, int), np.zeros(0, int))
    to = dict(zip(i.tolist(), j.tolist(), strict=True))
    out = []
    for k, lab in enumerate(labels):
        hit = int(m[k, to[k]]) if k in to else 0
        p = hit / m[:, to[k]].sum() if k in to else 0.0
        r = hit / m[k].sum()
        out.append((lab, float(p), float(r), float(2 * p * r / (p + r)) if p + r else 0.0))
    return out
