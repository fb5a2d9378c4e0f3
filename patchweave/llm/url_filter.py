"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import pick

#: (verdict, host, path): the rules of the production query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BUCKETS = 1 << 14
NGRAM_SIZES = (3, 4, 5)
#: Bound on the labelled rows that the model is fitted to.
TRAIN_ROWS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z lower-cased; '' without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def hashed(host: str, path: str) -> np.ndarray:
    """Sorted distinct buckets of the character n-grams of ^host and path$, host and path hashed apart."""
    out = []
    for salt, s in ((2166136261, "^" + host + "$"), (84696351, "^" + path + "$")):
        codes = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
        for n in NGRAM_SIZES:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, salt * 31 + n, np.uint64)
                for k in range(n):
                    h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h % np.uint64(BUCKETS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def fit(rows: list[tuple[str, str, int]], epochs: int = 30, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression by full-batch gradient steps (Adagrad)."""
    feats = [hashed(h, p) for h, p, _ in rows]
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    y = np.array([r[2] for r in rows], float)
    lens = np.array([max(len(f), 1) for f in feats], float)
    flat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    scale = 1 / np.sqrt(lens)
    seen = np.full(BUCKETS + 1, 1e-8)
    for _ in range(epochs):
        z = np.bincount(owner, w[flat], len(feats)) * scale + w[-1]
        err = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(flat, (err * scale)[owner], BUCKETS + 1) / len(feats) + l2 * w
        g[-1] = err.mean()
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def score(w: np.ndarray, host: str, path: str) -> float:
    f = hashed(host, path)
    return float(1 / (1 + np.exp(-(w[f].sum() / np.sqrt(max(len(f), 1)) + w[-1]))))


def labelled(pages: DataFrame, rules=RULES, rows: int = TRAIN_ROWS) -> list[tuple[str, str, int]]:
    """The small labelled table: the first ``rows`` distinct URLs, by hash, that a rule decides (1: block)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = (
        pick(pages, url="string").select(host.alias("host"), path.alias("path")).where(rule.isNotNull())
        .select("host", "path", (verdict == "block").cast("int").alias("y")).distinct()
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows).collect()
    )
    return [(r.host, r.path, r.y) for r in found]


def judge(pages: DataFrame, train: list[tuple[str, str, int]] | None = None, rules=RULES, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block) for every row.

    The longest fitting rule decides; else the model does. A null URL or one without :// has empty host and path and is
    judged by the model. With no labelled rows every score is 0.5 and the verdict is allow. Repeated rows are judged
    alike; extra columns are ignored; very long URLs are read whole.
    """
    w = fit(labelled(pages, rules) if train is None else train)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=np.array([score(w, h, p) for h, p in zip(b.host, b.path, strict=True)], float))

    urls = pick(pages, page_id="long", url="string").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return urls.mapInPandas(scored, "page_id long, host string, path string, score double").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > cut, "block").otherwise("allow")).alias("verdict"), "score"
    )
