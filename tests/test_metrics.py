"""Metrics and label reports: hand-made literals, properties and brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from patchweave.operators import labels as L
from patchweave.operators import metrics as M

REF = list(zip([0, 0, 1, 1, 1, 0, 2], ["a", "a", "a", "b", "b", "▯", None]))


def frame(spark, rows):
    return spark.createDataFrame([(i, c, x) for i, (c, x) in enumerate(rows)], "id long, cluster long, label string")


def brute_pairs(rows):
    rows = [(c, x) for c, x in rows if x not in (None, "▯")]
    both = one = two = 0
    for (c, x), (d, y) in itertools.combinations(rows, 2):
        both += c == d and x == y
        one += x == y
        two += c == d
    return both, one, two, len(rows) * (len(rows) - 1) / 2


def test_reference_literal(spark):
    r = M.scores(frame(spark, REF)).first()
    s, a, b, t = brute_pairs(REF)
    assert math.isclose(r.ari, (s - a * b / t) / ((a + b) / 2 - a * b / t))
    assert math.isclose(r.fmi, s / math.sqrt(a * b)) and math.isclose(r.pair_f1, 2 * s / (a + b))
    assert math.isclose(r.purity, 4 / 5) and math.isclose(r.inverse_purity, 4 / 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 4), r.choice("abc▯")) for _ in range(60)]
    got = M.scores(frame(spark, rows)).first()
    s, a, b, t = brute_pairs(rows)
    assert math.isclose(got.ari, (s - a * b / t) / ((a + b) / 2 - a * b / t), abs_tol=1e-12)
    assert math.isclose(got.nmi, got.v_measure, abs_tol=1e-9)
    moved = M.scores(frame(spark, [(4 - c, x) for c, x in reversed(rows)])).first()
    assert math.isclose(got.ari, moved.ari, abs_tol=1e-12)


def test_edge_conventions(spark):
    same = M.scores(frame(spark, [(0, "a"), (1, "b"), (1, "b")])).first()
    assert same.ari == same.v_measure == same.purity == 1.0 and math.isclose(same.nmi, 1.0)
    one = M.scores(frame(spark, [(0, "a"), (0, "a")])).first()
    assert (one.ari, one.nmi, one.v_measure) == (1.0, 1.0, 1.0)
    apart = M.scores(frame(spark, [(0, "a"), (1, "b"), (2, "c")])).first()
    assert apart.ari == 1.0 and apart.fmi == 0.0 and apart.pair_f1 == 0.0
    assert M.scores(frame(spark, [(0, "▯"), (1, None)])).count() == 0


def test_assignment_against_permutations():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5)]:
        c = r.random((n, m))
        i, j = M.assignment(c)
        k = min(n, m)
        best = min(sum((c if n <= m else c.T)[a, p[a]] for a in range(k)) for p in itertools.permutations(range(max(n, m)), k))
        assert math.isclose(c[i, j].sum(), best) and len(set(j)) == len(i) == k


def test_ami_against_permutations():
    a, b = [0, 0, 1, 1, 2], [0, 1, 1, 1, 0]
    table = lambda y: np.array([[sum(p == i and q == j for p, q in zip(a, y)) for j in range(2)] for i in range(3)])

    def mi(m):
        n = m.sum()
        return sum(m[i, j] / n * math.log(n * m[i, j] / (m[i].sum() * m[:, j].sum())) for i in range(3) for j in range(2) if m[i, j])

    every = [mi(table(p)) for p in itertools.permutations(b)]
    m = table(b)
    assert math.isclose(M.expected_mi(m.sum(1), m.sum(0)), sum(every) / len(every), rel_tol=1e-9)
    assert M.ami(np.diag([2, 3])) == pytest.approx(1.0)


def test_purity_ties_and_unknowns(spark):
    rows = [(0, "b"), (0, "a"), (0, None), (1, "▯"), (1, None), (2, "x")]
    got = {r.cluster: r for r in L.cluster_purity(frame(spark, rows)).collect()}
    assert (got[0].dominant, got[0].purity, got[0].unknown_count, got[0].norm_entropy) == ("a", 0.5, 1, 1.0)
    assert (got[1].dominant, got[1].purity, got[1].n_labels) == ("▯", None, 0)
    assert got[2].entropy == 0.0 and sum(r["size"] for r in got.values()) == len(rows)
    none = L.dominance(frame(spark, [(0, "▯")])).collect()
    assert len(none) == 7 and all(r.label_share == r.occurrence_share == 0.0 for r in none)


def test_votes(spark):
    v = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "c", 0.0), (3, "d", 0.4)], "item long, label string, weight double")
    got = {r.item: (r.winner, round(r.uncertainty, 6)) for r in L.vote(v).collect()}
    assert got == {1: ("a", 1.0), 2: ("", 1.0), 3: ("d", 0.0)}
