"""Joins, similarity, graph, images, refinement, layout, registration, outlines and streams on small inputs."""

import itertools
import math
import random
import tracemalloc
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchweave.functions import scalar
from patchweave.operators import graph as G
from patchweave.operators import images as I
from patchweave.operators import joins as J
from patchweave.operators import layout as Y
from patchweave.operators import refine as R
from patchweave.operators import registration as REG
from patchweave.operators import similarity as S
from patchweave.sources import models, svg, tables
from patchweave.streaming import pages


# -- joins -----------------------------------------------------------------------------------------------------------
def test_nearest_and_interval(spark):
    r = random.Random(1)
    pts = [(i, r.uniform(-300, 300)) for i in range(200)]
    cs = [(k, round(r.uniform(-900, 900), 1)) for k in range(25)] + [(99, 10.0), (98, 10.0)]
    got = {x.id: x.key for x in J.nearest_1d(spark.createDataFrame(pts, "id long, x double"), spark.createDataFrame(cs, "key long, y double")).collect()}
    assert got == {i: min(cs, key=lambda c: (abs(c[1] - x), c[0]))[0] for i, x in pts}
    spans = [(k, float(10 * k), 10.0 * k + r.choice([5, 25])) for k in range(1, 20)]
    got = {x.id: x.col for x in J.interval_join(spark.createDataFrame(pts, "id long, x double"), spark.createDataFrame(spans, "col long, lo double, hi double"), 7.0).collect()}
    assert got == {i: next((c for c, lo, hi in spans if lo <= x < hi), 0) for i, x in pts}


def test_fast_cemd_against_all_cuts():
    r = np.random.default_rng(12)
    for bins in (4, 6, 8, 16):
        for q, k in [(r.normal(size=(9, 3, bins)), r.normal(size=(700, 3, bins))), (r.integers(-2, 3, (9, 3, bins)) * 1.0, r.integers(-2, 3, (11, 3, bins)) * 1.0)]:
            x = np.cumsum(q, 2)[:, None] - np.cumsum(k, 2)[None]
            for last in (False, True):
                cuts = [0 * x[..., :1], *(x[..., s : s + 1] for s in range(1, bins - (not last)))]
                want = np.min([np.abs(x - c).mean(-1) for c in cuts], 0)
                assert np.allclose(S.cemd_cells(q, k, last), want, rtol=0, atol=1e-12)


def test_each_block_pair_is_worked_on_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    plain = S.cemd_cells

    def counted(q, k):
        calls.add(len(q) * len(k))
        return plain(q, k)

    monkeypatch.setitem(S.KERNELS, "counted", counted)
    r = np.random.default_rng(2)
    x = np.abs(r.normal(size=(90, 1, 4)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, hist array<array<double>>")
    d = plain(x, x).sum(2)
    for block in (13, 18, 200):
        before = calls.value
        m = {q.id: (q.mu, q.var, q.n) for q in S.pair_moments(df, "counted", block).collect()}
        assert calls.value - before < (1 if block > 90 else 0.8) * 90 * 90 + 1
        assert np.allclose([m[i][:2] for i in range(90)], np.stack([d.mean(1), d.var(1, ddof=1)], 1)) and all(v[2] == 90 for v in m.values())
        moments = spark.createDataFrame([(i, *map(float, v[:2])) for i, v in m.items()], "id long, mu double, var double")
        z = (d - d.mean(1)[:, None]) / (d.std(1, ddof=1)[:, None] + 1e-15)
        assert {(q.i, q.j) for q in S.matches(df, moments, -1.0, "cemd", block).collect()} == {(i, j) for i in range(90) for j in range(90) if i != j and z[i, j] <= -1.0}
        assert {(q.i, q.j) for q in S.close_pairs(df, 0.5, "cemd", block).collect()} == {(i, j) for i in range(90) for j in range(i + 1, 90) if d[i, j] <= 0.5}


def test_path_centralities_in_parts(spark, monkeypatch):
    r = random.Random(3)
    e = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(110)} | {(100, 101), (101, 102)})
    ids, starts, nb = G.flat_adjacency(*np.array(e).T)
    _, lists = G.adjacency(*np.array(e).T)
    assert [nb[starts[i] : starts[i + 1]].tolist() for i in range(len(ids))] == lists
    monkeypatch.setattr(G, "VISITS", 200)
    monkeypatch.setattr(G, "BITS", 7)
    monkeypatch.setattr(G, "ROWS", 5)
    v = spark.createDataFrame([(i,) for i in [*range(60), 100, 101, 102, 999]], "id long")
    got = {x.id: x for x in G.path_centralities(v, spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double")).collect()}
    comp = {**{int(i): 1 for i in ids if i < 100}, 100: 2, 101: 2, 102: 2}
    n, between, far = len(got), G.betweenness(lists), G.distance_sums(lists)
    for k, i in enumerate(ids.tolist()):
        size = sum(c == comp[i] for c in comp.values())
        assert math.isclose(got[i].betweenness, between[k] / ((n - 1) * (n - 2) / 2), abs_tol=1e-12)
        assert math.isclose(got[i].closeness, (size - 1) / far[k] * (size - 1) / (n - 1))
    assert got[999].betweenness == got[999].closeness == 0
    one = {x.id: x.closeness for x in G.path_centralities(v, spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double"), ("closeness",)).collect()}
    assert one == {i: x.closeness for i, x in got.items()}


def _narrow_graphs():
    r = random.Random(1)
    band = sorted({(i - 1, i) for i in range(1, 600)} | {(max(0, i - r.randrange(2, 9)), i) for i in range(2, 600)})
    yield band
    yield [(max(0, i - r.randrange(1, 4)), i) for i in range(1, 400)] + [(5, 200)]
    yield [(i, (i + 1) % 200) for i in range(200)]
    yield [(i, i + 2) for i in range(300)] + [(2 * i, 2 * i + 1) for i in range(150)]
    yield [(r.randrange(i), i) for i in range(1, 300)]


@pytest.mark.parametrize("depth", [2, 6, 96])
def test_searches_that_go_on_as_those_from_the_ends(monkeypatch, depth):
    monkeypatch.setattr(G, "DEPTH", depth)
    for e in _narrow_graphs():
        ids, starts, nb = G.flat_adjacency(*np.array(e).T)
        _, lists = G.adjacency(*np.array(e).T)
        parts = np.array_split(G.end_order(starts, nb), 3)
        assert np.allclose(sum(G.path_shares(starts, nb, p) for p in parts) / 2, G.betweenness(lists), rtol=1e-10)


def test_shares_of_a_long_band_hold_no_row_of_it(monkeypatch):
    r = random.Random(4)
    e = np.array(sorted({(i - 1, i) for i in range(1, 40_000)} | {(max(0, i - r.randrange(2, 9)), i) for i in range(2, 40_000)}))
    ids, starts, nb = G.flat_adjacency(*e.T)
    tracemalloc.start()
    G.path_shares(starts, nb, np.arange(20_000, 20_064))
    assert tracemalloc.get_traced_memory()[1] < 40e6  # 64 rows of 40,000 vertices are 72 MB and more
    tracemalloc.stop()


def test_distance_sums_of_a_narrow_graph_visit_what_is_near(monkeypatch):
    def whole(*_):
        raise AssertionError("goes through the whole graph")

    r = random.Random(2)
    e = sorted({(i - 1, i) for i in range(1, 2000)} | {(max(0, i - r.randrange(2, 6)), i) for i in range(2, 2000)})
    ids, starts, nb = G.flat_adjacency(*np.array(e).T)
    _, lists = G.adjacency(*np.array(e).T)
    monkeypatch.setattr(G, "distances_to", whole)
    parts = np.array_split(G.end_order(starts, nb), 3)
    assert (sum(G.distance_totals(starts, nb, p) for p in parts) == G.distance_sums(lists)).all()


@pytest.mark.parametrize("depth", [2, 6, 96])
def test_distance_sums_of_odd_graphs(monkeypatch, depth):
    monkeypatch.setattr(G, "DEPTH", depth)
    for e in _narrow_graphs():
        ids, starts, nb = G.flat_adjacency(*np.array(e).T)
        _, lists = G.adjacency(*np.array(e).T)
        parts = np.array_split(G.end_order(starts, nb), 3)
        assert (sum(G.distance_totals(starts, nb, p) for p in parts) == G.distance_sums(lists)).all()


def test_paths_beyond_the_range_of_doubles():
    e = np.array([x for i in range(1100) for x in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))])
    ids, starts, nb = G.flat_adjacency(*e.T)
    share = G.path_shares(starts, nb, np.array([0]))
    behind = len(ids) - 1 - np.arange(len(ids))
    assert np.allclose(share[3::3], behind[3::3]) and np.allclose(share[1::3], (behind[3::3] + 1) / 2)


def test_nearest_has_no_frame_to_the_end(spark):
    pts = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 700.0)], "id long, x double")
    near = J.nearest_1d(pts, spark.createDataFrame([(7, 4.0), (5, 6.0), (6, 6.0)], "key long, y double"))
    assert {(r.id, r.key, r.dist) for r in near.collect()} == {(1, 5, 1.0), (2, 5, 1.0), (3, 5, 694.0)}
    frames = [x for x in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "specifiedwindowframe(RangeFrame" in x]
    assert frames and not any("RangeFrame, currentrow$(), unboundedfollowing$()" in x or "RangeFrame, 0, unboundedfollowing" in x for x in frames)


def test_candidates_verified_in_one_join(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(3), float(r.randrange(40)), r.randrange(9)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g int, x double, delta int")
    got = J.verified_within(df, ["g"])
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0] and abs(a[2] - b[2]) <= a[3])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_candidates_of_equal_places_are_checked_as_lists(spark, monkeypatch):
    monkeypatch.setattr(J, "LISTED", 7)
    r = random.Random(8)
    places = [(g, r.choice([0.1, 0.2, 0.3, 5.5, None]), r.choice([0, 1, 5, None])) for g in ("a", "b", None) for _ in range(6)]
    rows = [(i, *places[i % 18]) for i in range(360)] + [(0, *places[0]), (500, "a", float("nan"), 1), (501, "a", -0.0, 0), (502, "a", 0.0, 0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, delta int")
    plain = df.alias("a").join(df.alias("b"), F.expr("a.g = b.g and a.id <> b.id and abs(a.x - b.x) <= a.delta")).selectExpr("a.id as q", "b.id as k")
    got = J.verified_within(df, ["g"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    rows_of_join = spark.createDataFrame([(i, 1, 2.0, 3) for i in range(300)], "id long, g int, x double, delta int")
    plan = J.verified_within(rows_of_join, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # ids are spread above the join


def test_jaccard_blocks_against_matrix(spark):
    r = np.random.default_rng(8)
    w = r.integers(-(2**62), 2**62, (60, 2)) & r.integers(-(2**62), 2**62, (60, 2))
    w[3] = 0
    df = spark.createDataFrame([(i, i % 2, int(a), int(b)) for i, (a, b) in enumerate(w)], "id long, g int, a long, b long")
    bits = ((w[:, :, None] >> np.arange(64)) & 1).reshape(60, 128) > 0
    m = I.distance_matrix(list(bits), "jaccard", diagonal=1.0)
    for block in (7, 1000):
        got = [tuple(q) for q in S.jaccard_within(df, "g", ("a", "b"), block).collect()]
        assert {(g, i, j) for g, i, j, _ in got} == {(i % 2, i, j) for i in range(60) for j in range(i, 60, 2)} and len(got) == 2 * 30 * 31 // 2
        assert all(math.isclose(x, m[i, j], abs_tol=1e-12) for _, i, j, x in got)


def test_linkage_order_and_time():
    def plain(d):
        d, n = d.copy(), len(d)
        np.fill_diagonal(d, np.inf)
        name, size, out = list(range(n)), [1.0] * n, []
        for k in range(n - 1):
            i, j = divmod(int(d.argmin()), n)
            out.append((*sorted((name[i], name[j])), d[i, j], size[i] + size[j]))
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = row, row
            d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
            name[i], size[i] = n + k, size[i] + size[j]
        return np.array(out)

    r = np.random.default_rng(15)
    for p in (r.random((60, 3)), r.integers(0, 3, (60, 2)) * 1.0):
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        want = plain(d)
        assert np.allclose(R.average_linkage(d), want)
        low = want[want[:, 2] <= 0.5]
        assert np.allclose(R.average_linkage(d, 0.5), low)
    p = r.random((1500, 2))
    began = time.process_time()
    R.average_linkage(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)))
    assert time.process_time() - began < 4


def test_kmedoids_without_pairs(spark, monkeypatch):
    r = np.random.default_rng(21)
    x = r.normal(size=(80, 2, 2)) * 0.5
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "id long, cluster long, hist array<array<double>>")
    half = S.close_pairs(df, 0.8, "l2")
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    want = {q.id: q.cluster for q in R.kmedoids(df.select("id", "cluster"), both).collect()}
    monkeypatch.setattr(S, "TILE", 9)
    assert {q.id: q.cluster for q in R.kmedoids_within(df, 0.8).collect()} == want and len(set(want.values())) > 1
    t = {q.id: (q.t, q.k) for q in S.neighbour_sums(df, 0.8, block=6).collect()}
    d = S.l2_cells(x, x).sum(2)
    near = (d <= 0.8) & (np.arange(80)[:, None] != np.arange(80)) & (np.arange(80)[:, None] % 4 == np.arange(80) % 4)
    assert all(math.isclose(t[i][0], d[i][near[i]].sum(), abs_tol=1e-9) and t[i][1] == near[i].sum() for i in range(80))


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    tables.save(df, str(tmp_path / "t"))
    assert tables.load_columns(spark, str(tmp_path / "t"), ["name", "gone"]).columns == ["name"]
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "p12.txt").write_text("一二")
    (tmp_path / "txt" / "cover.txt").write_text("x")
    assert [tuple(r) for r in tables.transcripts(spark, str(tmp_path / "txt")).collect()] == [(12, "一二")]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "page_7.png").write_bytes(b"abc")
    assert [(r.page, bytes(r.content)) for r in tables.page_images(spark, str(tmp_path / "img")).collect()] == [(7, b"abc")]
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "id long, name string").count() == 2
    tables.write_graph(df.select("id"), df.select("id"), str(tmp_path / "g"))
    assert tables.read_graph(spark, str(tmp_path / "g"))[0].count() == 2
    assert "1 & a" in tables.latex_table(df.where("id = 1")) and "| 1 | a |" in tables.markdown_table(df)


def test_text_parsing(spark):
    t = spark.createDataFrame([("Row 1: 一二\nRow 2: 三",), ("see [一] [▯]",), ("x四y",), ("none",), (None,)], "t string")
    assert [r[0] for r in t.select(scalar.parse_rows(F.col("t"), 4)).collect()] == ["一二三▯", "一▯▯▯", "四▯▯▯", "▯▯▯▯", "▯▯▯▯"]
    assert [r[0] for r in t.select(scalar.parse_single(F.col("t"))).collect()] == ["一", "▯", "四", "▯", "▯"]


# -- similarity ------------------------------------------------------------------------------------------------------
def test_blocks_agree_with_direct(spark):
    r = np.random.default_rng(3)
    x = r.random((23, 2, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, hist array<array<double>>")
    for kernel in ("l2", "cemd"):
        d = np.array([[[cell(kernel, q, k) for q, k in zip(a, b)] for b in x] for a in x])
        mu, var = d.mean(1).sum(1), d.var(1, ddof=1).sum(1)
        for block in (7, 1000):
            m = S.pair_moments(df, kernel, block)
            got = {t.id: (t.mu, t.var) for t in m.collect()}
            assert all(np.allclose(got[i], (mu[i], var[i])) for i in range(len(x)))
            z = (d.sum(2) - mu[:, None]) / np.sqrt(var)[:, None]
            want = {(i, j) for i, j in zip(*np.nonzero(z <= -1.0)) if i != j}
            assert {(t.i, t.j) for t in S.matches(df, m, -1.0, kernel, block).collect()} == want


def cell(kernel, q, k):
    if kernel == "l2":
        return ((q - k) ** 2).sum()
    x = np.cumsum(q) - np.cumsum(k)
    return min(np.abs(x - c).mean() for c in [0.0, *x[1:-1]])


def test_directed_pairs_to_edges(spark):
    d = spark.createDataFrame([(1, 2, 5.0), (2, 1, 7.0), (3, 4, 1.0), (6, 5, 2.0), (8, 8, 9.0)], "i long, j long, nlfa double")
    either = {(r.src, r.dst): r.weight for r in G.edges_of(d, reciprocal=False).collect()}
    assert either == {(1, 2): 7.0, (3, 4): 1.0, (5, 6): 2.0}
    assert [(r.src, r.dst, r.weight) for r in G.edges_of(d, reciprocal=True).collect()] == [(1, 2, 6.0)]
    assert {r.weight for r in G.edges_of(d, False, "one").collect()} == {1.0}


def test_significance():
    assert math.isclose(-S.log_ndtr(np.array([0.0]))[0], math.log(2))
    assert abs(-S.log_ndtr(np.array([-40.0]))[0] - 804.6) < 0.1
    near, far = S.log_ndtr(np.array([-19.999, -20.001]))
    assert 0 < near - far < 0.1
    tau = S.threshold(1e-3, 100, 100)
    assert math.isclose(-S.log_ndtr(np.array([S.z_cut(tau)]))[0], tau, rel_tol=1e-6)
    assert S.threshold(1e4, 100, 100) == pytest.approx(0)


# -- graph -----------------------------------------------------------------------------------------------------------
def two_triangles(spark):
    e = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]
    return spark.createDataFrame([(i,) for i in range(8)], "id long"), spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in e] + [(6, 6, 1.0)], "src long, dst long, weight double").where("src <> dst")


def test_graph_on_two_triangles(spark):
    v, e = two_triangles(spark)
    assert {r.id: r.component for r in G.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 7}
    c = {r.id: (r.betweenness, r.closeness) for r in G.path_centralities(v, e).collect()}
    assert c[2][0] == pytest.approx(6 / 21) and c[0] == (0.0, pytest.approx(5 / 10 * 5 / 7)) and c[7] == (0.0, 0.0)
    com = {r.id: r.cluster for r in G.communities(v, e, 0.5).collect()}
    assert com == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert {r.id: r.cluster for r in G.communities(v, e, 1.0, "modularity").collect()} == com
    x = {r.id: r.eigenvector for r in G.eigenvector(v, e).collect()}
    a = np.zeros((8, 8))
    for r in e.collect():
        a[r.src, r.dst] = a[r.dst, r.src] = 1
    w = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert np.allclose([x[i] for i in range(8)], w, atol=1e-3)
    side = {r.id: r.side for r in G.fiedler(e.withColumn("c", F.lit(1).cast("long")), "c").collect()}
    assert side[0] == side[1] == side[2] != side[3] == side[4] == side[5]


@pytest.mark.parametrize("seed,finish", [(1, 10**6), (2, 10**6), (3, 5)])
def test_tree_and_components_against_plain(spark, monkeypatch, seed, finish):
    monkeypatch.setattr(G, "FINISH_EDGES", finish)
    r = random.Random(seed)
    n = 40
    e = {(min(a, b), max(a, b)): float(r.randint(1, 5)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(45)) if a != b}
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    df = spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "src long, dst long, weight double")
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for w, a, b in sorted((w, a, b) for (a, b), w in e.items()):
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            total += w
    tree = G.spanning_tree(df, v).collect()
    assert sum(t.weight for t in tree) == total and len(tree) == n - len({find(i) for i in range(n)})
    assert {t.id: t.component for t in G.components(v, df).collect()} == {i: find(i) for i in range(n)}


def test_partition_is_locally_best():
    r = random.Random(5)
    n = 30
    nb = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if r.random() < (0.6 if i // 10 == j // 10 else 0.05):
                nb[i].add(j)
                nb[j].add(i)
    nb = [sorted(x) for x in nb]
    com = G.partition(nb, 0.3)

    def quality(c):
        inside = sum(c[i] == c[j] for i in range(n) for j in nb[i]) / 2
        return inside - 0.3 * sum(k * (k - 1) / 2 for k in np.bincount(c))

    assert quality(com) >= max(quality(np.arange(n)), quality(np.zeros(n, int)))


# -- images ----------------------------------------------------------------------------------------------------------
def test_masks():
    a = np.zeros((6, 6), bool)
    a[1:3, 1:3] = True
    b = np.roll(a, 1, 1)
    assert I.hausdorff(a, a) == 0 and I.hausdorff(a, b) == 1 and I.hausdorff(a, np.zeros_like(a)) == math.inf
    assert I.dice(a, b) == pytest.approx(0.5) and I.jaccard(a, b) == pytest.approx(2 / 6) and I.hamming(a, b) == pytest.approx(4 / 36)
    m = I.distance_matrix([a, b, a], lambda x, y: 1 / 0)
    assert m[0, 1] == 999.0 and m[0, 0] == 0
    lab, n = I.label_components(np.eye(4, dtype=bool))
    assert n == 1 and I.label_components(np.eye(4, dtype=bool), diagonal=False)[1] == 4
    r = np.random.default_rng(1)
    for _ in range(5):
        mask = r.random((9, 11)) > 0.5
        lab, n = I.label_components(mask, diagonal=False)
        assert (lab > 0).sum() == mask.sum() and set(np.unique(lab)) <= set(range(n + 1))
        same = (lab[:, 1:] == lab[:, :-1]) | ~(mask[:, 1:] & mask[:, :-1])
        assert same.all()
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert I.ink_filter(ring, 1, 2).all() and not I.ink_filter(ring, 99, 2).any()


def test_hog_and_gradients():
    x = np.tile(np.arange(16.0), (16, 1))
    for kind in ("central", "hypomode", "farid3", "farid5", "gaussian"):
        gx, gy = I.gradients(x, kind)
        assert np.allclose(gx[5:-5, 5:-5], 0.850574 if kind == "farid3" else 1, atol=0.05) and np.allclose(gy, 0, atol=1e-9)
    h = I.hog(x, 8, 4)
    assert h.shape == (4, 4) and np.isclose((h**2).sum(), 1) and (h.argmax(1) == 0).all()
    assert np.isnan(I.hog(np.ones((8, 8)), 4, 4)).all() and I.normalise(np.ones((2, 2)), "cell").shape == (2, 2)


def test_thresholds():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(50, 5, 500), r.normal(200, 5, 500)])
    for m in ("otsu", "mean", "isodata", "li", "minimum", "yen"):
        assert 55 < I.threshold_of(x, m) < 196, m
    assert 50 < I.threshold_of(np.concatenate([x, r.normal(50, 5, 3000)]), "triangle") < 200


# -- refinement ------------------------------------------------------------------------------------------------------
def test_linkage_against_plain():
    r = np.random.default_rng(4)
    p = r.random((12, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    merges = R.average_linkage(d)
    groups = {i: [i] for i in range(12)}
    for k, (a, b, h, n) in enumerate(merges):
        x, y = groups.pop(int(a)), groups.pop(int(b))
        assert math.isclose(h, d[np.ix_(x, y)].mean()) and n == len(x) + len(y)
        assert h <= min(d[np.ix_(u, v)].mean() for u, v in itertools.combinations([x, y, *groups.values()], 2)) + 1e-9
        groups[12 + k] = x + y
    assert R.cut_tree(merges, 12, -1).tolist() == list(range(12)) and set(R.cut_tree(merges, 12, 9)) == {0}
    d[0, 1] = d[1, 0] = math.inf
    assert np.isfinite(R.average_linkage(d)).all()


def test_label_split_and_rematch(spark):
    rows = [(1, 0, "a"), (2, 0, "a"), (3, 0, "b"), (4, 0, "▯"), (5, 1, "▯"), (6, 1, None), (7, 2, "x"), (8, 2, "▯"), (9, 3, "a")]
    df = spark.createDataFrame(rows, "id long, cluster long, label string")
    got = {r.id: r.cluster for r in R.label_split(df, 2).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    assert {r.id: r.cluster for r in R.ocr_rematch(df, 1).collect()}[9] == 0
    with pytest.raises(Exception, match="labels 0..k-1"):
        R.split_each(df, lambda p: np.full(len(p), 7)).collect()
    out, log = R.chain(df, [("label_split", R.STEPS["label_split"](2))])
    assert out.count() == len(rows) and [r.step for r in log.collect()] == ["start", "label_split"]


def test_hapax_kmedoids_mrf(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.9), (2, 2, "a", 0.5), (3, 2, "a", 0.5), (4, 4, "a", 0.1), (5, 5, "z", 0.9)], "id long, cluster long, label string, conf double")
    p = [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 2.0), (4, 2, 0.1), (5, 2, 0.1)]
    pairs = spark.createDataFrame(p + [(j, i, d) for i, j, d in p], "i long, j long, d double")
    r = R.hapax_association(df, pairs, 0.5)
    assert {x.id: x.cluster for x in r.membership.collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}
    assert {x.id: x.reason for x in r.log.collect()} == {1: "accepted", 4: "low_confidence", 5: "no_cluster"}
    pos = [0.0, 1.0, 2.0, 10.0, 11.0, 12.0]
    d = [(i, j, abs(a - b)) for i, a in enumerate(pos) for j, b in enumerate(pos) if i != j]
    m = spark.createDataFrame([(i, k) for i, k in enumerate([0, 0, 1, 1, 1, 1])], "id long, cluster long")
    got = {x.id: x.cluster for x in R.kmedoids(m, spark.createDataFrame(d, "i long, j long, d double")).collect()}
    assert got[0] == got[1] == got[2] != got[3] == got[4] == got[5]
    unary = spark.createDataFrame([(i, lab, s) for i, (a, b) in enumerate([(2.0, 0.0), (0.0, 0.1), (2.0, 0.0)]) for lab, s in (("a", a), ("b", b))], "id long, label string, score double")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    b = {(x.id, x.label): x.belief for x in R.belief_propagation(unary, e).collect()}
    assert b[1, "a"] > b[1, "b"]


# -- layout and sequences --------------------------------------------------------------------------------------------
def test_edit_script_cost_and_shape():
    r = random.Random(8)
    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        ops = Y.edit_script(a, b)
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert sum(o != "equal" for o, _, _ in ops) == d[-1, -1]
        assert [i for _, i, _ in ops if i is not None] == list(range(len(a))) and [j for *_, j in ops if j is not None] == list(range(len(b)))


def test_align(spark):
    p = spark.createDataFrame([(1, 1, 0, "一"), (2, 1, 1, "▯"), (3, 1, 2, "三"), (4, 2, 0, "四")], "id long, page long, reading_order long, char string")
    t = spark.createDataFrame([(1, "一二三"), (3, "x")], "page long, text string")
    assert {r.id: r.aligned for r in Y.align(p, t).collect()} == {1: "一", 2: "二", 3: "三", 4: "▯"}


def test_reading_order_and_rectangles(spark):
    cells = [(1, 0, 0, 0, 10), (1, 1, 0, 0, 20), (1, 1, 1, 0, 21), (1, 1, 1, 1, 22), (1, 1, 2, 0, 23), (1, 1, 2, 1, 24), (1, 1, 3, 0, 25)]
    df = spark.createDataFrame(cells, "page long, col_idx int, row_idx int, lane_idx int, label long")
    got = [r.label for r in Y.reading_order(df).orderBy("reading_order").collect()]
    assert got == [20, 22, 24, 21, 23, 25, 10]
    boxes = spark.createDataFrame([(1, 5, 0, 0, 10, 10), (1, 6, 0, 30, 10, 10), (1, 5, 50, 0, 10, 10), (1, 7, 50, 40, 10, 10)], "page long, label long, left_ int, top int, width int, height int")
    assert sorted((r.col_idx, r.row_idx, r.label) for r in Y.rectangles(boxes).collect()) == [(0, 0, 5), (0, 1, 6), (1, 1, 7)]


# -- registration and outlines ---------------------------------------------------------------------------------------
def test_transforms():
    r = np.random.default_rng(0)
    for kind, k in REG.PARAMETERS.items():
        m = REG.matrix(kind, r.normal(size=(4, k)) * 0.01)
        assert np.abs(REG.compose(m, REG.inverse(m)) - np.eye(3)).max() < 1e-5 and m.shape == (4, 3, 3)
        assert REG.matrix(kind, np.zeros(k, np.float32)).dtype == np.float32
    m = REG.matrix("affinity", np.array([0.1, 0, 3, 0, 0.1, 2]))
    assert np.allclose(REG.rescale(REG.rescale(m, 2), 0.5), m)


def smooth_noise(shape, seed):
    x = np.random.default_rng(seed).normal(size=shape)
    for _ in range(2):
        x = I.convolve1(I.convolve1(x, I.gaussian_taps(2), -1), I.gaussian_taps(2), -2)
    return (x - x.min()) / np.ptp(x)


@pytest.mark.parametrize("kind,p", [("translation", [1.5, -2.0]), ("similarity", [1.0, 0.5, 0.02, 0.03]), ("homography", [0.01, 0.01, 1.0, -0.01, 0.01, 0.5, 1e-5, -1e-5])])
def test_recovers_motion(kind, p):
    img = smooth_noise((64, 64), 3)
    m = REG.matrix(kind, np.array(p))
    moved = REG.warp(img, REG.inverse(m))
    got, resid = REG.multiscale(img, moved, kind, 2)
    inner = REG.grid(64, 64).reshape(64, 64, 2)[10:-10, 10:-10].reshape(-1, 2)
    assert np.abs(REG.points(got, inner) - REG.points(m, inner)).max() < 0.2 and resid < 0.05


def test_pyramid_and_cluster_alignment():
    assert [x.shape for x in REG.pyramid(np.zeros((2, 3, 65, 64)), 3)] == [(2, 3, 65, 64), (2, 3, 33, 32), (2, 3, 17, 16)]
    base = smooth_noise((32, 32), 5)
    imgs = [REG.warp(base, REG.matrix("translation", np.array(t))) for t in ([0.0, 0.0], [1.0, 0.0], [0.0, -1.0])]
    spread = lambda xs: np.std(xs, 0)[6:-6, 6:-6].mean()
    for m, _ in (REG.tree_align(imgs, "translation"), REG.congeal(imgs, "translation")):
        assert spread([REG.warp(i, k) for i, k in zip(imgs, m)]) < 0.3 * spread(imgs)


def test_outlines():
    c = svg.parse_path("m1 1 h2 v2 l-2 0 z M0 0C1 0 2 1 2 2")
    assert [x[0] for x in c] == [True, False] and c[0][1].shape == (4, 4, 2)
    assert [np.allclose(a[1], b[1], atol=1e-3) for a, b in zip(c, svg.parse_path(svg.format_path(c)))] == [True, True]
    assert np.allclose(svg.evaluate(c[1][1], [0, 1])[0], [[0, 0], [2, 2]])
    turned = svg.transform(svg.transform(c, svg.rotation(0.3)), svg.rotation(-0.3))
    assert np.allclose(turned[0][1], c[0][1])
    assert svg.paths_of(svg.document(["M0 0L1 1"], 5, 5)) == ["M0 0L1 1"]


# -- adapters and streams --------------------------------------------------------------------------------------------
def test_adapters(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, None)], "id long, bin_patch binary")
    readers = models.available_readers([models.StubReader(), models.FailingReader()])
    got = {r.id: r.char for r in models.read_patches(df, readers["stub"]).collect()}
    assert set(readers) == {"stub"} and got[1] == got[2]
    out = {r.id: (r.svg, r.error) for r in models.vectorise(df, lambda b: f"<svg>{len(b)}</svg>").collect()}
    assert out[1] == ("<svg>3</svg>", None) and out[3][0] is None and out[3][1]
    score = np.zeros((6, 8))
    score[1:3, 1:4] = 0.9
    assert models.boxes_of_scores(score, np.zeros_like(score), 0.7, 0.4, 0.4) == [(1, 1, 3, 2)]


def test_page_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, i) for i in range(4)], "page int, x int").coalesce(1).write.mode("append").parquet(src)
    q = pages.ingest(pages.page_stream(spark, src, "page int, x int"), lambda df: df.groupBy("page").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.page, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 4), (1, 4), (2, 4)]


def test_sweep_finds_the_planted_partition(spark):
    from patchweave.plans.sweep import Sweep, best

    r = np.random.default_rng(6)
    centres = np.eye(4)[[0, 1, 2]]
    x = [(i, str(i % 3), np.abs(centres[i % 3] + r.normal(size=4) * 0.03).tolist()) for i in range(45)]
    items = spark.createDataFrame(x, "id long, label string, v array<double>")
    shape = lambda df: df.select("id", F.array("v").alias("hist"))
    grid = Sweep({"plain": shape}, epsilons=[300.0, 600.0], gammas=[0.3], kernel="l2").run(items)
    top = best(grid).first()
    assert grid.count() == 2 and top.ari == 1.0 and top.n_clusters == 3


def test_pca_rematch_and_linkage_step(spark):
    r = np.random.default_rng(9)
    rows = [(i, i % 2, (np.array([4.0 * (i % 2), 0, 0]) + r.normal(size=3)).tolist()) for i in range(40)] + [(100, 100, [4.1, 0.1, 0.0]), (101, 101, [90.0, 90.0, 90.0])]
    df = spark.createDataFrame(rows, "id long, cluster long, vec array<double>")
    got = {x.id: x.cluster for x in R.pca_rematch(df, small=1, k=3).collect()}
    assert got[100] == 1 and got[101] == 101 and got[0] == 0
    pts = [(i, 7, "ab"[i // 4], float(10 * (i // 4) + i % 4)) for i in range(8)]
    t = spark.createDataFrame(pts, "id long, cluster long, label string, x double")
    res = R.linkage_split(t, lambda p: np.abs(p.x.to_numpy()[:, None] - p.x.to_numpy()[None]), 2, [0.5, 4.0, 50.0])
    assert res.info["height"] == 4.0 and res.info["ari"] == 1.0
    assert {x.id: x.cluster for x in res.membership.collect()} == {i: 4 * (i // 4) for i in range(8)}
    assert [(x.n_sub, x["size"]) for x in res.log.collect()] == [(2, 8)]


def test_component_archives(spark, tmp_path):
    from patchweave.sources import components as C

    raster = np.zeros((6, 8), np.int32)
    raster[1:3, 2:6], raster[4, 0], raster[5, 7] = 1, 2, 3
    (tmp_path / "page_4.npz").write_bytes(C.archive(raster, {2: "area_too_small"}, {3: 1}))
    old = {"_nLabels": 2, "_labels": raster, "_deleted_labels": np.array([3]), "_delete_reason": np.array(["too_large"])}
    np.savez_compressed(tmp_path / "page_5.npz", **old)
    got = {(r.page, r.label): r for r in C.read_components(spark, str(tmp_path)).collect()}
    a = got[4, 1]
    assert (a.left_, a.top, a.width, a.height, a.area, a.cy, a.cx, a.deleted) == (2, 1, 4, 2, 8, 1.5, 3.5, False)
    assert got[4, 2].reason == "area_too_small" and got[4, 3].merged_into == 1 and got[5, 3].reason == "too_large" and not got[5, 1].deleted
    with pytest.raises(ValueError, match="background"):
        C.archive(raster, {0: "x"})


def test_crop_place_barycentre_watershed():
    x = np.arange(12.0).reshape(3, 4)
    assert I.crop(x, -1, 1, 3, 3).tolist() == [[0, 4, 5], [0, 8, 9], [0, 0, 0]]
    assert I.crop(x, 0, 0, 2, 1, mask=np.eye(3, 4, dtype=bool)).tolist() == [[0, 0]] and I.crop(x, 9, 9, 2, 2).sum() == 0
    assert I.place(np.zeros((2, 2)), np.ones((2, 2)), 1, -1).tolist() == [[0, 1], [0, 0]]
    assert I.barycentre(np.zeros((3, 5))) == (2.0, 1.0) and I.barycentre(np.eye(3)) == (1.0, 1.0)
    score = np.array([[0.9, 0.6, 0.5, 0.7, 0.95, 0.1]])
    lab, n = I.watershed(score, 0.4, 0.8)
    assert n == 2 and lab.tolist() == [[1, 1, 2, 2, 2, 0]]


def test_registered_metric():
    a = smooth_noise((32, 32), 8) > 0.5
    b = np.roll(a, 2, 1)
    d = REG.registered(I.hamming, "translation")
    assert d(a, b) < 0.5 * I.hamming(a, b) and d(a, a) < 0.01
    assert REG.registered(I.hamming, "translation", skip_above=0.0)(a, b) == I.hamming(a, b)


def test_stage_chain(spark, tmp_path):
    from patchweave.plans.stages import Chain

    ran = []

    def add(name):
        def fn(s, df):
            ran.append(name)
            return s.range(3).withColumn("x", F.lit(0)) if df is None else df.withColumn("x", F.col("x") + 1)

        return name, fn

    c = Chain([add("a"), add("b"), add("c")], str(tmp_path))
    assert c.run(spark).select("x").distinct().collect()[0][0] == 2
    assert c.run(spark, only="b").first().x == 1 and c.run(spark, start="c").first().x == 2
    assert ran == ["a", "b", "c", "b", "c"]
    with pytest.raises(ValueError, match="no stage"):
        c.run(spark, only="z")
