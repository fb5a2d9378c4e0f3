"""Graph operators over edge tables (src < dst, weight). Whole-graph steps are joins; path-based ones run a component at a time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that iterative plans stay short and survive lost executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="patchweave-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def edges_of(directed: DataFrame, reciprocal: bool, weight: str = "nlfa") -> DataFrame:
    """Undirected edges of directed pairs (i, j, weight columns), self loops dropped.

    Reciprocal: both directions are needed and the weights are averaged. Otherwise either direction makes an edge, and
    of two the one from the larger id gives the weight.
    """
    d = directed.where("i <> j").select("i", "j", (F.lit(1.0) if weight == "one" else F.col(weight)).alias("w"))
    flat = d.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), (F.col("i") > F.col("j")).alias("down"), "w")
    g = flat.groupBy("src", "dst").agg(F.count_distinct("down").alias("k"), F.avg("w").alias("mean"), F.max(F.struct("down", "w"))["w"].alias("first"))
    return (g.where("k = 2").select("src", "dst", F.col("mean").alias("weight")) if reciprocal else g.select("src", "dst", F.col("first").alias("weight")))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree, degree_centrality (over n - 1), strength (sum of weights); isolated vertices have 0."""
    per = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    n = F.broadcast(vertices.agg(F.count("*").alias("n_vertices")))
    d = F.coalesce("degree", F.lit(0))
    return vertices.select("id").join(per, "id", "left").crossJoin(n).select("id", d.alias("degree"), F.when(F.col("n_vertices") > 1, d / (F.col("n_vertices") - 1)).otherwise(0.0).alias("degree_centrality"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def _jumped(pointers: DataFrame) -> DataFrame:
    """Pointers (a, m) two hops on; roots point at themselves."""
    return pointers.join(pointers.select(F.col("a").alias("m"), F.col("m").alias("m2")), "m", "left").select("a", F.coalesce("m2", "m").alias("m"))


#: Edges (16 bytes each) up to which one task finishes the contraction; larger graphs are contracted by joins first.
FINISH_EDGES = 4_000_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, m): the smallest vertex of each vertex's piece, of a graph that fits one task."""
    parts = list(batches)
    if not parts:
        return
    e = pd.concat(parts)
    ids, flat = np.unique(np.concatenate([e.a.to_numpy(), e.b.to_numpy()]), return_inverse=True)
    a, b = flat[: len(e)], flat[len(e) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    yield pd.DataFrame({"a": ids, "m": ids[root]})


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest vertex of each connected piece, by contraction along smallest-neighbour pointers."""
    assign = vertices.select("id", F.col("id").alias("component"))
    e = _stage(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "edges")
    while n := e.count():
        if n <= FINISH_EDGES:
            least = _stage(e.coalesce(1).mapInPandas(_finish, "a long, m long"), "least")
        else:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = _stage(_jumped(_jumped(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))), "least")
        moved = least.select(F.col("a").alias("component"), "m")
        assign = _stage(assign.join(moved, "component", "left").select("id", F.coalesce("m", "component").alias("component")), "assign")
        if n <= FINISH_EDGES:
            break
        x, y = least.select("a", F.col("m").alias("x")), least.select(F.col("a").alias("b"), F.col("m").alias("y"))
        e = _stage(e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return assign


def topology(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = F.col("n_nodes"), F.col("n_edges")
    t = vertices.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    return t.select("n_nodes", "n_edges", F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * m / n).otherwise(0.0).alias("avg_degree"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Unweighted modularity, CPM quality and internal density of a partition (id, cluster); one row."""
    a, b = membership.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), membership.select(F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    inside = e.groupBy("ca").agg(F.count_if(F.col("ca") == F.col("cb")).alias("e_c"))
    ends = e.select(F.explode(F.array("ca", "cb")).alias("ca")).groupBy("ca").agg(F.count("*").alias("k_c"))
    size = membership.groupBy(F.col("cluster").alias("ca")).agg(F.count("*").alias("n_c"))
    m = F.broadcast(edges.agg(F.count("*").alias("m")))
    t = size.join(inside, "ca", "left").join(ends, "ca", "left").fillna(0, ["e_c", "k_c"]).crossJoin(m)
    c2 = F.col("n_c") * (F.col("n_c") - 1) / 2
    return t.agg(
        F.sum(F.col("e_c") / F.col("m") - gamma * F.pow(F.col("k_c") / (2 * F.col("m")), 2)).alias("modularity"),
        F.sum(F.col("e_c") - gamma * c2).alias("cpm"),
        F.when(F.sum(c2) > 0, F.sum("e_c") / F.sum(c2)).otherwise(0.0).alias("internal_density"),
    )


# -- kernels on one component ----------------------------------------------------------------------------------------
def adjacency(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Sorted vertex ids and neighbour lists by index."""
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)].tolist(), flat[len(src) :].tolist()
    nb: list[list[int]] = [[] for _ in ids]
    for x, y in zip(a, b, strict=True):
        if x != y:
            nb[x].append(y)
            nb[y].append(x)
    return ids, [sorted(set(x)) for x in nb]


def betweenness(nb: list[list[int]]) -> np.ndarray:
    """Unnormalised betweenness: share of shortest paths through each vertex, over unordered pairs."""
    n = len(nb)
    score = np.zeros(n)
    for s in range(n):
        level, paths, before = [-1] * n, [0.0] * n, [[] for _ in range(n)]
        level[s], paths[s] = 0, 1.0
        order = [s]
        for v in order:
            for w in nb[v]:
                if level[w] < 0:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = [0.0] * n
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    return score / 2


def distance_sums(nb: list[list[int]]) -> np.ndarray:
    out = np.zeros(len(nb))
    for s in range(len(nb)):
        far, order = {s: 0}, [s]
        for v in order:
            for w in nb[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    order.append(w)
        out[s] = sum(far.values())
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Values that are not negative, each once, in order."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


def flat_adjacency(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted vertex ids, where each one's neighbours start (one more at the end), and all neighbours by index."""
    ids = _distinct(np.concatenate([src, dst]))
    n, a, b = len(ids), np.searchsorted(ids, src), np.searchsorted(ids, dst)
    key = _distinct(np.concatenate([a * n + b, b * n + a])[np.tile(a != b, 2)])
    return ids, np.searchsorted(key, np.arange(n + 1) * n), key % n


def _spread(at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each neighbour of the vertices ``at``: the position in ``at`` and the place in the list of all neighbours."""
    deg = starts[at + 1] - starts[at]
    which = np.repeat(np.arange(len(at)), deg)
    return which, np.arange(len(which)) + np.repeat(starts[at] - (np.cumsum(deg) - deg), deg)


def end_order(starts: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Vertices of a connected graph by distance from a far one, so that neighbours in the order are near each other."""
    return np.argsort(levels_from(starts, nb, int(levels_from(starts, nb, 0).argmax())), kind="stable")


def renumbered(starts: np.ndarray, nb: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The graph with its vertices in an ``order``, and each one's new number."""
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    deg = np.diff(starts)[order]
    return np.concatenate([[0], np.cumsum(deg)]), to[nb[_spread(order, starts)[1]]], to


#: Sources whose searches run together: as bits of words, and as rows of counts.
BITS, ROWS = 512, 64


def distances_to(starts: np.ndarray, nb: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Sum of the distances from ``sources`` to each vertex. A vertex keeps a bit a source, so near sources are cheap."""
    n, out = len(starts) - 1, np.zeros(len(starts) - 1, np.int64)
    for i in range(0, len(sources), BITS):
        mine = sources[i : i + BITS]
        seen = np.zeros((n, -(-len(mine) // 64)), np.uint64)
        bit = np.arange(len(mine))
        seen[mine, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        front, at, far = seen.copy(), np.sort(mine), 0
        while len(at):
            far += 1
            to = np.unique(nb[_spread(at, starts)[1]])
            _, places = _spread(to, starts)
            deg = starts[to + 1] - starts[to]
            got = np.bitwise_or.reduceat(front[nb[places]], np.cumsum(deg) - deg, axis=0) & ~seen[to] if len(to) else seen[:0]
            front[at] = 0
            any_ = got.any(1)
            at, got = to[any_], got[any_]
            front[at] = got
            seen[at] |= got
            out[at] += far * np.bitwise_count(got).sum(1, dtype=np.int64)
    return out


#: Relative difference of two searches' path counts, after scaling, up to which they are taken as one; shares then differ
#: by no more than twice that.
ALIKE = 1e-11
#: Cells of a batch's state (a source times a vertex), levels that a first search may go, on either side, levels from one
#: comparison with the ends to the next, and trial searches.
CELLS, DEPTH, EVERY, PROBES = 2_000_000, 96, 4, 64


class Ends:
    """Searches from two far ends of a connected graph whose vertices are in order of their distance from the first end.

    Where another search meets all vertices at one distance from an end at one time, it goes on beyond them as the end's did:
    distances differ by a constant and, if counts of paths were proportional there, so do all shares. It need not go on
    there. ``size``, ``beyond`` and ``sums`` are, of each end and distance: vertices at it, vertices beyond it, and the sum
    of how far beyond.
    """

    def __init__(self, starts: np.ndarray, nb: np.ndarray, counts: bool) -> None:
        n = len(starts) - 1
        self.starts, self.nb = starts, nb
        if counts:
            self.level, self.paths, self.shares, _ = _search(starts, nb, np.array([0, n - 1]))
            self.level = self.level.astype(np.int64)
        else:
            self.level = np.stack([levels_from(starts, nb, 0), levels_from(starts, nb, n - 1)])
        self.size = [np.bincount(x) for x in self.level]
        self.beyond = [n - np.cumsum(x) for x in self.size]
        self.sums = [np.cumsum(x[::-1])[::-1] for x in self.beyond]
        self.starts_at = np.searchsorted(self.level[0], np.arange(len(self.size[0]) + 1))
        self.stops = [np.zeros(len(x), np.int64) for x in self.size]

    def window(self, mine: np.ndarray, depth: int) -> tuple[int, int]:
        """The vertices that searches of ``depth`` levels from ``mine`` can meet, and their neighbours."""
        lo, hi = self.level[0][mine[0]] - depth - 1, self.level[0][mine[-1]] + depth + 2
        return int(self.starts_at[max(lo, 0)]), int(self.starts_at[min(hi, len(self.starts_at) - 1)])

    def joined(self, side: int, at: np.ndarray, row: np.ndarray, lo: int, level: np.ndarray, mine: np.ndarray, paths: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a front ``at``, ordered by ``row``, that go on as the search from the end ``side`` did, the distances from it, and
        which of the front this is.

        All at that distance must be met at once, from a source not beyond it, and no neighbour on this side of it may be unmet:
        all shortest paths through it then lead beyond it, and no others do. ``level`` is negative where a row has not been.
        """
        v, seg = at - row * level.shape[1] + lo, np.flatnonzero(np.diff(row, prepend=-1))
        r, size, a = row[seg], np.diff(seg, append=len(row)), self.level[side][v]
        top = np.maximum.reduceat(a, seg)
        on = a == np.repeat(top, size)
        good = (np.add.reduceat(on, seg, dtype=np.int64) == self.size[side][top]) & (self.level[side][mine[r]] <= top)
        if paths is not None and good.any():
            ratio = paths / self.paths[side][v]
            high, low = np.maximum.reduceat(np.where(on, ratio, 0.0), seg), np.minimum.reduceat(np.where(on, ratio, np.inf), seg)
            good &= np.isfinite(high) & (low > 0) & (high <= low * (1 + ALIKE))
        on &= np.repeat(good, size)
        which, places = _spread(v[on], self.starts)
        to, of = self.nb[places], row[on][which]
        left = (self.level[side][to] <= a[on][which]) & (level[of, to - lo] < 0)
        if left.any():
            good &= ~np.isin(r, np.unique(of[left]))
            on &= np.repeat(good, size)
        return r[good], top[good], on


def levels_from(starts: np.ndarray, nb: np.ndarray, source: int) -> np.ndarray:
    """Distances from a vertex."""
    level = np.full(len(starts) - 1, -1)
    level[source], at, k = 0, np.array([source]), 0
    while len(at):
        k += 1
        at = nb[_spread(at, starts)[1]]
        at = _distinct(at[level[at] < 0])
        level[at] = k
    return level


def _once(to: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each value once, in order of a place; ``mark`` is scratch."""
    k = np.arange(len(to), dtype=np.int32)
    mark[to] = k
    return to[mark[to] == k]


def _search(starts: np.ndarray, nb: np.ndarray, mine: np.ndarray, ends: Ends | None = None, depth: int | None = None, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(levels, scaled counts of shortest paths, shares, ended) of searches from ``mine``, a row each, over the window of ``depth``.

    With ``ends`` a search stops where it goes on as theirs did. Its stop is counted there, its row holds shares of what is
    nearer only, and a search that did not stop in ``depth`` levels is not ``ended`` and has none.
    """
    n = len(starts) - 1
    lo, hi = (0, n) if depth is None else ends.window(mine, depth)
    rows, w = len(mine), hi - lo
    level, paths, mark = np.full(rows * w, -1, np.int32), np.zeros(rows * w, kind), np.empty(rows * w, np.int32)
    at = np.arange(rows) * w + mine - lo
    level[at], paths[at], far, steps = 0, 1, 0, []
    stops, share, edge = np.full((2, rows), -1), np.zeros(rows * w), []
    while len(at):
        for side in (0, 1) if ends is not None and far % EVERY == 0 else ():
            row = at // w
            on = stops[side][row] < 0
            if on.any():
                r, k, on[on] = ends.joined(side, at[on], row[on], lo, level.reshape(rows, w), mine, paths[at[on]])
                stops[side][r] = k
                edge.append(at[on])
                share[at[on]] = ends.shares[side][at[on] % w + lo]
                at = at[~on]
        if far == depth:
            break
        far += 1
        v = at % w
        which, places = _spread(v + lo, starts)
        to = (at - v - lo)[which] + nb[places]
        there = level[to]
        keep = there < 0
        which, to = which[keep], to[keep]
        ahead = _once(to, mark)
        level[ahead] = far
        mark[ahead] = np.arange(len(ahead), dtype=np.int32)
        slot = mark[to]
        found = np.bincount(slot, paths[at][which], len(ahead)) if kind is np.float64 else _sums(slot, paths[at][which], len(ahead))
        kept = found
        if len(found) and found.max() > 1e150:
            row = ahead // w
            seg = np.flatnonzero(np.diff(row, prepend=-1))
            kept = found / np.repeat(np.maximum.reduceat(found, seg), np.diff(seg, append=len(row)))
            if not np.isfinite(found).all() or kept.min() < (1e-150 if kind is np.float64 else 1e-2000):
                if kind is not np.float64:
                    raise OverflowError("counts of shortest paths at one distance differ by more than an extended double can hold")
                return _search(starts, nb, mine, ends, depth, np.longdouble)
        paths[ahead] = kept
        steps.append((at, which, ahead, slot, found))
        at = ahead
    left = np.unique(at // w) if far == depth else at[:0]
    for at, which, ahead, slot, found in reversed(steps):
        if len(ahead):
            rate = (1 + share[ahead]) / found
            share[at] = np.bincount(which, (paths[at][which] * rate[slot]).astype(float), len(at))
    share[np.arange(rows) * w + mine - lo] = 0
    for out in edge:
        share[out] = 0
    share = share.reshape(rows, w)
    share[left] = 0
    ended = np.ones(rows, bool)
    ended[left] = False
    if ends is not None:
        for side in (0, 1):
            k = stops[side][ended]
            np.add.at(ends.stops[side], k[k >= 0], 1)
    return level.reshape(rows, w), paths.reshape(rows, w), share, ended


def _batches(mine: np.ndarray, ends: Ends, depth: int | None, n: int, most: int) -> Iterator[np.ndarray]:
    """Sources in runs whose states hold up to CELLS cells, about."""
    i = 0
    while i < len(mine):
        k = min(most, len(mine) - i)
        while k > 1:
            lo, hi = (0, n) if depth is None else ends.window(mine[i : i + k], depth)
            if k * (hi - lo) <= CELLS:
                break
            k //= 2
        yield mine[i : i + k]
        i += k


def path_shares(starts: np.ndarray, nb: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Shares of shortest paths from ``sources`` that lead through each vertex, summed.

    Searches stop where they go on as those from two far ends do, whose shares then stand for theirs; a search that does not
    come to that goes through the whole graph. Counts of paths are scaled level by level.
    """
    n = len(starts) - 1
    starts, nb, to = renumbered(starts, nb, end_order(starts, nb))
    ends, out, left, depth = Ends(starts, nb, counts=True), np.zeros(n), np.sort(to[sources]), DEPTH
    while len(left):
        whole = depth >= len(ends.size[0]) - 1
        again = []
        for mine in _batches(left, ends, None if whole else depth, n, ROWS):
            lo, hi = (0, n) if whole else ends.window(mine, depth)
            share, ended = _search(starts, nb, mine, ends, None if whole else depth)[2:]
            out[lo:hi] += share.sum(0)
            again.append(mine[~ended])
        left, depth = np.concatenate(again), depth * 4
    for side in (0, 1):
        out += ends.shares[side] * np.cumsum(ends.stops[side])[ends.level[side]]
    return out[to]

def _totals(starts: np.ndarray, nb: np.ndarray, mine: np.ndarray, ends: Ends, depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(sums of distances to all vertices, ended) of searches from ``mine``, as ``_search`` makes them."""
    lo, hi = (0, len(starts) - 1) if depth is None else ends.window(mine, depth)
    rows, w = len(mine), hi - lo
    met, mark = np.full(rows * w, -1, np.int8), np.empty(rows * w, np.int32)
    at, far, total = np.arange(rows) * w + mine - lo, 0, np.zeros(rows, np.int64)
    met[at], open_ = 0, np.ones((2, rows), bool)
    while len(at):
        total += far * np.bincount(at // w, minlength=rows)
        for side in (0, 1) if far % EVERY == 0 else ():
            row = at // w
            on = open_[side][row]
            if on.any():
                r, k, on[on] = ends.joined(side, at[on], row[on], lo, met.reshape(rows, w), mine, None)
                open_[side][r] = False
                total[r] += far * ends.beyond[side][k] + ends.sums[side][k]
                at = at[~on]
        if far == depth:
            break
        far += 1
        v = at % w
        which, places = _spread(v + lo, starts)
        to = (at - v - lo)[which] + nb[places]
        at = _once(to[met[to] < 0], mark)
        met[at] = 0
    ended = np.ones(rows, bool)
    ended[at // w] = False
    return total, ended


def distance_totals(starts: np.ndarray, nb: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Sums of distances, by vertex, so that those of calls that share out all sources of a connected graph add up to each one's.

    If most of some searches, spread over the graph, stop early as those of ``path_shares`` do, all are made so.
    """
    n = len(starts) - 1
    at, by, to = renumbered(starts, nb, end_order(starts, nb))
    ends = Ends(at, by, counts=False)
    few = np.unique(np.linspace(0, n - 1, PROBES).astype(int))
    if len(ends.size[0]) < 2 * DEPTH or np.mean([_totals(at, by, few[i : i + 1], ends, DEPTH)[1][0] for i in range(len(few))]) < 0.5:
        return distances_to(starts, nb, sources)
    out, left, depth = np.zeros(n, np.int64), np.sort(to[sources]), DEPTH
    while len(left):
        whole = depth >= len(ends.size[0]) - 1
        again = []
        for mine in _batches(left, ends, None if whole else depth, n, BITS):
            total, ended = _totals(at, by, mine, ends, None if whole else depth)
            out[mine[ended]] = total[ended]
            again.append(mine[~ended])
        left, depth = np.concatenate(again), depth * 4
    return out[to]


def _sums(slot: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    np.add.at(out, slot, values)
    return out


#: A part of a component's searches visits about so many edges; a component has at most PARTS of them and, beyond 12, its
#: edges are not sent more often than makes COPIES.
VISITS, PARTS, COPIES = 20_000_000, 96, 30_000_000


def path_centralities(vertices: DataFrame, edges: DataFrame, measures: tuple[str, ...] = ("betweenness", "closeness")) -> DataFrame:
    """id, betweenness (over (n-1)(n-2)/2), closeness scaled by the share of vertices reached; only those asked for.

    A component's sources are dealt to up to PARTS tasks. Each holds the edges of the component and sends sums.
    """
    n = vertices.count()
    comp = _stage(components(vertices, edges), "component-of")
    e = edges.select("src", "dst").join(comp.select(F.col("id").alias("src"), "component"), "src")
    work = comp.groupBy("component").agg(F.count("*").alias("k")).join(e.groupBy("component").agg(F.count("*").alias("m")), "component")
    parts = work.select("component", F.least(F.lit(PARTS), F.ceil(F.col("k") * F.col("m") / VISITS), F.greatest(F.lit(12), F.floor(COPIES / F.col("m")))).cast("int").alias("parts"))
    dealt = e.join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, starts, nb = flat_adjacency(pdf.src.to_numpy(), pdf.dst.to_numpy())
        part, of = int(pdf.part.iloc[0]), int(pdf.parts.iloc[0])
        mine = np.array_split(end_order(starts, nb), of)[part]
        zero = np.zeros(len(ids))
        return pd.DataFrame({"id": ids, "k": len(ids), "share": path_shares(starts, nb, mine) if "betweenness" in measures else zero, "far": distance_totals(starts, nb, mine) if "closeness" in measures else zero.astype(int)})

    per = dealt.repartition(PARTS, "component", "part").groupBy("component", "part").applyInPandas(run, "id long, k long, share double, far long")
    pairs, k = (n - 1) * (n - 2) / 2, F.col("k")
    score = {"betweenness": F.col("share") / (2 * pairs) if pairs else F.lit(0.0), "closeness": (k - 1) / F.col("far") * (k - 1) / (n - 1)}
    sums = per.groupBy("id").agg(F.max("k").alias("k"), F.sum("share").alias("share"), F.sum("far").alias("far"))
    return vertices.select("id").join(sums.select("id", *[score[c].alias(c) for c in measures]), "id", "left").fillna(0.0)


def eigenvector(vertices: DataFrame, edges: DataFrame, rounds: int = 500, tol: float = 1e-6) -> DataFrame:
    """Eigenvector centrality by power iteration of A + I; all 0 if it does not settle. Each round is one join."""
    n = vertices.count()
    e = _stage(both_ways(edges).select("src", "dst"), "both-ways")
    x = _stage(vertices.select("id", F.lit(1.0 / max(n, 1)).alias("x")), "vector")
    for _ in range(rounds):
        pulled = e.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("y"))
        y = x.join(pulled, "id", "left").select("id", "x", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("y"))
        norm = F.broadcast(y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm")))
        z = _stage(y.crossJoin(norm).select("id", "x", (F.col("y") / F.col("norm")).alias("y")), "vector")
        gap = z.agg(F.sum(F.abs(F.col("y") - F.col("x")))).first()[0] or 0.0
        x = z.select("id", F.col("y").alias("x"))
        if gap < n * tol:
            return x.select("id", F.col("x").alias("eigenvector"))
    return vertices.select("id", F.lit(0.0).alias("eigenvector"))


def spanning_tree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Minimum spanning forest by contraction: every piece takes its lightest way out, ties by edge; pieces then merge."""
    left = _stage(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", "src", "dst").alias("o")), "out-edges")
    chosen = None
    while not left.isEmpty():
        ways = left.select("a", "o", F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("a"), "o", F.col("a").alias("to")))
        best = _stage(ways.groupBy("a").agg(F.min(F.struct("o", "to")).alias("w")).select("a", F.col("w.to").alias("to"), "w.o"), "ways-out")
        new = best.select("o.src", "o.dst", "o.weight").distinct()
        chosen = _stage(new if chosen is None else chosen.unionByName(new), "tree")
        pieces = components(best.select(F.col("a").alias("id")), best.select(F.least("a", "to").alias("src"), F.greatest("a", "to").alias("dst")))
        pa, pb = pieces.select(F.col("id").alias("a"), F.col("component").alias("x")), pieces.select(F.col("id").alias("b"), F.col("component").alias("y"))
        merged = left.join(pa, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "o")
        left = _stage(merged.groupBy("a", "b").agg(F.min("o").alias("o")), "out-edges")
    return chosen if chosen is not None else edges.select("src", "dst", "weight").limit(0)


def fiedler_split(nb: list[list[int]]) -> np.ndarray:
    """Two sides of a connected graph by the sign of the second eigenvector of the normalised Laplacian."""
    n = len(nb)
    if n < 2:
        return np.zeros(n, int)
    a = np.zeros((n, n))
    for i, x in enumerate(nb):
        a[i, x] = 1
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1))
    v = np.linalg.eigh(np.eye(n) - d[:, None] * a * d[None, :])[1][:, 1]
    v = v if v[np.abs(v).argmax()] > 0 else -v
    return (v >= 0).astype(int)


def fiedler(edges: DataFrame, by: str) -> DataFrame:
    """(cluster, id, side) of every cluster's subgraph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nb = adjacency(pdf.src.to_numpy(), pdf.dst.to_numpy())
        return pd.DataFrame({"cluster": pdf[by].iloc[0], "id": ids, "side": fiedler_split(nb)})

    return edges.groupBy(by).applyInPandas(run, "cluster long, id long, side int")


def partition(nb: list[list[int]], gamma: float, kind: str = "cpm") -> np.ndarray:
    """Communities of one component: local moves to the best neighbour community, then aggregation, until nothing moves.

    Quality is sum of e_c - gamma * C2(n_c) (cpm) or e_c - gamma * K_c**2 / (4 m) (modularity). Vertices go in id order
    and ties go to the smaller community, so runs agree. Communities are cut into connected pieces at the end.
    """
    n = len(nb)
    m = sum(map(len, nb)) / 2
    part = np.arange(n)
    links = [{y: 1.0 for y in x} for x in nb]
    size = [1.0] * n if kind == "cpm" else [float(len(x)) for x in nb]
    factor = gamma if kind == "cpm" else (gamma / (2 * m) if m else 0.0)
    while True:
        k = len(links)
        com, total = list(range(k)), list(size)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in range(k):
                old = com[v]
                to: dict[int, float] = {old: 0.0}
                for w, x in links[v].items():
                    if w != v:
                        to[com[w]] = to.get(com[w], 0.0) + x
                total[old] -= size[v]
                gain = {c: x - factor * size[v] * total[c] for c, x in to.items()}
                best = max(gain, key=lambda c: (gain[c] > gain[old] + 1e-12, gain[c] if gain[c] > gain[old] + 1e-12 else 0, -c))
                best = best if gain[best] > gain[old] + 1e-12 else old
                total[best] += size[v]
                if best != old:
                    com[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        names = {c: i for i, c in enumerate(sorted(set(com)))}
        com = [names[c] for c in com]
        part = np.array([com[p] for p in part])
        merged: list[dict[int, float]] = [{} for _ in names]
        grown = [0.0] * len(names)
        for v in range(k):
            grown[com[v]] += size[v]
            for w, x in links[v].items():
                merged[com[v]][com[w]] = merged[com[v]].get(com[w], 0.0) + x
        links, size = merged, grown
    out, seen = np.full(n, -1), 0
    for v in range(n):
        if out[v] < 0:
            out[v], stack = seen, [v]
            while stack:
                for w in nb[stack.pop()]:
                    if out[w] < 0 and part[w] == part[v]:
                        out[w] = seen
                        stack.append(w)
            seen += 1
    return out


def communities(vertices: DataFrame, edges: DataFrame, gamma: float, kind: str = "cpm", comp: DataFrame | None = None) -> DataFrame:
    """(id, cluster): each community is named by its smallest vertex; isolated vertices are their own.

    Modularity looks at the whole graph, but its optimum never joins components; its factor uses the global edge count.
    ``comp`` is the result of ``components``, where it is known.
    """
    comp = components(vertices, edges) if comp is None else comp
    m_all = edges.count()
    e = edges.join(comp.select(F.col("id").alias("src"), "component"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nb = adjacency(pdf.src.to_numpy(), pdf.dst.to_numpy())
        m = sum(map(len, nb)) / 2
        g = gamma if kind == "cpm" else gamma * m / m_all
        com = partition(nb, g, kind)
        first = pd.Series(ids).groupby(com).transform("min").to_numpy()
        return pd.DataFrame({"id": ids, "cluster": first})

    per = e.groupBy("component").applyInPandas(run, "id long, cluster long")
    return vertices.select("id").join(per, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
