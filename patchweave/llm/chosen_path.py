"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; equal sets are one node. In each of several runs a set takes every shingle
whose run-salted hash falls under 1 / (0.8 |set|), so similar sets are likely to take one in common. Sets that took
the same shingle form a bucket. Small buckets are compared by brute force on bit sketches; a large one is first
covered by pivots, and what no pivot covers is split again on minimum hashes chosen along its path. Runs repeat until the
chance that a pair at the threshold never meets is below one in a thousand.

What meets only forms cells, connected pieces of likely links. Each text is then sent to its cell once, or to a row of
blocks where a cell is large, and all pairs within are verified exactly on the full sets, so sketches decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import map_arrow, pick, stage, wrapped
from patchweave.llm.suffix_dedup import PrefixHashes, _avalanche

WORDS = 5
#: Similarity of a link as a fraction: inter / union >= NUM / DEN.
NUM, DEN = 4, 5
#: At each level two sets at the threshold share a chosen shingle with chance 1 - 1/e at least; 0.37**16 < 1e-6 for one
#: level and below 6e-4 for three.
RUNS, LEVELS = 16, 3
#: Bits of a sketch, and the estimated similarity from which two sets share a cell. The estimate's deviation is 0.04 at 0.8.
BITS, LIKELY = 256, 0.6
#: Minimum hashes that stand for a set below the first level.
MINS = 64
#: Buckets up to this size are compared pair by pair; up to SHIFTS by shifted arrays.
BRUTE, SHIFTS = 2048, 24
#: Pivots of a large bucket; a set this similar to a pivot has all its links among the sets that are at least NEAR to it.
PIVOTS, CORE, NEAR = 64, 0.7, 0.4
#: A covered set names its pivot in so many of its large buckets, the same for all sets: those of least key.
SAYS = 4
#: Sets of a verification block.
BLOCK = 1024
#: Texts whose signatures are made together.
TEXTS = 512

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(77)
_RUN_SALTS = _RNG.integers(1, 1 << 62, RUNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_SALTS = _RNG.integers(1, 1 << 30, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHINGLE = _RNG.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text's bytes; all words of a shorter text are one."""
    data = _LOWER[raw]
    word = np.concatenate(([False], _WORD[data], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    w = _avalanche(PrefixHashes(data).of(start, stop - start) + (stop - start).astype(np.uint64))
    n = max(len(w) - WORDS + 1, 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        h += w[k : k + n] * _SHINGLE[k]
    return np.unique(_avalanche(h + np.uint64(min(len(w), WORDS))))


def sketch_of(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """One bit of each of BITS minimum hashes, and MINS of the hashes: the set embedded in one of fixed size."""
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (x[i : i + 4096, None] * _SKETCH_SALTS[None, :]).min(0), out=least)
    return np.packbits((least >> np.uint32(9) & np.uint32(1)).astype(bool)).tobytes(), least[:MINS].tobytes()


def limit_of(n: int) -> np.uint64:
    """Hashes below this are chosen: a chance of 1 / (0.8 n), 1 at most."""
    return np.uint64(min(((1 << 64) * DEN) // (NUM * max(n, 1)), (1 << 64) - 1))


def first_keys(tokens: np.ndarray) -> np.ndarray:
    """Bucket keys of all runs: the chosen shingles, salted by run."""
    limit = limit_of(len(tokens))
    out = []
    for r in range(RUNS):
        h = tokens * _RUN_SALTS[r]
        out.append(_avalanche(h[h <= limit] + np.uint64(r)))
    return np.concatenate(out)


def next_keys(mins: np.ndarray, key: int) -> np.ndarray:
    """Bucket keys one level below ``key``: the path so far salts a choice among the embedded set's elements."""
    tokens = mins.astype(np.uint64) | np.arange(MINS, dtype=np.uint64) << np.uint64(32)
    h = _avalanche(_avalanche(tokens) ^ np.uint64(key % (1 << 64)))
    return _avalanche(h[h <= limit_of(MINS)] ^ np.uint64(0x5851F42D4C957F2D))


def set_id(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = int(tokens.sum(dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(_avalanche(tokens * np.uint64(0x9E3779B97F4A7C15)))) ^ len(tokens)
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


SIGNATURE = "doc long, th long, sid binary, n int, sketch binary, mins binary, keys array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
        rows = []
        for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer()
            t = shingles(np.frombuffer(raw, np.uint8)) if raw is not None and raw.size else np.zeros(0, np.uint64)
            if len(t):
                rows.append((doc, th, set_id(t), len(t), *sketch_of(t), first_keys(t).astype(np.int64)))
            else:
                rows.append((doc, th, None, 0, None, None, []))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc", "th", "sid", "n", "sketch", "mins", "keys"])


def _close(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Where estimated similarities of sketches (rows of 64-bit words) reach ``least``."""
    differ = np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)
    return differ <= int(BITS * (1 - least) / 2)


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's connected piece under edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


class _Bucket:
    """A bucket too large to hold: its members stream by, pivots stay."""

    def __init__(self, key: int):
        self.key = key
        self.pivots: list[tuple[bytes, np.ndarray]] = []

    def take(self, sid: list[bytes], sketch: np.ndarray, says: np.ndarray) -> tuple[list[tuple[bytes, bytes]], list[int]]:
        """Edges, and the members that no pivot covers.

        A member has one edge, to its first near pivot, if it says so here; pivots that are near to one member are
        joined with each other in any case.
        """
        if len(self.pivots) < PIVOTS:
            fresh = np.argsort(_avalanche(sketch[:, 0]), kind="stable")[: PIVOTS - len(self.pivots)]
            self.pivots += [(sid[i], sketch[i]) for i in fresh.tolist()]
        near = np.stack([_close(sketch, p[None, :], NEAR) for _, p in self.pivots], 1)
        covered = np.zeros(len(sid), bool)
        for _, p in self.pivots:
            covered |= _close(sketch, p[None, :], CORE)
        first = near.argmax(1)
        edges = [(sid[i], self.pivots[first[i]][0]) for i in np.flatnonzero(near.any(1) & (says | ~covered)).tolist()]
        joint = near.astype(np.float32)
        x, y = np.nonzero(joint.T @ joint)
        edges += [(self.pivots[a][0], self.pivots[b][0]) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a < b]
        return [(a, b) for a, b in edges if a != b], np.flatnonzero(~covered).tolist()


def _bucket_pairs(last: bool):
    """Members sorted by key to rows (a, b, key): edges between nodes, or with b null a member left for the next level."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        big: _Bucket | None = None

        def emit(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                out = list(dict.fromkeys(out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "key"])

        def drain(table: pa.Table, done: bool) -> Iterator[pa.RecordBatch]:
            """Works off the buckets of ``table``; unless ``done`` its last bucket may go on and is kept back."""
            nonlocal held, rows, big
            table = table.combine_chunks()
            key = table.column("key").to_numpy()
            cut = len(key) if done else int(np.searchsorted(key, key[-1]))
            if not done and not last and len(key) - cut > BRUTE:  # a large bucket streams
                cut = len(key)
            if cut:
                yield from emit(work(table.slice(0, cut), open_end=not done and cut == len(key)))
            held, rows = (table.slice(cut).to_batches(), table.num_rows - cut) if cut < table.num_rows else ([], 0)

        def work(table: pa.Table, open_end: bool) -> list[tuple]:
            nonlocal big
            key, n = table.column("key").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            sid, says = table.column("sid").to_pylist(), table.column("says").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(head, len(key)))
            out: list[tuple] = []
            of_row = np.repeat(size, size)
            large = np.zeros(len(head), bool)
            if not last:
                large = size > BRUTE
                if big is not None and big.key == int(key[0]):
                    large[0] = True
                if open_end:
                    large[-1] = True
            small = np.repeat(~large & (size <= SHIFTS), size) & (of_row > 1)
            at = np.flatnonzero(small)
            k = key[at]
            a, b = [], []
            for d in range(1, int(of_row[at].max()) if len(at) else 0):
                i = np.flatnonzero(k[:-d] == k[d:])
                i, j = at[i], at[i + d]
                ok = _sizes_fit(n[i], n[j]) & _close(sketch[i], sketch[j], LIKELY)
                a.append(i[ok])
                b.append(j[ok])
            for h, s in zip(head[~large & (size > SHIFTS)].tolist(), size[~large & (size > SHIFTS)].tolist(), strict=True):
                for i in range(h, h + s, 256):
                    t = np.arange(i, min(i + 256, h + s))
                    rest = np.arange(i, h + s)
                    ok = _sizes_fit(n[t][:, None], n[rest][None, :]) & _close(sketch[t][:, None, :], sketch[rest][None, :, :], LIKELY)
                    x, y = np.nonzero(ok)
                    # one edge to the first neighbour of the block and one from it to each later set keep pieces whole
                    root = _roots(len(rest), x, y)
                    z = np.flatnonzero(root != np.arange(len(rest)))
                    a.append(rest[z])
                    b.append(rest[root[z]])
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                root = _roots(len(key), x, y)
                # the name of a piece is its smallest set id, so that runs agree on it
                moved = np.unique(np.concatenate([x, y]))
                pieces: dict[int, list[int]] = {}
                for i in moved.tolist():
                    pieces.setdefault(int(root[i]), []).append(i)
                for members in pieces.values():
                    name = min(sid[i] for i in members)
                    out += [(sid[i], name, None) for i in members if sid[i] != name]
            for h, s in zip(head[large].tolist(), size[large].tolist(), strict=True):
                if big is None or big.key != int(key[h]):
                    big = _Bucket(int(key[h]))
                edges, left = big.take(sid[h : h + s], sketch[h : h + s], says[h : h + s])
                out += [(x, y, None) for x, y in edges]
                out += [(sid[h + i], None, big.key) for i in left]
            return out

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 40_000:
                yield from drain(pa.Table.from_batches(held), False)
        if rows:
            yield from drain(pa.Table.from_batches(held), True)

    return pairs


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), by contraction: each round joins nodes with their smallest neighbour.

    Edges shrink from round to round; every round is written, so no lineage grows.
    """
    e = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    assign = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        if assign is None:
            assign = least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            moved = least.withColumnRenamed("a", "root")
            assign = stage(assign.join(moved, "root", "left").select("node", F.coalesce("m", "root").alias("root")), "roots")
        x, y = least.select("a", F.col("m").alias("x")), least.select(F.col("a").alias("b"), F.col("m").alias("y"))
        e = stage(e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if e.isEmpty():
            return assign


LINKS = "sid binary, root binary, links long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, bi, bj): exact links within each block pair, summed for each set, and pieces by their root."""
    held: list[pa.RecordBatch] = []
    rows = 0
    names = ["cell", "bi", "bj"]

    def keys(t: pa.Table):
        return list(zip(*(t.column(c).to_pylist() for c in names), strict=True))

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k = keys(t)
        sid, side, weight, text = (t.column(c).to_pylist() for c in ("sid", "side", "weight", "raw"))
        out: list[tuple] = []
        i = 0
        while i < len(k):
            j = i
            while j < len(k) and k[j] == k[i]:
                j += 1
            own = [x for x in range(i, j) if x == i or sid[x] != sid[x - 1]]  # equal rows bring a set twice
            if len(own) > 1:
                out += _block(k[i], *([c[x] for x in own] for c in (sid, side, weight, text)))
            i = j
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["sid", "root", "links"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 2 * BLOCK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = keys(t)
        cut = len(k)
        while cut and k[cut - 1] == k[-1]:
            cut -= 1
        if cut:
            yield from work(t.slice(0, cut))
        held, rows = t.slice(cut).to_batches(), len(k) - cut
    if rows:
        yield from work(pa.Table.from_batches(held))


def _block(key: tuple, sid: list[bytes], side: list[int], weight: list[int], text: list[bytes]) -> list[tuple]:
    sets = [shingles(np.frombuffer(t, np.uint8)) for t in text]
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    if m == 2:
        inter = np.array([[n[0], x := len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [x, n[1]]])
    else:
        inter = common_counts(sets)
    total = n[:, None] + n[None, :]
    link = (DEN + NUM) * inter >= NUM * total  # inter / (total - inter) >= NUM / DEN
    np.fill_diagonal(link, False)
    if key[1] != key[2]:
        s = np.array(side)
        link &= s[:, None] != s[None, :]
    w = np.array(weight, np.int64)
    links = link @ w
    x, y = np.nonzero(link)
    root = _roots(m, x, y)
    least: dict[int, bytes] = {}
    for i in np.flatnonzero(links).tolist():
        r = int(root[i])
        least[r] = min(least.get(r, sid[i]), sid[i])
    return [(sid[i], least[int(root[i])], int(links[i])) for i in np.flatnonzero(links).tolist()]


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that two sets or more hold."""
    m = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    row, col = row[shared], col[shared]
    used, col = np.unique(col, return_inverse=True)
    inter = np.zeros((m, m), np.float32)
    step = max(64, (1 << 22) // max(m, 1))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for c in range(0, len(used), step):
        a, b = np.searchsorted(col, (c, c + step))
        x = np.zeros((m, min(step, len(used) - c)), np.float32)
        x[row[a:b], col[a:b] - c] = 1
        inter += x @ x.T
    return inter.astype(np.int64)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), n_shingles, class_id, n_links, root for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their shingle sets is 0.8 or more; ``n_links`` counts the
    other rows that a row is linked to, copies included, and ``class_id`` is the smallest doc_id of its connected class
    (null if no row of it has an id). ``root`` names the class itself, as ids may repeat; it is null without words. A text of one to four words is one shingle; a null text, or one without words,
    has none, no links, and its own id as class. Repeated rows are linked to each other. An empty table gives no rows;
    extra columns are ignored; very long texts are taken whole.
    """
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    base = pick(docs, doc_id="long", text="string").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), raw.alias("raw"))
    signed = stage(base.transform(map_arrow, _signatures, SIGNATURE), "signatures")
    nodes = stage(
        signed.where("n > 0").groupBy("sid").agg(
            F.count("*").alias("weight"), F.min("doc").alias("least"), F.min(F.struct("doc", "th")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mins").alias("mins"), F.first("keys").alias("keys")
        ),
        "nodes",
    )

    member = nodes.select(F.explode("keys").alias("key"), "sid", "n", "sketch")
    edges = None
    for level in range(1, LEVELS + 1):
        told = _with_says(member)
        found = stage(told.repartition("key").sortWithinPartitions("key").transform(map_arrow, _bucket_pairs(level == LEVELS), "a binary, b binary, key long"), f"paths-{level}")
        mine = found.where("b is not null").select("a", "b")
        edges = mine if edges is None else edges.unionByName(mine)
        left = found.where("b is null").select(F.col("a").alias("sid"), "key")
        if level == LEVELS or left.isEmpty():
            break
        split = nodes.join(left.groupBy("sid").agg(F.collect_set("key").alias("paths")), "sid").select("sid", "n", "sketch", "paths", "mins")
        member = split.transform(map_arrow, _children, "key long, sid binary, n int, sketch binary")

    cells = connected(edges)
    sizes = cells.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = (
        cells.join(sizes, "root").join(nodes.select(F.col("sid").alias("node"), "rep", "weight"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select(F.col("rep.doc").alias("doc"), F.col("rep.th").alias("th"), F.col("node").alias("sid"), F.col("root").alias("cell"), "weight", "block", "blocks")
    )
    texts = base.alias("b").join(placed.alias("p"), F.col("b.doc").eqNullSafe(F.col("p.doc")) & (F.col("b.th") == F.col("p.th"))).select("p.sid", "p.cell", "weight", "block", "blocks", "raw")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = texts.select("*", other.alias("o")).select(
        "cell", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "sid", F.when(F.col("block") <= F.col("o"), 0).otherwise(1).alias("side"), "weight", "raw"
    )
    verified = stage(dealt.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj", "sid").transform(map_arrow, _verify, LINKS), "links")

    links = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = connected(verified.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    named = nodes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "weight", "least", F.coalesce("root", "sid").alias("root"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    info = named.join(classes, "root").join(links, "sid", "left").select("sid", "root", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.join(info, "sid", "left").select(
        F.col("doc").alias("doc_id"),
        "th",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "root",
    )


def _with_says(member: DataFrame) -> DataFrame:
    """``member`` with ``says``: whether a set names its pivot in this bucket, should the bucket be large and cover it."""
    large = stage(member.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BRUTE).select("key"), "large-buckets")
    if large.isEmpty():
        return member.withColumn("says", F.lit(True))
    said = member.join(large, "key", "left_semi").groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, SAYS).alias("said"))
    return member.join(said, "sid", "left").withColumn("says", F.coalesce(F.array_contains("said", F.col("key")), F.lit(True))).drop("said")


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members one level down: the shingles that each path chooses next."""
    for b in batches:
        out: list[tuple] = []
        for sid, n, sketch, paths, mins in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            for p in paths:
                out += [(k, sid, n, sketch) for k in next_keys(np.frombuffer(mins, np.uint32), p).astype(np.int64).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["key", "sid", "n", "sketch"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one document of each class: the smallest id stays, of equal ids the smallest text hash.

    Rows without words are told apart by id and text; of wholly equal rows one stays.
    """
    found = similar(docs)
    own = F.when(F.col("root").isNull(), F.struct("doc_id", "th"))
    stays = found.groupBy("root", own.alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k")).select("k.doc_id", "k.th").distinct()
    mine = wrapped(docs).withColumn("hash", F.xxhash64("text")).alias("m")
    kept = mine.join(stays.alias("s"), F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("m.hash") == F.col("s.th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "hash"]).select("row.*")


#: The same by brute force: shingle sets joined on every shingle, classes by a recursive walk.
ORACLE = r"""
with recursive w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
s as (
  select distinct r, array_to_string(list_slice(words, i, i + 4), ' ') as shingle
  from (select r, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) as i from w where len(words) > 0)),
n as (select r, count(*) as n from s group by r),
p as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.r < b.r group by a.r, b.r),
l as (select x, y from p join n a on a.r = x join n b on b.r = y where 9 * c >= 4 * (a.n + b.n)),
e as (select x, y from l union all select y, x from l),
k as (select r, r as c from w union select e.y, k.c from k join e on e.x = k.r),
g as (select k.r, min(doc_id) as class_id from k join w on w.r = k.c group by k.r)
select doc_id, class_id, (select count(*) from e where e.x = w.r)::bigint as n_links, coalesce(n, 0)::int as n_shingles
from w join g using (r) left join n using (r)
"""
