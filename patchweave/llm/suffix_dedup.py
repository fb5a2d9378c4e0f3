"""Suffix-array deduplication of byte strings of 100 bytes, by hash-compared suffix sort.

A byte goes if a 100-byte string that covers it also starts earlier. Sorting the suffixes of the whole corpus at once
would shuffle every position, so the corpus is first cut at content-defined anchors: the leftmost smallest hash of a
32-byte gram among the 69 in a window. Equal windows have equal anchors at equal places, so every window belongs to
exactly one anchor, and the windows of one anchor in one document are a run, its region.

1. Each task finds anchors and regions, and settles regions it has met before itself, byte by byte (pre-aggregation).
2. Regions are dealt by anchor. An anchor with one region is done. A region whose hash an earlier one has claims to
   repeat it; claims of neighbouring regions on neighbouring places join, their bytes are sent to the earlier document
   and compared there. Should one be false, hashes have collided and step 3 takes all regions of repeated anchors.
3. Of an anchor's distinct regions, the edges of repeated passages, the bytes are dealt by anchor, and the suffixes that
   start at the anchors are sorted: bottom-up mergesort whose comparisons find the longest common extension by binary
   search over prefix polynomial hashes, then verify it on the bytes. Windows are equal where right extensions share a
   run of the suffix order and left extensions are equal, which is hash-compared and verified as well.
4. Removed spans are applied to the documents.

Equal bytes have equal hashes, so hashes only choose what is compared; no byte is removed on a hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchweave.llm.common import gathered, map_arrow, pick, stage

LENGTH = 100
GRAM = 32
#: Grams in a window; their offsets fit the low bits of a packed hash.
SPAN = LENGTH - GRAM + 1
LOW = np.uint64(127)
#: Regions of one anchor up to which its windows are compared in one task; beyond it each window is dealt by its own hash.
HOT_REGIONS = 4096
#: Window starts that are looked at together in a long text.
BLOCK = 1 << 20
#: Contexts that are sorted together, if their groups allow.
CONTEXTS = 8192
#: Texts, and bytes of them, whose regions are settled together.
TEXTS, TEXT_BYTES = 1 << 16, 8 << 20
#: Bytes that are compared in one step.
COMPARED = 1 << 20
#: Stands for a null id in the order of documents.
NO_ID = (1 << 63) - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_TABLE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_power_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; one growing table a process."""
    if len(_power_tables[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _power_tables[k] = np.multiply.accumulate(p, out=p)
    return _power_tables


class PrefixHashes:
    """Polynomial hashes of all substrings of a byte array, from one prefix array."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(12, int(len(data)).bit_length())
        powers, self.inverse = _powers(n)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = _TABLE[data]
    n, p = 1, _BASE
    while n < GRAM:
        h = h[:-n] * np.uint64(p) + h[n:]
        p = p * p % (1 << 64)
        n *= 2
    return _avalanche(h)


def regions(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions of one text: anchor hash, region hash, first window start, anchor's offset from it, windows."""
    parts = []
    last = len(data) - LENGTH  # the last window's start
    for at in range(0, last + 1, BLOCK):
        parts.append(_regions(data[at : min(at + BLOCK, last + 1) + LENGTH - 1], at))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _regions(data: np.ndarray, at: int):
    h = _gram_hashes(data)
    packed = h & ~LOW
    n = 1
    v = packed
    while n * 2 <= SPAN:
        v = np.minimum(v[:-n], v[n:] + np.uint64(n))
        n *= 2
    if n < SPAN:
        v = np.minimum(v[: len(v) - (SPAN - n)], v[SPAN - n :] + np.uint64(SPAN - n))
    pos = np.arange(len(v)) + (v & LOW).astype(np.int64)  # anchor of each window
    start = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    windows = np.diff(np.append(start, len(v)))
    anchor = pos[start]
    whole = PrefixHashes(data).of(start, windows + LENGTH - 1)
    return h[anchor], _avalanche(whole + _MIX * windows.astype(np.uint64)), start + at, anchor - start, windows


#: ``w`` packs start, lead, windows and done, as small columns cost much in a shuffle of many rows.
REGION_SCHEMA = "k long, r long, doc long, th long, w long"


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each row begins, with the end of the last."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a : a + length] and data[b : b + length] are equal, many at a time."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    at = np.arange(int(length.max()))
    top = len(data) - 1
    step = max(1, COMPARED // max(len(at), 1))
    for i in range(0, len(a), step):
        t = slice(i, i + step)
        same = data[np.minimum(a[t, None] + at, top)] == data[np.minimum(b[t, None] + at, top)]
        out[t] = (same | (at >= length[t, None])).all(1)
    return out


def _region_rows(batches: Iterator[pa.RecordBatch], bits: int = 64) -> Iterator[pa.RecordBatch]:
    """Regions of each text. A region met before in the same batch comes back as done and is dealt by its document.

    Hashes of regions have the low ``bits`` only (tests let them collide).
    """
    for batch in gathered(batches, TEXTS, TEXT_BYTES):
        doc, th, text = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        order = np.lexsort((th, doc))
        found, owner = [], []
        for i in order.tolist():
            raw = text[i].as_buffer()
            if raw is not None and raw.size >= LENGTH:
                found.append(regions(np.frombuffer(raw, np.uint8)))
                owner.append(np.full(len(found[-1][0]), i))
        if not found:
            continue
        a, r, start, lead, windows = (np.concatenate(x) for x in zip(*found, strict=True))
        own = np.concatenate(owner)
        r = r & np.uint64((1 << bits) - 1)
        # Rows are in order of document and start here, so the first of equal regions is the earliest. Equal rows of one
        # document (doc, th) are one document: their regions all count as first.
        by = np.lexsort((np.arange(len(a)), r, a))
        same = np.zeros(len(a), bool)
        same[1:] = (a[by][1:] == a[by][:-1]) & (r[by][1:] == r[by][:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
        first = by[head]
        twin = (doc[own[by]] == doc[own[first]]) & (th[own[by]] == th[own[first]]) & (start[by] == start[first])
        found_before = np.flatnonzero(same & ~twin)
        data, text_at = bytes_of(text)
        mine, other = by[found_before], first[found_before]
        ok = (windows[mine] == windows[other]) & equal_bytes(data, text_at[own[mine]] + start[mine], text_at[own[other]] + start[other], windows[mine] + LENGTH - 1)
        done = np.zeros(len(a), bool)
        done[mine[ok]] = True
        key = np.where(done, _avalanche(th[own].astype(np.uint64) + start.astype(np.uint64)), a)
        for i in range(0, len(a), 65536):
            s = slice(i, i + 65536)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[s].astype(np.int64)), pa.array(r[s].astype(np.int64)), pa.array(doc[own[s]]), pa.array(th[own[s]]),
                    pa.array((start[s] << 16 | lead[s] << 9 | windows[s] << 1 | done[s]).astype(np.int64)),
                ],
                ["k", "r", "doc", "th", "w"],
            )


CONTEXT_SCHEMA = "k long, r long, doc long, th long, start int, lead int, windows int, bytes binary"
_CONTEXT_NAMES = ["k", "r", "doc", "th", "start", "lead", "windows", "bytes"]


def _gather(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces data[at : at + length] in one array, and where each begins, with the end of the last."""
    stop = np.concatenate(([0], np.cumsum(length)))
    return data[np.repeat(at - stop[:-1], length) + np.arange(stop[-1])], stop


def _context_batch(k, r, doc, th, start, lead, windows, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Contexts with their bytes, data[at : at + windows + 99]."""
    cut, stop = _gather(data, at, windows + LENGTH - 1)
    raw = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(cut)])
    whole = [pa.array(np.ascontiguousarray(x, np.int64)) for x in (k, r, doc, th)]
    return pa.RecordBatch.from_arrays([*whole, *[pa.array(np.ascontiguousarray(x, np.int32)) for x in (start, lead, windows)], raw], _CONTEXT_NAMES)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the regions listed with each document; a hot anchor's windows one by one, dealt by their own hash."""
    for batch in batches:
        data, text_at = bytes_of(batch.column(2))
        lists = batch.column(3)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        edges = lists.flatten()
        k, r, start, lead, windows, hot = (edges.field(f).to_numpy(zero_copy_only=False) for f in ("k", "r", "start", "lead", "windows", "hot"))
        start, lead, windows = (x.astype(np.int64) for x in (start, lead, windows))
        doc, th = (batch.column(c).to_numpy()[owner] for c in (0, 1))
        at = text_at[:-1][owner] + start
        cool = np.flatnonzero(~hot)
        for i in range(0, len(cool), CONTEXTS):
            c = cool[i : i + CONTEXTS]
            yield _context_batch(k[c], r[c], doc[c], th[c], start[c], lead[c], windows[c], data, at[c])
        warm = np.flatnonzero(hot)
        for i in range(0, len(warm), CONTEXTS // 32):
            c = warm[i : i + CONTEXTS // 32]
            seen, stop = _gather(data, at[c], windows[c] + LENGTH - 1)
            n = windows[c]
            e = np.repeat(np.arange(len(c)), n)  # the context of each window
            j = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
            own = _avalanche(PrefixHashes(seen).of(stop[:-1][e] + j, np.full(len(e), LENGTH))).astype(np.int64)
            one = np.ones(len(e), np.int64)
            yield _context_batch(own, own, doc[c][e], th[c][e], start[c][e] + j, one - 1, one, seen, stop[:-1][e] + j)


#: Bytes after which a claim of repeated bytes ends and the next begins, and bytes of claims that are sent together.
CLAIM, CLAIMS = 1 << 16, 1 << 20
CLAIM_SCHEMA = "doc long, th long, start int, stop int, doc0 long, th0 long, start0 int, bytes binary"


def _claim_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans that each document claims to repeat; equal rows of one document claim once."""
    names = [c.split(" ")[0] for c in CLAIM_SCHEMA.split(", ")]
    told: set[tuple[int, int]] = set()
    for batch in batches:
        data, text_at = bytes_of(batch.column(2))
        lists = batch.column(3)
        ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        new = np.zeros(len(ids), bool)
        for i, x in enumerate(ids):
            new[i] = x not in told
            told.add(x)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        claims = lists.flatten()
        start, windows, doc0, th0, start0 = (claims.field(f).to_numpy() for f in ("start", "windows", "doc0", "th0", "start0"))
        by = np.lexsort((start, owner))
        by = by[new[owner[by]]]
        if not len(by):
            continue
        owner, start, windows, doc0, th0, start0 = (x[by].astype(np.int64) for x in (owner, start, windows, doc0, th0, start0))
        # neighbours that claim neighbouring places
        goes_on = (owner[1:] == owner[:-1]) & (doc0[1:] == doc0[:-1]) & (th0[1:] == th0[:-1]) & (start[1:] - start[:-1] == start0[1:] - start0[:-1])
        goes_on &= (start[1:] == start[:-1] + windows[:-1]) & (start[1:] // CLAIM == start[:-1] // CLAIM)
        head = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        tail = np.append(head[1:], len(by)) - 1
        length = start[tail] + windows[tail] + LENGTH - 1 - start[head]
        run = np.cumsum(length)
        cuts = [0, *(np.flatnonzero(np.diff(run // CLAIMS)) + 1).tolist(), len(head)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            h, n = head[a:z], length[a:z]
            seen, stop = _gather(data, text_at[:-1][owner[h]] + start[h], n)
            raw = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(seen)])
            doc, th = (batch.column(c).to_numpy()[owner[h]] for c in (0, 1))
            whole = [pa.array(x, k) for x, k in zip((doc, th, start[h], start[h] + n, doc0[h], th0[h], start0[h]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*whole, raw], names)


class SuffixSorter:
    """Sorts suffixes data[start : start + length] within groups by mergesort; comparisons use prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: PrefixHashes | None = None):
        self.data, self.start, self.length = data, start, length
        self.hashes = hashes or PrefixHashes(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes i and j: binary search on hash equality, then verified on the bytes."""
        lo = np.zeros(len(i), np.int64)
        hi = np.minimum(self.length[i], self.length[j])
        a, b = self.start[i], self.start[j]
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi + 1) >> 1, lo)
            eq = self.hashes.of(a, mid) == self.hashes.of(b, mid)
            lo = np.where(open_ & eq, mid, lo)
            hi = np.where(open_ & ~eq, mid - 1, hi)
        return self._verified(a, b, lo)

    def _verified(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Shortens an extension to its first differing byte, should hashes have collided."""
        if not len(a):
            return length
        most = int(length.max())
        step = max(1, (1 << 19) // max(most, 1))
        at = np.arange(most)
        out = length.copy()
        for s in range(0, len(a), step):
            t = slice(s, s + step)
            inside = at[None, :] < length[t, None]
            top = len(self.data) - 1
            wrong = inside & (self.data[np.minimum(a[t, None] + at, top)] != self.data[np.minimum(b[t, None] + at, top)])
            bad = wrong.any(1)
            if bad.any():
                out[t] = np.where(bad, wrong.argmax(1), out[t])
        return out

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0, 1 as suffix i sorts before, with or after j."""
        n = self.common(i, j)
        end_i, end_j = n >= self.length[i], n >= self.length[j]
        top = len(self.data) - 1
        x = self.data[np.minimum(self.start[i] + n, top)].astype(np.int16)
        y = self.data[np.minimum(self.start[j] + n, top)].astype(np.int16)
        return np.where(end_i | end_j, end_j.astype(np.int8) - end_i.astype(np.int8), np.sign(x - y))

    def sort(self, group_start: np.ndarray, group_size: np.ndarray) -> np.ndarray:
        """Order of all suffixes; groups are contiguous and stay so. Stable."""
        n = len(self.start)
        order = np.arange(n)
        base = np.repeat(group_start, group_size)
        size = np.repeat(group_size, group_size)
        at = np.arange(n) - base
        width = 1
        while width < (int(group_size.max()) if n else 0):
            live = np.flatnonzero(size > width)  # groups that still have more than one run
            run, inside = at[live] // width, at[live] % width
            left = run % 2 == 0
            other = base[live] + np.where(left, run + 1, run - 1) * width
            stop = np.minimum(other + width, base[live] + size[live])
            lo = np.zeros(len(live), np.int64)
            hi = np.maximum(stop - other, 0)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                c = self.before(order[live[open_]], order[other[open_] + mid])
                # an element of the left run goes before equal ones of the right run
                goes_on = np.where(left[open_], c > 0, c >= 0)
                lo[open_] = np.where(goes_on, mid + 1, lo[open_])
                hi[open_] = np.where(goes_on, hi[open_], mid)
            place = base[live] + (run // 2) * 2 * width + inside + lo
            merged = order.copy()
            merged[place] = order[live]
            order = merged
            width *= 2
        return order


def repeated_windows(k, doc, th, start, lead, windows, data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For contexts sorted by k: a matrix row each with True at windows that an earlier context of the same k also has.

    Column d of the result is the window that starts d bytes before the anchor. ``offset`` says where each context's
    bytes begin in ``data``; they run for windows + 99 bytes.
    """
    n = len(k)
    hashes = PrefixHashes(data)
    anchor = offset + lead
    right = offset + windows + LENGTH - 1 - anchor
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.append(head, n))
    sorter = SuffixSorter(data, anchor, np.minimum(right, LENGTH), hashes)
    order = sorter.sort(head, sizes)
    shared = np.full(n, -1, np.int64)  # common extension with the suffix before, -1 at a group's first
    inner = np.setdiff1d(np.arange(n), head, assume_unique=True)
    if len(inner):
        shared[inner] = sorter.common(order[inner - 1], order[inner])
    rank = np.empty(n, np.int64)  # place by (document, start): the earliest of equal windows stays
    rank[np.lexsort((start + lead, th, doc))] = np.arange(n)
    out = np.zeros((n, SPAN), bool)
    for d in range(SPAN):
        run = np.cumsum(shared < LENGTH - d)
        mine = (lead[order] >= d) & (d > lead[order] - windows[order])
        i = order[mine]
        if len(i) < 2:
            continue
        left = hashes.of(anchor[i] - d, np.full(len(i), d))
        by = np.lexsort((rank[i], left, run[mine]))
        j = i[by]
        same = (run[mine][by][1:] == run[mine][by][:-1]) & (left[by][1:] == left[by][:-1])
        if d and same.any():
            p = np.flatnonzero(same)
            ok = sorter._verified(anchor[j[p]] - d, anchor[j[p + 1]] - d, np.full(len(p), d)) == d
            same[p] = ok
        first = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(j)), 0))
        f = j[first]
        again = (doc[j] != doc[f]) | (th[j] != th[f]) | (start[j] + lead[j] != start[f] + lead[f])
        out[j[again], d] = True
    return out


SPAN_SCHEMA = "doc long, th long, start int, stop int"


def _span_batch(doc, th, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc", "th", "start", "stop"])


def _edge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one partition's contexts, sorted by k, r, doc, th and start.

    Contexts that equal the first of their (k, r) are told at once and not kept, so any number of them may come. The
    distinct ones of an anchor are taken together, those of many anchors at a time.
    """
    first: pa.RecordBatch | None = None
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in gathered(batches, CONTEXTS, TEXT_BYTES):
        t = batch if first is None else pa.concat_batches([first, batch])
        k, r, doc, th, start, lead, windows = (t.column(c).to_numpy().astype(np.int64) for c in range(7))
        data, at = bytes_of(t.column(7))
        opens = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
        head = np.maximum.accumulate(np.where(opens, np.arange(len(k)), 0))
        i = np.flatnonzero(~opens)
        h = head[i]
        i, h = (x[(windows[i] == windows[h]) & (lead[i] == lead[h])] for x in (i, h))
        ok = equal_bytes(data, at[i], at[h], windows[i] + LENGTH - 1)
        i, h = i[ok], h[ok]
        # Equal rows of one document bring equal contexts; those count as one occurrence.
        again = i[(doc[i] != doc[h]) | (th[i] != th[h]) | (start[i] != start[h])]
        if len(again):
            yield _span_batch(doc[again], th[again], start[again], start[again] + windows[again] + LENGTH - 1)
        new = np.ones(len(k), bool)
        new[i] = False
        new[0] = first is None
        first = t.slice(int(head[-1]), 1)
        held.append(t.filter(pa.array(new)))
        rows += held[-1].num_rows
        if rows < CONTEXTS:
            continue
        table = pa.concat_batches(held)
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, k[-1]))  # the last group may go on
        yield from _spans(table.slice(0, cut))
        held, rows = [table.slice(cut)], len(keys) - cut
    if rows:
        yield from _spans(pa.concat_batches(held))


def _spans(contexts: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that distinct contexts of one anchor share."""
    if not contexts.num_rows:
        return
    k = contexts.column(0).to_numpy()
    same = np.concatenate(([False], k[1:] == k[:-1], [False]))
    contexts = contexts.filter(pa.array(same[1:] | same[:-1]))
    if not contexts.num_rows:
        return
    k, _, doc, th, start, lead, windows = (contexts.column(c).to_numpy().astype(np.int64) for c in range(7))
    data, offset = bytes_of(contexts.column(7))
    again = repeated_windows(k, doc, th, start, lead, windows, data, offset[:-1])
    i, d = np.nonzero(again)
    if not len(i):
        return
    at = start[i] + lead[i] - d
    by = np.lexsort((at, i))
    i, at = i[by], at[by]
    head = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (at[1:] != at[:-1] + 1))))
    tail = np.append(head[1:], len(i)) - 1
    yield _span_batch(doc[i[head]], th[i[head]], at[head], at[tail] + LENGTH)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union; spans that touch are one run."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,stop:int>>"


def _apply(with_kept: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                runs = merged(spans)
                kept, at = [], 0
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                rows.append((None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_kept else None, [{"start": s, "stop": e} for s, e in runs]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return apply


def _marked(base: DataFrame, hot_regions: int, bits: int) -> DataFrame:
    """Regions with what their anchor and hash tell: the first region of the hash, whether it is another, and how many there are."""
    by_region = Window.partitionBy("done", "k", "r").orderBy("doc", "th", "start")
    by_anchor = Window.partitionBy("done", "k")
    # One exchange by k serves all windows.
    w = F.col("w")
    return (
        base.transform(map_arrow, lambda batches: _region_rows(batches, bits), REGION_SCHEMA)
        .repartition("k")
        .select(
            "k", "r", "doc", "th", F.shiftright(w, 16).cast("int").alias("start"), w.bitwiseAND(0xFFFF).cast("int").alias("low"), (w.bitwiseAND(1) == 1).alias("done")
        )
        .select("k", "r", "doc", "th", "start", F.shiftright("low", 9).alias("lead"), F.shiftright("low", 1).bitwiseAND(0xFF).alias("windows"), "done")
        .withColumn("first", F.first(F.struct("doc", "th", "start")).over(by_region))
        .withColumn("again", (F.struct("doc", "th", "start") != F.col("first")) & ~F.col("done"))
        .withColumn("n", F.count("*").over(by_anchor))
        .withColumn("differs", F.min("r").over(by_anchor) != F.max("r").over(by_anchor))
        .where("done or n > 1")
        .withColumn("hot", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(by_anchor) > hot_regions)
    )


def _per_document(marked: DataFrame, claims: bool) -> DataFrame:
    """doc, th, spans that are settled, claims, and edges; without ``claims`` all regions of repeated anchors are edges."""
    span = F.struct("start", (F.col("start") + F.col("windows") + (LENGTH - 1)).cast("int").alias("stop"))
    claim = F.struct("start", "windows", F.col("first.doc").alias("doc0"), F.col("first.th").alias("th0"), F.col("first.start").alias("start0"))
    edge = F.struct("k", "r", "start", "lead", "windows", "hot")
    wanted = marked.where("done or again or differs") if claims else marked
    is_claim = F.col("again") if claims else F.lit(False)
    return stage(
        wanted.groupBy("doc", "th").agg(
            F.collect_list(F.when(F.col("done"), span)).alias("spans"),
            F.collect_set(F.when(is_claim, claim)).alias("claims"),
            F.collect_set(F.when(~F.col("done") & ~is_claim, edge)).alias("edges"),
        ),
        "repeat-regions",
    )


def _verified(base: DataFrame, per_doc: DataFrame) -> DataFrame:
    """doc, th, start, stop, same: each joined claim, and whether the earlier document has these bytes at that place."""
    mine = per_doc.where(F.size("claims") > 0).select("doc", "th", "claims").hint("shuffle_hash")
    rows = base.join(mine, ["doc", "th"]).select("doc", "th", "raw", "claims").transform(map_arrow, _claim_rows, CLAIM_SCHEMA)
    old = base.select(F.col("doc").alias("doc0"), F.col("th").alias("th0"), "raw")
    same = F.expr("substring(raw, start0 + 1, octet_length(bytes)) = bytes").alias("same")
    return stage(old.join(rows.hint("shuffle_hash"), ["doc0", "th0"]).select("doc", "th", "start", "stop", same), "verified-claims")


def remove_repeats(docs: DataFrame, with_kept: bool = False, hot_regions: int = HOT_REGIONS, bits: int = 64) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (if asked for), spans.

    Order is by doc_id, then position; rows without an id come after all others. Null and empty texts have no bytes;
    texts under 100 bytes keep all. Rows of one id with different texts are ordered by a hash of the text; rows of one
    id with equal texts are one document and get equal results. Very long texts are worked on in blocks. An empty table
    gives no rows; extra columns are ignored.
    """
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    # One exchange of the texts by document serves all joins below.
    base = pick(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), raw.alias("raw"))
    marked = _marked(base, hot_regions, bits)
    per_doc = _per_document(marked, claims=True)
    repeats = _verified(base, per_doc)
    if repeats.where("not same").limit(1).count():
        per_doc = _per_document(marked, claims=False)
        repeats = repeats.limit(0)
    edges = per_doc.where(F.size("edges") > 0).select("doc", "th", "edges").hint("shuffle_hash")
    contexts = base.join(edges, ["doc", "th"]).select("doc", "th", "raw", "edges").transform(map_arrow, _context_rows, CONTEXT_SCHEMA)
    found = contexts.repartition("k").sortWithinPartitions("k", "r", "doc", "th", "start").transform(map_arrow, _edge_spans, SPAN_SCHEMA)
    more = repeats.select("doc", "th", "start", "stop").unionByName(found).select("doc", "th", F.array(F.struct("start", "stop")).alias("spans"))
    spans = per_doc.select("doc", "th", "spans").unionByName(more).groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return base.join(spans.hint("shuffle_hash"), ["doc", "th"], "left").select("doc", "raw", "spans").transform(map_arrow, _apply(with_kept), RESULT_SCHEMA)


#: The same by brute force over every 100-byte string, two hexadecimal digits a byte.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, length(h) // 2 as n from d),
w as (select doc_id, p, substr(h, 2 * p - 1, 200) as s from (select doc_id, h, unnest(generate_series(1, n - 99)) as p from n where n >= 100)),
f as (select s, min(doc_id * 4294967296 + p) as first_at from w group by s),
dup as (select doc_id, p from w join f using (s) where doc_id * 4294967296 + p > first_at),
pos as (select doc_id, substr(h, 2 * p - 1, 2) as b, p from (select doc_id, h, unnest(generate_series(1, n)) as p from n)),
m as (select pos.doc_id, pos.p, b, max(dup.p) over (partition by pos.doc_id order by pos.p) as last_at from pos left join dup on pos.doc_id = dup.doc_id and pos.p = dup.p),
k as (select doc_id, p, b, coalesce(p - last_at < 100, false) as gone from m),
r as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as opens from k),
g as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, coalesce(string_agg(b, '' order by p) filter (not gone), '') as kept from r group by doc_id)
select n.doc_id, n.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from n left join g using (doc_id)
"""
