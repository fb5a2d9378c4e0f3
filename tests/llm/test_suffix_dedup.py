"""Suffix dedup against brute force over all 100-byte strings."""

import hashlib
import random

import pyarrow as pa
import pytest

from patchweave.llm import suffix_dedup as sd


def brute(rows):
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - sd.LENGTH + 1):
            w = raw[s : s + sd.LENGTH]
            if w in seen:
                gone[s : s + sd.LENGTH] = b"\1" * sd.LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False))
        out[rows[i][0]] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(passages)[r.randint(0, 20) :] + t[at:]
        rows.append((i * 3, t))
    rows += [(1000 + i, r.choice(rows)[1]) for i in range(30)]
    near = rows[5][1] + text(80)
    for i in range(40):
        w = near.split(" ")
        w[r.randrange(len(w))] = word()
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000, "a" * 700), (3001, "ab" * 300), (3002, None), (3003, ""), (3004, "x" * 99), (3005, "x" * 100), (3006, "y" + "x" * 100), (None, passages[0])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,bits", [(1, 4096, 64), (2, 3, 64), (3, 4096, 0), (4, 3, 1)])
def test_against_brute_force(spark, seed, hot, bits):
    """With 0 and 1 bits hashes collide and claims are false."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", sd.F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs, hot_regions=hot, bits=bits).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(empty).count() == 0
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, len(t))]


@pytest.mark.parametrize("seed,collide,block,contexts", [(4, True, 1 << 20, 8192), (5, True, 150, 7), (6, False, 150, 3), (7, False, 1 << 20, 1)])
def test_steps_in_one_process(monkeypatch, seed, collide, block, contexts):
    """All hashes of regions collide: nothing may go that the bytes do not prove. Also with texts and groups cut small."""
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "CONTEXTS", contexts)
    rows = sorted(((d, t or "") for d, t in corpus(seed, 50) if d is not None), key=lambda x: x[0])
    texts = {d: t.encode() for d, t in rows}
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([d for d, _ in part]), pa.array([0] * len(part)), pa.array([t.encode() for _, t in part], pa.binary())], ["doc", "th", "raw"])
    spans, found = {d: [] for d in texts}, []
    for part in (rows[:60], rows[60:]):
        for b in sd._region_rows(iter([batch(part)]), 0 if collide else 64):
            for k, r, doc, _, w in zip(*(c.to_pylist() for c in b.columns)):
                start, lead, windows, done = w >> 16, w >> 9 & 127, w >> 1 & 255, w & 1
                if done:
                    spans[doc].append({"start": start, "stop": start + windows + 99})
                else:
                    found.append((k, r, doc, 0, start, lead, windows, texts[doc][start : start + windows + 99]))
    found.sort(key=lambda x: x[:5])
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
    made = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + 50]), kinds)], sd._CONTEXT_NAMES) for i in range(0, len(found), 50)]
    for b in sd._edge_spans(iter(made)):
        for doc, _, start, stop in zip(*(c.to_pylist() for c in b.columns)):
            spans[doc].append({"start": start, "stop": stop})
    want = brute(rows)
    for d, raw in texts.items():
        runs = sd.merged(spans[d])
        assert (sum(e - s for s, e in runs), len(runs)) == want[d][1:3], d
