"""Re-Pair output: encoder against the library, exact round trip, start offsets and checksums."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from patchweave.llm import repair

public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("word_bpe_49k.json"))
PARTS = ["the", "The", "THE", "word.", "word,", "?!.", "x.", "'s", "it's.", "é", "É.", "Σ", "ΣΑΣ.", "ΑΣ", " ", "  ", "\n", "\t", "\x07", "a\x07b", "<|endoftext|>", "<|start", "12.", "1", "漢字。", "😀,", "é", "́x", " ", "\x85", "\x1c", "İ.", "ǅ", "ﬁ.", "..", ".", ",", "a.,"]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_encoder_against_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    enc = repair.Encoder(PATH)
    ts = texts(1, 3000)
    got = [x.tolist() for i in range(0, len(ts), 100) for x in enc.encode_all(pa.array(ts[i : i + 100]))]
    want = [lib.encode(t, add_special_tokens=False).ids for t in ts]
    bad = [(t, g, w) for t, g, w in zip(ts, got, want, strict=True) if g != w]
    assert not bad, bad[:3]


def test_encoder_on_every_code_point():
    enc = repair.Encoder(PATH)
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    for form in ("a{0}B. {0}C, x{0}. ", "E{0}. {0}{0}.\n{0}A"):
        ts = ["".join(form.format(c) for c in points[i : i + 7]) for i in range(0, len(points), 7)]
        want = [x.ids for x in enc.library.encode_batch_fast(ts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode_all(pa.array(ts))] == want


def test_marks_after_a_word_are_looked_up_apart():
    enc = repair.Encoder(PATH)
    enc.encode_all(pa.array(["Als!! réré, $x$$. x's &c.", None, "Ende."]))
    assert set(enc.memo) == {"", "als", "!!", "réré", ",", "$x", "$$.", "x's", ".", "&c", "ende"}


def test_marks_after_a_word_against_library(monkeypatch):
    monkeypatch.setattr(repair, "MEMO", 500)  # words are forgotten on the way
    enc = repair.Encoder(PATH)
    marks = [chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xD7, 0xF7, 0x301, 9, 7)]
    ts = [f"{a}{x}{y}{z}{a}{x} b{y}{x}" for a in ("a", "é", "ÿ", "ß", "e\u0301", "9") for x in marks for y in ["", *marks] for z in (" ", "\n", "\t")]
    want = [x.ids for x in enc.library.encode_batch_fast(ts, add_special_tokens=False)]
    got = [x.tolist() for i in range(0, len(ts), 1000) for x in enc.encode_all(pa.array(ts[i : i + 1000]))]
    bad = [(t, g, w) for t, g, w in zip(ts, got, want, strict=True) if g != w]
    assert not bad, bad[:3]


@pytest.mark.parametrize("top", [1, 2, 1 << 17, (1 << 32) - 1])
def test_frequent_pairs_against_counting(top):
    r = np.random.default_rng(top)
    for n in (0, 1, 3, 4, 50, 3000):
        seq = (top - r.zipf(1.5, n + 1).clip(1, min(top, 90))).astype(np.uint32)
        skip = r.random(n) < 0.1
        for at, skipped in ((None, skip), (np.flatnonzero(~skip).astype(np.int32), None)):
            held = np.arange(n) if at is None else at
            pairs, times, places = repair.frequent_pairs(seq[held], seq[held + 1], 4, at, skipped)
            want = collections.defaultdict(list)
            for i in np.flatnonzero(~skip).tolist():
                want[int(seq[i]), int(seq[i + 1])].append(i)
            got = {(int(p) >> 32 & 0xFFFFFFFF, int(p) & 0xFFFFFFFF): places(np.array([k])).tolist() for k, p in enumerate(pairs)}
            assert got == {p: x for p, x in want.items() if len(x) >= 4}
            assert times.tolist() == [len(x) for x in got.values()]
            assert places(np.arange(len(pairs))).tolist() == [i for x in got.values() for i in x]


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    r = np.random.default_rng(seed)
    docs = [r.zipf(1.5, r.integers(1, 400)).clip(0, 999).astype("<u4") for _ in range(60)]
    docs += [np.full(501, 7, "<u4"), np.array([2], "<u4")]
    row = repair._pack(0, 0, 0, list(range(len(docs))), docs, 1000).to_pylist()[0]
    assert [x.tolist() for _, x in repair.decode(row)] == [x.tolist() for x in docs]
    assert [repair.decode_one(row, i).tolist() for i in (0, 5, 60, 61)] == [docs[i].tolist() for i in (0, 5, 60, 61)]
    assert len(row["seq"]) < sum(map(len, docs)) * 2


@pytest.mark.parametrize("seed", range(3))
def test_no_frequent_pair_is_left(seed):
    r = np.random.default_rng(seed)
    motif = r.integers(0, 70_000, 300)
    docs = [np.concatenate([motif[a : a + 40], r.zipf(1.3, 50).clip(0, 69_999), np.full(r.integers(0, 30), 5)]) for a in r.integers(0, 260, 400)]
    ends = np.concatenate([np.arange(len(x)) == len(x) - 1 for x in docs])
    flat = np.concatenate(docs).astype("<u4")
    seq, rules, size, stops = repair.compress(flat, ends, 70_000)
    last = set(stops.tolist())
    left = collections.Counter((a, b) for i, (a, b) in enumerate(zip(seq.tolist(), seq[1:].tolist(), strict=False)) if i not in last)
    assert max(left.values()) < repair.LEAST
    used = np.bincount(np.concatenate([seq, rules.ravel()]), minlength=70_000 + len(rules))[70_000:]
    assert used.min() > 0 and len(seq) < len(flat) / 2
    assert repair.unplaned(repair.planes(seq), len(seq)).tolist() == seq.tolist() and int(seq.max()) >> 16
    assert repair.Grammar(rules, size, 70_000).expand(seq.astype(np.int64)).tolist() == flat.tolist()
    stop = np.cumsum([len(x) for x in docs])
    ends_of = np.cumsum(np.where(seq < 70_000, 1, size[np.maximum(seq.astype(int) - 70_000, 0)]))
    assert ends_of[stops].tolist() == stop.tolist()


def test_query_against_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts(2, 101))] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", repair.F.lit(1)).repartition(3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.token_output(docs, PATH).collect()}
    at, want = 0, {}
    for d, t in sorted(rows):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    assert repair.token_output(docs.limit(0), PATH).count() == 0
