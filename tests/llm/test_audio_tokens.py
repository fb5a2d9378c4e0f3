"""Audio store and features; token counts against the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from patchweave.llm import audio, transducer

public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("byte_bpe_50k.json"))


def plain_features(payload):
    """Log-mel frames and frame energies straight from their definition, frame by frame."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    m = 16  # the low-pass has 16 taps on each side
    t = np.arange(-m, m + 1)
    h = np.sinc(t / 2) * np.hamming(2 * m + 1)
    h /= h.sum()
    y = np.convolve(x, h)[m : m + len(x) : 2]
    n = 1 + max(0, -(-(len(y) - 200) // 80))
    y = np.concatenate([y, np.zeros(200 + 80 * n)])
    # beyond the end the low-pass still sees the signal's last samples
    tail = np.convolve(x, h)[m :: 2]
    y[: len(tail)] = tail
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), 34) / 2595) - 1)
    f = np.arange(129) * 8000 / 256
    out, energy = [], []
    for k in range(n):
        cut = y[80 * k : 80 * k + 200] * np.hanning(200)
        power = np.abs(np.fft.rfft(cut, 256)) ** 2
        out.append([10 * np.log10(1e-6 + sum(p * max(0, min((q - edge[j]) / (edge[j + 1] - edge[j]), (edge[j + 2] - q) / (edge[j + 2] - edge[j + 1]))) for p, q in zip(power, f))) for j in range(32)])
        energy.append(round(float(10 * np.log10((cut * cut).mean() + 1e-6)), 2))
    return 100 * np.array(out), energy


def plain_spans(energy):
    mean, on, start, out = sum(energy) / len(energy), False, 0, []
    for i, e in enumerate(energy):
        if not on and e > mean + 1:
            on, start = True, i
        elif on and e < mean - 1:
            on = False
            out.append((start * 10.0, i * 10.0))
    return out + [(start * 10.0, len(energy) * 10.0)] * on


def test_store_is_lossless_and_equal_texts_agree(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "é" * 500), (5, "x" * 192), (6, "abc"), (None, "z" * 30_000), (7, "".join(chr(32 + i * i % 90) * (1 + i % 400) for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", audio.F.lit(1))
    stored = audio.store_features(audio.store_media(docs))
    got = {r.doc_id: r for r in audio.audio_features(stored).collect()}
    tensors = {r.doc_id: r.tensors for r in stored.collect()}
    for d, t in rows:
        raw = (t or "").encode()
        pad = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-16:]) and r.media_bytes == len(pad) + 44
        frames = audio.from_tensors(tensors[d])
        mels, energy = plain_features(pad)
        assert frames.shape == (r.n_frames, audio.MELS) and np.abs(frames - mels).max() <= 2  # hundredths of a dB
        assert [(x.start_ms, x.end_ms) for x in r.segments] == plain_spans(energy)
        t = audio.pa.ipc.open_stream(tensors[d]).read_all()
        assert t.schema.field("log_mel").type == audio.pa.fixed_shape_tensor(audio.pa.int16(), [64, 32])
        assert t.column("start_ms").to_pylist() == [640.0 * i for i in range(t.num_rows)]
        last = (r.n_frames - 1) * 10.0 + 25.0
        assert t.column("end_ms").to_pylist() == [min(640.0 * i + 655.0, last) for i in range(t.num_rows)]
    assert got[1].feature == got[6].feature and got[2].feature == got[3].feature and got[1].feature != got[4].feature
    assert audio.audio_features(audio.store_features(audio.store_media(docs.limit(0)))).count() == 0


def test_resampling_by_blocks_and_against_direct_filter():
    x = np.random.default_rng(1).normal(size=3000).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 1)):
        n = len(x) * up // down
        whole = audio.resample(x, up, down, 0, n)
        parts = np.concatenate([audio.resample(x, up, down, i, min(i + 700, n)) for i in range(0, n, 700)])
        assert np.allclose(whole, parts, atol=1e-5)
        bank, delay = audio._phases(up, down)
        h = bank[:, ::-1].T.ravel()
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        assert np.allclose(whole, np.convolve(wide, h)[delay :: down][:n], atol=1e-4)


def test_tone_and_segments():
    t = np.arange(16_000) / 16_000
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t) * (t > 0.5)).astype(np.uint8).tobytes()
    mels, energy = audio.log_mel(tone)
    peak = mels[-20:].mean(0).argmax()
    centre = 700 * (10 ** ((peak + 1) * 2595 * np.log10(1 + 4000 / 700) / (audio.MELS + 1) / 2595) - 1)
    assert abs(centre - 1000) < 150
    (s, e), = audio.segments(energy)
    assert abs(s - 49) <= 3 and e == len(energy)


def test_counts_against_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    r = random.Random(3)
    parts = ["a", "the", "'s", "'ll", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "!", "?!", "123", "²", "漢字", "😀", "\x1c", "\x85", "́", "ing", "tion", "\r\n", "\0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800)] + ["x" * 3000, " " * 500]
    c = transducer.counter(PATH)
    for chunk in (1, 2, 5, 1 << 16):
        assert [c.count(t, chunk) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (4, " x" * 600)], "doc_id long, text string").withColumn("n_tokens", transducer.pa and audio.F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.token_counts(docs, PATH, chunk=64).collect()}
    assert got == {1: (3, 2, False), 2: (0, 0, False), None: (0, 0, False), 4: (1200, 600, True)}


def test_scan_is_a_prefix_scan():
    c = transducer.counter(PATH)
    text = "It's the end, of  the\nworld 12 34!! " * 9
    maps = [c.chunk_map(text[i : i + 7]) for i in range(0, len(text), 7)]
    step = []
    for m in maps:
        step.append(m if not step else c.compose(step[-1], m))
    total = lambda m: c.plain(m.head) + (0 if m.whole else m.tokens + c.plain(m.tail))
    assert [total(m) for m in c.scan(maps)] == [total(m) for m in step] == [c.plain(text[: i + 7]) for i in range(0, len(text), 7)]
