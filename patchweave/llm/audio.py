"""Audio features of media columns.

Samples are stored as 8-bit PCM in a WAV container. Features come from the stored bytes: polyphase resampling, an
overlapped log-mel filterbank, and energy segmentation with hysteresis. Frames are stored as Arrow fixed-shape tensors
(frames x mels, in hundredths of a dB), each with its time span, in a second table; what a query tells of the features
is read back from there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import map_arrow, pick, stage

SOURCE_RATE, RATE = 16_000, 8_000
WINDOW, HOP, FFT, MELS = 200, 80, 256, 32
#: Frames of a stored tensor.
TENSOR_FRAMES = 64
#: Segments open above the mean energy by OPEN_DB and close below it by CLOSE_DB.
OPEN_DB, CLOSE_DB = 1.0, 1.0
#: A payload is padded with spaces to a positive multiple of this.
PAYLOAD_UNIT = 192
#: Texts that are encoded together.
ROWS = 256
#: Resampled samples that are held at a time.
BLOCK = HOP * 8192


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // PAYLOAD_UNIT)) * PAYLOAD_UNIT - len(text))


def to_wav(payload: bytes, rate: int = SOURCE_RATE) -> bytes:
    """8-bit unsigned mono PCM. The unit of a payload is even, so the data chunk needs no pad byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples), found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def _phases(up: int, down: int, half: int = 8) -> tuple[np.ndarray, int]:
    """Windowed-sinc low-pass, split into ``up`` phases (a row each, reversed for a sliding product), and its delay."""
    m = half * max(up, down)
    t = np.arange(-m, m + 1)
    h = np.sinc(t / max(up, down)) * np.hamming(2 * m + 1)
    h *= up / h.sum()
    taps = -(-len(h) // up)
    h = np.concatenate([h, np.zeros(taps * up - len(h))])
    return np.stack([h[p::up][::-1] for p in range(up)]).astype(np.float32), m


def resample(x: np.ndarray, up: int, down: int, first: int, last: int) -> np.ndarray:
    """Outputs first..last-1 of the signal resampled by up/down; the signal is 0 beyond its ends."""
    bank, delay = _phases(up, down)
    taps = bank.shape[1]
    out = np.zeros(last - first, np.float32)
    place = np.arange(first, last) * down + delay
    phase, newest = place % up, place // up
    for p in np.unique(phase):
        mine = np.flatnonzero(phase == p)
        lo = int(newest[mine[0]]) - taps + 1
        step = int(newest[mine[1]] - newest[mine[0]]) if len(mine) > 1 else 1
        hi = int(newest[mine[-1]]) + 1
        seen = np.zeros(hi - lo, np.float32)
        a, b = max(lo, 0), min(hi, len(x))
        if a < b:
            seen[a - lo : b - lo] = x[a:b]
        out[mine] = np.lib.stride_tricks.sliding_window_view(seen, taps)[::step] @ bank[p]
    return out


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of the transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    up = (f[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1]
    down = (edges[None, 2:] - f[:, None]) / np.diff(edges)[None, 1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: bytes, rate: int = SOURCE_RATE) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies in hundredths of a dB, frame energies in dB rounded to 0.01)."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    g = np.gcd(RATE, rate)
    up, down = int(RATE // g), int(rate // g)
    n = -(-len(x) * up // down)
    frames = 1 + max(0, -(-(n - WINDOW) // HOP))
    window = np.hanning(WINDOW).astype(np.float32)
    mels, energy = [], []
    per = BLOCK // HOP
    for f in range(0, frames, per):
        k = min(per, frames - f)
        y = resample(x, up, down, f * HOP, (f + k - 1) * HOP + WINDOW)
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * window
        power = np.abs(np.fft.rfft(cut, FFT, axis=1)) ** 2
        mels.append(10 * np.log10(power.astype(np.float32) @ mel_bank() + 1e-6))
        energy.append(10 * np.log10((cut * cut).mean(1) + 1e-6))
    return np.round(100 * np.concatenate(mels)).astype(np.int16), np.round(np.concatenate(energy), 2).astype(np.float32)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames: open where energy rises over the upper threshold, closed where it falls under the lower."""
    mean = float(energy.mean(dtype=np.float64)) if len(energy) else 0.0
    mark = np.where(energy > mean + OPEN_DB, 1, np.where(energy < mean - CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate(([False], (last >= 0) & (mark[np.maximum(last, 0)] == 1), [False]))
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def to_tensors(mels: np.ndarray) -> bytes:
    """Arrow IPC stream: start_ms, end_ms, frames, and a fixed-shape tensor of TENSOR_FRAMES x MELS, padded with zeros."""
    n = -(-len(mels) // TENSOR_FRAMES)
    padded = np.zeros((n * TENSOR_FRAMES, MELS), np.int16)
    padded[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.int16(), [TENSOR_FRAMES, MELS])
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), TENSOR_FRAMES * MELS))
    first = np.arange(n) * TENSOR_FRAMES
    count = np.minimum(TENSOR_FRAMES, len(mels) - first)
    ms = 1000 / RATE
    batch = pa.RecordBatch.from_arrays(
        [pa.array(first * HOP * ms), pa.array(((first + count - 1) * HOP + WINDOW) * ms), pa.array(count), tensors], ["start_ms", "end_ms", "frames", "log_mel"]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes | pa.Buffer) -> np.ndarray:
    """Frames x mels of a stored stream, without the padding."""
    t = pa.ipc.open_stream(stored).read_all().combine_chunks()
    flat = t.column("log_mel").combine_chunks().storage.flatten().to_numpy()
    return flat.reshape(-1, MELS)[: int(np.sum(t.column("frames").to_numpy()))]


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as a WAV file in a table of the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            raws = [t.as_py() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raws), pa.int64()), pa.array([to_wav(payload_of(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    raw = pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("raw"))
    return stage(raw.transform(map_arrow, encode, "doc_id long, n_bytes long, media binary"), "media")


_STORED = [(c, pa.int64()) for c in ("doc_id", "n_bytes", "payload_bytes")] + [
    ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()),
    ("segments", pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))), ("tensors", pa.binary()),
]
_STORED_DDL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, "
    "segments array<struct<start_ms:double,end_ms:double>>, tensors binary"
)


def store_features(media: DataFrame) -> DataFrame:
    """Features of stored media (doc_id, n_bytes, media), one row each, in a table of the shared folder.

    ``tensors`` is an Arrow stream of fixed-shape tensors with their time spans, ``segments`` the spans of the energy
    segmentation. Every text gives at least one frame, as a payload is never empty. A null medium is an error of the
    store, and raises. Signals are resampled and transformed in blocks, so memory grows with the frames only.
    """
    frame_ms = 1000 * HOP / RATE

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_STORED)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, n_bytes, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                medium = m.as_py()
                rate, samples = from_wav(medium)
                mels, energy = log_mel(samples, rate)
                spans = [{"start_ms": s * frame_ms, "end_ms": e * frame_ms} for s, e in segments(energy)]
                rows.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), len(mels), spans, to_tensors(mels)))
                if len(rows) >= ROWS:
                    yield _rows(rows, schema)
                    rows = []
            if rows:
                yield _rows(rows, schema)

    return stage(media.select("doc_id", "n_bytes", "media").transform(map_arrow, extract, _STORED_DDL), "audio-features")


def audio_features(stored: DataFrame) -> DataFrame:
    """The stored features, and ``feature``, a digest of the tensors and spans that are read back; equal media give equal ones."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, spans, t in zip(b.column("n_frames").to_pylist(), b.column("segments").to_pylist(), b.column("tensors"), strict=True):
                seen = from_tensors(t.as_buffer())
                if seen.shape != (n, MELS):
                    raise ValueError("stored tensors do not hold the frames that were written")
                h = hashlib.sha256(np.ascontiguousarray(seen, "<i2").tobytes() + repr([(s["start_ms"], s["end_ms"]) for s in spans]).encode())
                out.append(f"{n}x{MELS}:{len(spans)}:{h.hexdigest()[:16]}")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], [*b.schema.names[:-1], "feature"])

    return stored.transform(map_arrow, digest, _STORED_DDL.replace("tensors binary", "feature string"))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
