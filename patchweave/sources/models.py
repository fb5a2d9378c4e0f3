"""Adapters for models that live outside: readers, detectors, vectorisers. Weights are not part of this library; the
classes here are protocols and deterministic stubs for tests."""

from __future__ import annotations

import hashlib
import subprocess
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Reader(ABC):
    """A character reader: characters and uncertainties for a batch of patches."""

    name = "reader"

    def available(self) -> bool:
        return True

    @abstractmethod
    def predict(self, patches: list[bytes]) -> tuple[list[str], list[float]]: ...


class StubReader(Reader):
    """Reads by hash: the same patch always gives the same character. Not a model."""

    name = "stub"

    def __init__(self, alphabet: str = "一二三四五▯"):
        self.alphabet = alphabet

    def predict(self, patches):
        codes = [hashlib.md5(p or b"").digest() for p in patches]
        return [self.alphabet[c[0] % len(self.alphabet)] for c in codes], [c[1] / 255 for c in codes]


class FailingReader(Reader):
    """A reader whose model is not installed."""

    name = "missing"

    def available(self):
        return False

    def predict(self, patches):
        raise RuntimeError("no model")


def available_readers(readers: list[Reader]) -> dict[str, Reader]:
    return {r.name: r for r in readers if r.available()}


def read_patches(df: DataFrame, reader: Reader, column: str = "bin_patch") -> DataFrame:
    """``df`` (id, patch) to (id, char, uncertainty), a batch at a time on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chars, unc = reader.predict(list(b[column]))
            yield pd.DataFrame({"id": b.id, "char": chars, "uncertainty": unc})

    return df.select("id", column).mapInPandas(run, "id long, char string, uncertainty double")


def vectorise(df: DataFrame, command: list[str] | Callable[[bytes], str], column: str = "bin_patch") -> DataFrame:
    """(id, svg, error): each patch through a program (stdin to stdout) or a function; failures are kept, not raised."""

    def one(data: bytes) -> str:
        if callable(command):
            return command(data)
        return subprocess.run(command, input=data, capture_output=True, check=True, timeout=60).stdout.decode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p in zip(b.id, b[column], strict=True):
                try:
                    rows.append((i, one(p), None))
                except Exception as e:
                    rows.append((i, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["id", "svg", "error"])

    return df.select("id", column).mapInPandas(run, "id long, svg string, error string")


def boxes_of_scores(score: np.ndarray, link: np.ndarray, text_cut: float, link_cut: float, low: float) -> list[tuple[int, int, int, int]]:
    """Boxes (left, top, width, height) of pieces of text-or-link pixels that reach ``text_cut`` somewhere."""
    from patchweave.operators.images import label_components

    lab, n = label_components((score > low) | (link > link_cut), diagonal=False)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        if score[y, x].max() >= text_cut:
            out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return out
