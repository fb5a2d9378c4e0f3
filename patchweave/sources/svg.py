"""Outlines: path data to closed curves of cubic Bezier pieces and back, evaluation, planar maps, bounds."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[MmLlHhVvCcZz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def parse_path(d: str) -> list[tuple[bool, np.ndarray]]:
    """(closed, pieces (n, 4, 2)) of each contour; lines become cubics. Commands M L H V C Z in both cases."""
    tokens = _TOKEN.findall(d)
    out: list[tuple[bool, np.ndarray]] = []
    pieces: list[np.ndarray] = []
    at = first = np.zeros(2)
    i, cmd = 0, ""

    def line(to: np.ndarray) -> None:
        pieces.append(np.stack([at, at + (to - at) / 3, at + 2 * (to - at) / 3, to]))

    def close(closed: bool) -> None:
        if pieces:
            out.append((closed, np.array(pieces)))
            pieces.clear()

    while i < len(tokens):
        if tokens[i].isalpha():
            cmd = tokens[i]
            i += 1
        rel = at if cmd.islower() else np.zeros(2)
        c = cmd.upper()
        if c == "Z":
            if np.abs(at - first).max() > 0:
                line(first)
            close(True)
            at = first
            continue
        if not cmd:
            raise ValueError("path data starts without a command")
        n = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6}[c]
        v = np.array([float(t) for t in tokens[i : i + n]])
        i += n
        if c == "M":
            close(False)
            at = first = v + rel
            cmd = "l" if cmd == "m" else "L"
        elif c == "C":
            p = v.reshape(3, 2) + rel
            pieces.append(np.concatenate([at[None], p]))
            at = p[2]
        else:
            to = v + rel if c == "L" else np.array([v[0] + rel[0], at[1]]) if c == "H" else np.array([at[0], v[0] + rel[1]])
            line(to)
            at = to
    close(False)
    return out


def format_path(contours: list[tuple[bool, np.ndarray]], digits: int = 4) -> str:
    num = lambda x: f"{x:.{digits}f}".rstrip("0").rstrip(".") or "0"
    pt = lambda p: f"{num(p[0])} {num(p[1])}"
    parts = []
    for closed, pieces in contours:
        parts.append("M" + pt(pieces[0, 0]) + "".join("C" + " ".join(pt(q) for q in p[1:]) for p in pieces) + ("Z" if closed else ""))
    return "".join(parts)


def paths_of(svg: str) -> list[str]:
    return re.findall(r"<path\b[^>]*?\bd\s*=\s*[\"']([^\"']*)[\"']", svg)


def document(paths: list[str], width: float, height: float) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">' + "".join(f'<path d="{p}"/>' for p in paths) + "</svg>"


def evaluate(pieces: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Points (n, len(t), 2) of cubic pieces."""
    t = np.asarray(t, float)
    b = np.stack([(1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3], 1)
    return np.einsum("tk,nkd->ntd", b, pieces)


def transform(contours: list[tuple[bool, np.ndarray]], m: np.ndarray) -> list[tuple[bool, np.ndarray]]:
    """Control points under a 3x3 matrix; exact for affine maps."""
    out = []
    for closed, p in contours:
        q = np.concatenate([p, np.ones_like(p[..., :1])], -1) @ m.T
        out.append((closed, q[..., :2] / q[..., 2:]))
    return out


def rotation(angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])


def scaling(x: float, y: float) -> np.ndarray:
    return np.diag([x, y, 1.0])


def shear(x: float, y: float) -> np.ndarray:
    return np.array([[1, x, 0], [y, 1, 0], [0, 0, 1.0]])


def mirror(horizontal: bool) -> np.ndarray:
    return np.diag([-1.0, 1.0, 1.0] if horizontal else [1.0, -1.0, 1.0])


def bezier_point(p: list[Column], t: Column) -> Column:
    """One coordinate of a cubic from its four control values, in generated code."""
    u = 1 - t
    return p[0] * u * u * u + p[1] * 3 * t * u * u + p[2] * 3 * t * t * u + p[3] * F.pow(t, 3)
