"""Column functions: labels, text parsing, boxes, numbers. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label of a glyph nobody could read; null means the same.
UNKNOWN = "▯"
# The three ideograph ranges that count as CJK.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"


def known(label: Column) -> Column:
    return F.coalesce(label, F.lit(UNKNOWN)) != UNKNOWN


def fold_unknown(label: Column) -> Column:
    return F.coalesce(label, F.lit(UNKNOWN))


def consensus(a: Column, b: Column) -> Column:
    """The common label; unknown if they differ or one is missing."""
    return F.when(a == b, a).otherwise(F.lit(UNKNOWN))


def is_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^[{CJK}]"), F.lit(False))


def only_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{CJK}]", "")


def first_char(text: Column) -> Column:
    return F.coalesce(F.substring(F.trim(text), 1, 1), F.lit(""))


def page_of_file(name: Column) -> Column:
    """Number after the last underscore, before the extension; null if there is none."""
    return F.regexp_extract(name, r"_(\d+)\.[^._]*$", 1).try_cast("int")


def round_up(value: Column, multiple: int) -> Column:
    return (F.ceil(value / multiple) * multiple).cast("long")


def scale_ratio(height: Column, width: Column, magnify: float, canvas: float) -> Column:
    longest = F.greatest(height, width)
    return F.least(longest * magnify, F.lit(float(canvas))) / longest


def aspect(major: Column, minor: Column) -> Column:
    return major / F.greatest(minor, F.lit(1.0))


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= 0.8, "high").when(conf >= 0.5, "medium").otherwise("low")


def entropy_terms(p: Column) -> Column:
    """-p log2 p, to be summed."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def hex_channel(colour: Column, k: int) -> Column:
    return F.conv(F.substring(F.ltrim(colour, F.lit("#")), 2 * k + 1, 2), 16, 10).cast("int")


def nlfa_distance(nlfa_ij: Column, nlfa_ji: Column, top: float) -> Column:
    """Symmetrised significance as a distance in 0..top."""
    return F.greatest(F.lit(0.0), F.least(F.lit(top), top - (nlfa_ij + nlfa_ji) / 2))


def robust_weight(r2: Column, kind: str, scale: float = 1.0) -> Column:
    """Weights of squared residuals under the robust error functions of registration."""
    s2 = scale * scale
    return {
        "l2": F.lit(1.0),
        "lorentzian": F.lit(1.0) / (1 + r2 / (2 * s2)),
        "geman_mcclure": F.lit(1.0) / ((1 + r2 / s2) * (1 + r2 / s2)),
        "charbonnier": F.lit(1.0) / F.sqrt(1 + r2 / s2),
    }[kind]


def apply_homography(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """Point under a 3x3 homography, row by row."""
    w = x * h[6] + y * h[7] + h[8]
    return (x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w


#: Words of a reply that are not its content, the fixed values that a reply may repeat from its prompt.
REPLY_WORDS = ("Row", "row", "格式", "输出", "Output")


def parse_rows(text: Column, n: int) -> Column:
    """Characters of an OCR reply, n of them.

    'Row k: ...' lines count if they give exactly n; else lines and the first characters of [...] marks together, if
    those do; else all ideographs and unknown marks outside the reply's own words, cut or filled up to n.
    """
    one = f"[{CJK}{UNKNOWN}]"
    keep = lambda c: F.regexp_replace(c, f"[^{CJK}{UNKNOWN}]", "")
    text = F.coalesce(text, F.lit(""))
    rows = keep(F.array_join(F.regexp_extract_all(text, F.lit(r"(?i)Row\s*\d+\s*:\s*(.+)")), ""))
    inner = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]")), lambda m: F.regexp_replace(m, r"^\s+|\s+$", ""))
    firsts = F.filter(inner, lambda m: (m == UNKNOWN) | m.rlike(f"^[{CJK}]"))
    marks = F.concat(rows, F.array_join(F.transform(firsts, lambda m: F.substring(m, 1, 1)), ""))
    rest = F.array_join(F.regexp_extract_all(F.regexp_replace(text, "|".join(REPLY_WORDS), " "), F.lit(f"({one})")), "")
    return F.when(F.length(rows) == n, rows).when(F.length(marks) == n, marks).otherwise(F.rpad(rest, n, UNKNOWN))


def parse_single(text: Column) -> Column:
    """The unknown mark if it is there, else the first ideograph, else the unknown mark."""
    first = F.regexp_extract(text, f"([{CJK}])", 1)
    return F.when(text.contains(UNKNOWN), F.lit(UNKNOWN)).when(F.length(first) > 0, first).otherwise(F.lit(UNKNOWN))
