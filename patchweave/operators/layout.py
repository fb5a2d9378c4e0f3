"""Page layout: column bands, label extents, rectangles, reading order; and alignment of read characters to transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stands in for a character that could not be read, so that it matches nothing.
PLACEHOLDER = "￿"
UNKNOWN = "▯"


def column_bands(profile: DataFrame, cut: float, gap: int = 1, pad: int = 0, min_width: int = 1) -> DataFrame:
    """Runs of x whose projection reaches ``cut``: (page, band, start_, stop_), gaps under ``gap`` closed, then padded.

    ``profile`` has page, x, v, one row for each column of pixels.
    """
    w = Window.partitionBy("page").orderBy("x")
    on = profile.where(F.col("v") >= cut)
    new = F.when(F.col("x") - F.lag("x").over(w) <= gap, 0).otherwise(1)
    runs = on.withColumn("new", new).withColumn("band", F.sum("new").over(w)).groupBy("page", "band").agg((F.min("x") - pad).alias("start_"), (F.max("x") + 1 + pad).alias("stop_"))
    return runs.where(F.col("stop_") - F.col("start_") >= min_width)


def label_extents(pixels: DataFrame) -> DataFrame:
    """(page, label, left_, top, right_, bottom) of labelled pixels (page, label, x, y); right and bottom are exclusive."""
    return pixels.where("label > 0").groupBy("page", "label").agg(F.min("x").alias("left_"), F.min("y").alias("top"), (F.max("x") + 1).alias("right_"), (F.max("y") + 1).alias("bottom"))


def _merge(spans: list[tuple[float, float]], gap: float) -> list[list[float]]:
    out: list[list[float]] = []
    for s, e in sorted(spans):
        if out and s - out[-1][1] < gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def rectangles(boxes: DataFrame) -> DataFrame:
    """Cells of each page: (page, col_idx, row_idx, lane_idx, label) from boxes (page, label, left_, top, width, height).

    Columns are merged x spans; rows in a column merge y spans with gaps under max(0.3 mean height, 3); a row is cut in
    lanes by x. Each cell takes its largest box whose label no earlier cell took; cells go in order of column, row, lane.
    """

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["left_", "top", "label"])
        seen: set[int] = set()
        out = []
        x0, x1 = pdf.left_.to_numpy(float), (pdf.left_ + pdf.width).to_numpy(float)
        y0, y1 = pdf.top.to_numpy(float), (pdf.top + pdf.height).to_numpy(float)
        for c, (cs, ce) in enumerate(_merge(list(zip(x0, x1, strict=True)), 0)):
            inside = np.flatnonzero((x0 >= cs) & (x1 <= ce))
            gap = max(0.3 * (y1 - y0)[inside].mean(), 3)
            for r, (rs, re_) in enumerate(_merge([(y0[i], y1[i]) for i in inside], gap)):
                row = [i for i in inside if y0[i] >= rs and y1[i] <= re_]
                for k, (ls, le) in enumerate(_merge([(x0[i], x1[i]) for i in row], 0)):
                    cell = [i for i in row if x0[i] >= ls and x1[i] <= le]
                    cell.sort(key=lambda i: (-(x1[i] - x0[i]) * (y1[i] - y0[i]), int(pdf.label.iloc[i])))
                    for i in cell:
                        lab = int(pdf.label.iloc[i])
                        if lab not in seen:
                            seen.add(lab)
                            out.append((int(pdf.page.iloc[0]), c, r, k, lab))
                            break
        return pd.DataFrame(out, columns=["page", "col_idx", "row_idx", "lane_idx", "label"])

    return boxes.groupBy("page").applyInPandas(page, "page long, col_idx int, row_idx int, lane_idx int, label long")


def reading_order(cells: DataFrame) -> DataFrame:
    """(page, label, reading_order): columns right to left, blocks of rows with equally many lanes, lanes right to left,
    rows top down; from 0 within a page."""
    row = Window.partitionBy("page", "col_idx", "row_idx")
    lanes = cells.withColumn("lanes", F.count("*").over(row))
    rows = lanes.select("page", "col_idx", "row_idx", "lanes").distinct()
    w = Window.partitionBy("page", "col_idx").orderBy("row_idx")
    blocks = rows.withColumn("new", F.when(F.col("lanes") == F.lag("lanes").over(w), 0).otherwise(1)).withColumn("block", F.sum("new").over(w)).drop("lanes", "new")
    order = Window.partitionBy("page").orderBy(F.desc("col_idx"), "block", F.desc("lane_idx"), "row_idx", "label")
    return cells.join(blocks, ["page", "col_idx", "row_idx"]).select("page", "label", (F.row_number().over(order) - 1).cast("long").alias("reading_order"))


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None]]:
    """A least-cost script from a to b as (equal | replace | delete | insert, i, j); traced from the end, preferring
    diagonal steps, then delete, then insert."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    codes = {c: k for k, c in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[c] for c in a], int), np.array([codes[c] for c in b], int)
    col = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (y != x[i - 1]))
        row = np.concatenate(([i], best)) - col
        cost[i] = np.minimum.accumulate(row) + col  # inserts run along the row
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if a[i] == b[j] else "replace", i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(("delete", i, None))
        else:
            j -= 1
            out.append(("insert", None, j))
    return out[::-1]


def align(patches: DataFrame, transcript: DataFrame) -> DataFrame:
    """(id, page, aligned): the transcript's character for each read one; the unknown mark where the script deletes it.

    ``patches`` has id, page, reading_order, char; ``transcript`` page, text, one row a page. Unknown or longer readings
    match nothing.
    """

    read = patches.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("reading_order", "id", "char"))).alias("read"))
    text = transcript.where("text is not null").groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("text")), "").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, page_of, got = [], [], []
            for page, read_, text_ in zip(b.page, b["read"], b.text, strict=True):
                chars = [c if isinstance(c, str) and len(c) == 1 and c != UNKNOWN else PLACEHOLDER for c in (r["char"] for r in read_)]
                target = list(text_) if isinstance(text_, str) else []
                out = [UNKNOWN] * len(chars)
                for op, i, j in edit_script(chars, target):
                    if op in ("equal", "replace"):
                        out[i] = target[j]
                ids += [r["id"] for r in read_]
                page_of += [page] * len(out)
                got += out
            yield pd.DataFrame({"id": ids, "page": page_of, "aligned": got})

    # A page is one row, so many pages share a batch.
    return read.join(text, "page", "left").select("page", "read", "text").mapInPandas(run, "id long, page long, aligned string")
