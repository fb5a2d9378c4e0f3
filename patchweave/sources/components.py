"""Labelled page rasters: .npz archives of the extraction stage to component rows, and back to an archive."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Member names of the archives.
COUNT, LABELS, DELETED = "_nLabels", "_labels", "_deleted_labels"
REASON_KEYS, REASON_VALUES, OLD_REASONS = "_delete_reason_keys", "_delete_reason_values", "_delete_reason"
MERGE_KEYS, MERGE_VALUES = "_merge_mapping_keys", "_merge_mapping_values"

SCHEMA = "page int, label int, left_ int, top int, width int, height int, area long, cy double, cx double, deleted boolean, reason string, merged_into int"


def rows_of(content: bytes, page: int | None) -> pd.DataFrame:
    """One row a label above 0. Archives that list reasons beside the deleted labels, as older ones do, are read too."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        raster = z[LABELS]
        deleted = z[DELETED].astype(np.int64).tolist()
        if REASON_KEYS in z:
            reasons = dict(zip(z[REASON_KEYS].astype(np.int64).tolist(), z[REASON_VALUES].tolist(), strict=True))
        else:
            reasons = dict(zip(deleted, z[OLD_REASONS].tolist(), strict=False)) if OLD_REASONS in z else {}
        merges = dict(zip(z[MERGE_KEYS].astype(np.int64).tolist(), z[MERGE_VALUES].astype(np.int64).tolist(), strict=True)) if MERGE_KEYS in z else {}
    y, x = np.nonzero(raster)
    px = pd.DataFrame({"label": raster[y, x].astype(np.int64), "y": y, "x": x})
    g = px.groupby("label").agg(left_=("x", "min"), right=("x", "max"), top=("y", "min"), bottom=("y", "max"), area=("x", "size"), cy=("y", "mean"), cx=("x", "mean")).reset_index()
    gone = set(deleted)
    return pd.DataFrame(
        {
            "page": page, "label": g.label, "left_": g.left_, "top": g.top, "width": g.right - g.left_ + 1, "height": g.bottom - g.top + 1, "area": g.area, "cy": g.cy, "cx": g.cx,
            "deleted": [v in gone for v in g.label], "reason": [reasons.get(v) if v in gone else None for v in g.label], "merged_into": pd.array([merges.get(v) for v in g.label], "Int32"),
        }
    )


def read_components(spark: SparkSession, folder: str) -> DataFrame:
    """Component rows of all archives of a folder; an archive is one task's work, pages are numbered by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, page in zip(b.content, b.page, strict=True):
                yield rows_of(content, None if pd.isna(page) else int(page))

    return files.select("content", F.regexp_extract("path", r"(\d+)\.npz$", 1).try_cast("int").alias("page")).mapInPandas(run, SCHEMA)


def archive(raster: np.ndarray, deleted: dict[int, str], merges: dict[int, int] | None = None) -> bytes:
    """An archive of one page; background can't be deleted."""
    if 0 in deleted:
        raise ValueError("label 0 is the background")
    keys, merges = sorted(deleted), merges or {}
    out = io.BytesIO()
    np.savez_compressed(
        out,
        **{
            COUNT: int(raster.max(initial=0)) + 1, LABELS: raster, DELETED: np.array(keys, np.int64), REASON_KEYS: np.array(keys, np.int64), REASON_VALUES: np.array([deleted[k] for k in keys], str),
            MERGE_KEYS: np.array(list(merges), np.int64), MERGE_VALUES: np.array(list(merges.values()), np.int64),
            "_stats": np.array([]), "_intensity_image": np.array([]), "_colors": np.array([]), "has_stats": False, "has_intensity": False, "has_colors": False,
        },
    )
    return out.getvalue()
