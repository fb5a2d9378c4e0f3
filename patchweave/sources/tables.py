"""Table sources and sinks: pruned loads, transcripts, page images, CSV pairs, graphs, soft deletion."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Schema of the patch table over all stages, as DDL.
PATCHES = (
    "patch_id bigint, page int, file string, `left` int, top int, width int, height int, label int, centroid struct<y:double,x:double>, page_skew double, reading_order bigint, "
    "bin_patch binary, svg string, char_chat string, conf_chat double, char_transcription string, char_consensus string, histogram array<array<float>>, membership bigint, membership_pre_split bigint, "
    "degree_centrality double, edge_weight_sum double"
)


def save(df: DataFrame, path: str, mode: str = "error") -> None:
    """One Parquet dataset holds all columns; pruning makes a file a column needless."""
    df.write.mode(mode).parquet(path)


def load_columns(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """The named columns that exist; a missing one is warned of and skipped. Filter and columns reach the scan."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        log.warning("columns not in %s: %s", path, ", ".join(missing))
    return (df.where(where) if where else df).select(*[c for c in columns if c in df.columns])


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(page, text) of text files named p<n>.<ext>; other names are skipped."""
    t = spark.read.text(folder, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"))
    return t.select(F.regexp_extract("name", r"^p(\d+)(\.[^.]*)?$", 1).try_cast("int").alias("page"), "text").where("page is not null")


def page_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, page, content) of an image folder; page numbers follow the sorted paths' last number."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return b.select("path", F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).try_cast("int").alias("page"), "content")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Several tables side by side, a folder each, where a workbook would have sheets."""
    for name, df in sheets.items():
        df.write.csv(f"{folder}/{name}", header=True)


def write_graph(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    vertices.write.parquet(f"{folder}/vertices")
    edges.write.parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges")


def latex_table(df: DataFrame, max_rows: int = 50) -> str:
    """A LaTeX tabular of the first rows; reports are bounded, so this may collect."""
    rows = df.limit(max_rows).collect()
    esc = lambda v: "" if v is None else str(v).replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = "".join(" & ".join(esc(v) for v in r) + " \\\\\n" for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n" + " & ".join(map(esc, df.columns)) + " \\\\\n\\hline\n" + body + "\\end{tabular}\n"


def markdown_table(df: DataFrame, max_rows: int = 50) -> str:
    rows = df.limit(max_rows).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |\n"
    return line(df.columns) + line("---" for _ in df.columns) + "".join(line(r) for r in rows)


def soft_delete(df: DataFrame, which: Column, reason: str, background: Column | None = None) -> DataFrame:
    """Marks rows deleted with a reason; rows already deleted keep theirs, background rows can't be deleted."""
    hit = F.coalesce(which, F.lit(False)) & ~F.col("deleted")
    if background is not None:
        hit &= ~F.coalesce(background, F.lit(False))
    return df.withColumns({"reason": F.when(hit, reason).otherwise(F.col("reason")), "deleted": F.col("deleted") | hit})


def undelete(df: DataFrame, which: Column) -> DataFrame:
    back = F.coalesce(which, F.lit(False))
    return df.withColumns({"reason": F.when(~back, F.col("reason")), "deleted": F.col("deleted") & ~back})
