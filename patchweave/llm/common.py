"""Shared helpers: scratch tables in the shared folder, Arrow mapping, table reading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (tests) gets a temporary folder; a cluster raises, as a folder of one
    machine would lose what others write.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="patchweave-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch. Documents are wide, so the default of 10,000 makes batches of tens of megabytes.
BATCH_ROWS = 1024
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets small Arrow batches, unless the session has a setting of its own."""
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _positions(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed by position, and where each name is found: as written, else in lower case."""
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    found: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        found.setdefault(c, f"c{i}")
    for i, c in enumerate(df.columns):
        found.setdefault(c.lower(), f"c{i}")
    return by_place, found


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; a column the input lacks is null. Extra columns of any name are ignored."""
    by_place, found = _positions(df)
    return by_place.select(*[(F.col(found[n]) if n in found else F.lit(None)).cast(kind).alias(n) for n, kind in columns.items()])


def wrapped(df: DataFrame) -> DataFrame:
    """row (a struct of all columns), doc_id, source, text: keys beside the rows, so that no name can clash.

    ``select("row.*")`` gives the rows back.
    """
    by_place, found = _positions(df)
    row = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]).alias("row")
    get = lambda n, kind: (F.col(found[n]) if n in found else F.lit(None)).cast(kind).alias(n)
    return by_place.select(row, get("doc_id", "long"), get("source", "string"), get("text", "string"))


def gathered(batches: Iterator[pa.RecordBatch], rows: int, nbytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of up to ``rows`` rows or about ``nbytes`` bytes; a single batch of fewer rows is not cut."""
    held: list[pa.RecordBatch] = []
    for b in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
        if held and (sum(x.num_rows for x in held) + b.num_rows > rows or sum(x.nbytes for x in held) + b.nbytes > nbytes):
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def _give_back() -> None:
    """Return freed memory to the system: idle Python workers keep it otherwise, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give freed memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)
