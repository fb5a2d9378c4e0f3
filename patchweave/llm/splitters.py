"""Sharding by sampled splitters.

Records get the key (hash of the text, hash of the id). A size-weighted sample of keys gives quantile boundaries of
many fine ranges; exact range sizes are then counted, whole ranges go to the shard their bytes fall in, and a range
that straddles a shard boundary is subdivided at the record. Equal texts share the first key part, so a group stays
in one shard unless it straddles a boundary and is larger than a range.

Only DataFrame functions run here.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchweave.llm.common import pick, stage

SAMPLE_KEYS = 16_384
RANGES_PER_SHARD = 16


def _after(bounds: list[tuple[int, int]], lo: int, hi: int) -> Column:
    """Number of boundaries at or below the key, as a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    h, t = bounds[mid]
    below = (F.col("h") < F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("t") < F.lit(t)))
    return F.when(below, _after(bounds, lo, mid)).otherwise(_after(bounds, mid + 1, hi))


def sample_boundaries(keys: DataFrame, total: int, n_ranges: int, sample: int = SAMPLE_KEYS) -> list[tuple[int, int]]:
    """Quantile boundaries of a sample in which a record's chance is in proportion to its size.

    A record of more than total/sample bytes is always drawn and stands for its multiple. The sample holds about
    ``sample`` keys whatever the input size, so collecting it is bounded.
    """
    if total <= 0:
        return []
    share = F.col("size") * F.lit(sample / total)
    u = F.pmod(F.xxhash64("t", "h", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keys.where(u < share).select("h", "t", F.greatest(share, F.lit(1.0)).alias("w")).collect()
    drawn.sort()
    weights, run = [], 0.0
    for r in drawn:
        run += r.w
        weights.append(run)
    bounds: list[tuple[int, int]] = []
    for k in range(1, n_ranges):
        at = bisect.bisect_left(weights, run * k / n_ranges)
        if at < len(drawn):
            b = (drawn[at].h, drawn[at].t)
            if not bounds or b > bounds[-1]:
                bounds.append(b)
    return bounds


def shard(docs: DataFrame, n_shards: int = 16, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into one of ``n_shards`` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard),
    grown_shard (null under this law) and ``range``, the fine range a record came from.

    A null text counts as empty, a null doc_id hashes like any other value, repeated rows are separate records, an
    empty table gives no rows, extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = stage(
        pick(docs, doc_id="long", text="string").select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64("doc_id", F.lit(5)).alias("t"),
        ),
        "shard-keys",
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    bounds = sample_boundaries(keys, total, n_shards * ranges_per_shard)
    ranged = keys.withColumn("range", _after(bounds, 0, len(bounds)))

    # Exact bytes of each range; at most n_shards * ranges_per_shard rows reach the driver.
    sizes = {r["range"]: r.s for r in ranged.groupBy("range").agg(F.sum("size").alias("s")).collect()}
    start, run = [], 0
    for r in range(len(bounds) + 1):
        start.append(run)
        run += sizes.get(r, 0)
    base = F.element_at(F.array(*[F.lit(s).cast("long") for s in start]), F.col("range") + 1)
    to_shard = lambda at: F.least(F.floor(at * F.lit(n_shards) / F.lit(max(total, 1))), F.lit(n_shards - 1)).cast("int")

    # A text's group within a range moves as one, unless it alone outweighs the range's fair share.
    peers = Window.partitionBy("range").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "h")
    order = Window.partitionBy("range").orderBy("h", "t", "doc_id", "size")
    fair = total / max(n_shards * ranges_per_shard, 1)
    placed = (
        ranged.withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_start", F.sum("size").over(peers) - F.col("group_bytes"))
        .withColumn("row_start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("alone", F.col("group_bytes") > F.lit(fair / 2))
        # the middle decides, so a boundary is missed by half of what lies across it at most
        .withColumn("at", base + F.when(F.col("alone"), F.col("row_start") + F.col("size") / 2).otherwise(F.col("group_start") + F.col("group_bytes") / 2))
        .withColumn("shard", to_shard(F.col("at")))
        .withColumn("seq", F.row_number().over(Window.partitionBy("range", "shard").orderBy("h", "t", "doc_id", "size")).cast("long"))
    )
    placed = stage(placed.select("doc_id", "size", "text_crc32", "range", "shard", "seq"), "shard-placed")

    # Slots: offset of the (shard, range) piece plus the place in it. Pieces are at most ranges + shards many.
    pieces = placed.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()
    offset, seen = {}, {}
    for p in sorted(pieces):
        offset[(p.shard, p["range"])] = seen.get(p.shard, 0)
        seen[p.shard] = seen.get(p.shard, 0) + p.n
    spark = docs.sparkSession
    offsets = spark.createDataFrame([(s, r, o) for (s, r), o in offset.items()], "shard int, range int, o long")
    return placed.join(F.broadcast(offsets), ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("o") + F.col("seq") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "range",
    )
