"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document of a source gets a virtual finish time: the source's running tokens, over up to three passes,
divided by the source's target. Entries are range-sorted by that time and the mix is cut at the total budget.

Every source sends its target in one unit of virtual time, so ranges of equal time hold about equal tokens and need no
sample. Where only the cut is asked for, the ranges' sums find the range in which the budget ends, and that one alone
is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchweave.llm.common import pick, stage, wrapped

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: Rows of a piece of a source's shuffled order, and entries of a range of virtual time, that one task sums or sorts, about.
PIECE_ROWS = 1 << 16


def shuffle_key(doc_id, text):
    """Pseudo-random place of a document; one without an id goes by its text."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit(""))))))


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (runs of characters other than space and \\t to \\r; null text: 0), and shuffle key."""
    return pick(docs, doc_id="long", source="string", text="string").select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long").alias("size"),
        shuffle_key(F.col("doc_id"), F.col("text")).alias("key"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_PASSES, share: float = 1.0) -> DataFrame:
    """Per source: source_size, weight, target.

    Sources in code point order, null last, take the weights in turn. The target is level * weight up to cap *
    source_size; the level is the one at which targets add up to ``share`` of all sizes, found by ranking sources by
    the level at which each hits its cap. Windows here run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("weight", w).withColumn("full_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        # the first source, in order of full_at, whose cap lies above the level that is left
        .withColumn("fits", F.col("full_at") >= F.col("level"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("full_at", "source", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.lit(cap) * F.col("source_size"))).cast("double"))
        .select("source", "source_size", "weight", "target", "budget")
    )


def finish_times(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> tuple[DataFrame, int]:
    """(doc_id, source, key, size, unit, source_size, target, budget, finish) of every row, written to the shared folder, and their number.

    ``finish`` is the virtual time at which the middle of the document's first entry is sent; each later pass adds
    source_size / target. The middle stands for the whole, as it brings a source within half a document of its target at time 1.
    """
    sizes = stage(with_sizes(docs), "mix-sizes")
    n = sizes.count()
    per = stage(targets(sizes, weights, MAX_PASSES, share), "mix-targets")
    digits = max(2, math.ceil(math.log(max(n, 1) / PIECE_ROWS, 16)))  # of the shuffle key that name a piece
    pieces = sizes.withColumn("piece", F.substring("key", 1, digits))
    sums = pieces.groupBy("source", "piece").agg(F.sum("size").alias("s"))
    runs = sums.withColumn("base", F.sum("s").over(Window.partitionBy("source").orderBy("piece")) - F.col("s"))
    r = runs.alias("r").join(per.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "piece", "base", "source_size", "target", "budget")
    upto = F.sum("size").over(Window.partitionBy("source", "piece").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    unit = F.sum("size").over(Window.partitionBy("source", "piece", "key"))
    p = pieces.withColumn("upto", upto).withColumn("unit", unit)
    joined = p.alias("p").join(r.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.piece") == F.col("r.piece")))
    middle = F.col("base") + F.col("upto") - F.col("unit") / 2
    finish = F.when(F.col("target") > 0, middle / F.col("target")).otherwise(F.lit(0.0))
    placed = joined.select("doc_id", F.col("p.source").alias("source"), "key", "size", "unit", middle.alias("middle"), "source_size", "target", "budget", finish.alias("finish"))
    return stage(placed, "mix-placed"), n


def _at(i):
    """Virtual time of pass ``i``."""
    return F.when(F.col("target") > 0, (F.col("middle") + i * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))


def _place(i):
    """Place of pass ``i`` in the global order."""
    return F.struct(_at(i).alias("at"), "key", F.coalesce("source", F.lit("")).alias("source"), i.alias("pass"))


def budget_cut(placed: DataFrame, n: int) -> DataFrame:
    """One row: ``cut``, the place of the entry on which the budget ends, null if there is none; ``inside``, if its middle is within the budget."""
    n_ranges = max(256, MAX_PASSES * n // PIECE_ROWS)
    entries = placed.where("size > 0").select("size", "unit", "budget", F.explode(F.array(*[_place(F.lit(i)) for i in range(MAX_PASSES)])).alias("place"))
    ranged = entries.withColumn("range", F.least(F.floor(F.col("place.at") * n_ranges), F.lit(2 * n_ranges)))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("s"), F.max("budget").alias("budget"))
    # Two rows of 16 bytes for each 65,536 entries: one task runs through them.
    run = sums.withColumn("upto", F.sum("s").over(Window.orderBy("range")))
    crossed = run.where("upto > budget").agg(F.min(F.struct("range", (F.col("upto") - F.col("s")).alias("base"))).alias("c")).select("c.range", "c.base")
    last = ranged.join(F.broadcast(crossed), "range")  # one row
    upto = last.withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("range").orderBy("place")))
    first = upto.where("upto > budget").agg(F.min(F.struct("place", (F.col("upto") - F.col("unit") / 2 <= F.col("budget")).alias("inside"))).alias("c"))
    return first.select(F.col("c.place").alias("cut"), F.coalesce("c.inside", F.lit(False)).alias("inside"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """One row for each document: doc_id, source, key, size, source_size, target, passes, taken, finish, middle.

    The entries of all passes stand in one order by virtual time, then key, source and pass. The mix takes them in turn
    until the budget is spent; the entry on which it ends is taken if its middle is within, so all sources together come
    within half a document of the budget. ``passes`` (0 to 3) counts a document's entries up to there, and ``taken`` is passes * size.

    Texts that are null or empty have size 0, take nothing from the budget and are not repeated. A null source is a
    source of its own, last in order. Rows of one source with equal ids (without an id: equal texts) are one unit of the
    order and get equal passes. A very long text counts whole. An empty
    table gives no rows. Extra columns are ignored. The order depends on ids alone, so reruns agree.
    """
    placed, n = finish_times(docs, weights, share)
    cut = stage(budget_cut(placed, n), "mix-cut")
    goes = lambda p: F.col("cut").isNull() | (p < F.col("cut")) | (F.col("inside") & (p == F.col("cut")))
    passes = sum(F.when(goes(_place(F.lit(i))), 1).otherwise(0) for i in range(MAX_PASSES))
    passes = F.when(F.col("unit") == 0, F.least(passes, F.lit(1))).otherwise(passes)
    return placed.crossJoin(F.broadcast(cut)).select(  # one row
        "doc_id", "source", "key", "size", "source_size", "target", passes.cast("int").alias("passes"), (passes * F.col("size")).cast("long").alias("taken"), "finish", "middle"
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, n_ranges: int | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, range-sorted by virtual finish time.

    Nulls, ties, repeated rows and empty tables are as in ``mix``; all columns come back, whatever their names.
    """
    plan = (
        mix(docs, weights, share).where("passes > 0").groupBy("source", "key")
        .agg(*[F.first(c).alias(c) for c in ("passes", "middle", "source_size", "target")])
    )
    keyed = wrapped(docs).withColumn("key", shuffle_key(F.col("doc_id"), F.col("text"))).alias("d")
    entries = (
        keyed.join(plan.alias("m"), (F.col("d.key") == F.col("m.key")) & F.col("d.source").eqNullSafe(F.col("m.source")))
        .select("row", "doc_id", "middle", "source_size", "target", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
        .select("row", "doc_id", _at(F.col("pass")).alias("at"))
    )
    ranged = entries.repartitionByRange(n_ranges, "at", "doc_id") if n_ranges else entries.repartitionByRange("at", "doc_id")
    return ranged.sortWithinPartitions("at", "doc_id").select("row.*")


ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::bigint as size,
         md5(doc_id::varchar) as key
  from documents),
per as (
  select source, sum(size)::double as ss,
         ([5.0, 2.0, 1.0])[((row_number() over (order by source collate "binary" nulls last) - 1) % 3 + 1)::int]::double as w
  from sized group by source),
ranked as (
  select *, 3 * ss / w as full_at, sum(ss) over () as budget,
         coalesce(sum(3 * ss) over (order by 3 * ss / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as used,
         sum(w) over (order by 3 * ss / w, source nulls last rows between current row and unbounded following) as left_w
  from per),
level as (
  select arg_min((budget - used) / left_w, full_at) as level from ranked where full_at >= (budget - used) / left_w),
t as (select source, ss, least(3 * ss, coalesce((select level from level) * w, 3 * ss)) as target from ranked),
placed as (
  select row_number() over () as r, doc_id, s.source, size, key, ss, target, sum(size) over (partition by s.source, key) as unit,
         sum(size) over (partition by s.source order by key) - sum(size) over (partition by s.source, key) / 2 as middle
  from sized s join t on s.source is not distinct from t.source),
entries as (
  select r, size, unit, i, key, source, case when target > 0 then (middle + i * ss) / target else 0 end as at_
  from placed, (select unnest([0, 1, 2]) as i) where size > 0),
run as (select r, sum(size) over (order by at_, key, coalesce(source, '') collate "binary", i) - unit / 2 as middle from entries),
n as (select r, count(*) as n from run where middle <= (select sum(size) from sized) group by r)
select doc_id, size, ss::bigint as source_size, target, (size * coalesce(n, 0))::bigint as taken
from placed left join n using (r)
"""
