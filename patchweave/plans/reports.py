"""Label, cluster and reporting queries over the driver tables, each with its DuckDB counterpart.

``events`` stands for patches: user_id is the cluster, event_type the label ('error' and some nulls are unknown), value
the confidence, centrality or weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchweave.functions.scalar import UNKNOWN, consensus, known
from patchweave.operators import labels as L
from patchweave.operators import metrics as M
from patchweave.plans.catalog import register


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def patches(spark, sf_dir: str) -> DataFrame:
    """id, cluster, label, label2, value, strength, page."""
    e = read(spark, sf_dir, "events")
    i, t = F.col("event_id"), F.col("event_type")
    return e.select(
        i.alias("id"), F.col("user_id").alias("cluster"),
        F.when(t == "error", UNKNOWN).when(i % 11 == 0, None).otherwise(t).alias("label"),
        F.when(i % 5 == 0, "click").when(i % 13 == 0, None).when(t == "error", UNKNOWN).otherwise(t).alias("label2"),
        F.col("value"), F.round(F.col("value") * (i % 7), 4).alias("strength"), (i % 97).alias("page"),
    )


P = """with p as (select event_id as id, user_id as cluster,
  case when event_type = 'error' then '▯' when event_id % 11 = 0 then null else event_type end as label,
  case when event_id % 5 = 0 then 'click' when event_id % 13 = 0 then null when event_type = 'error' then '▯' else event_type end as label2,
  value, round(value * (event_id % 7), 4) as strength, event_id % 97 as page from events)
"""
K = P.rstrip() + ",\nk as (select *, coalesce(label, '▯') as l from p)\n"

PURITY = K.rstrip() + """,
c as (select cluster, l, count(*) as n from k group by all),
per as (select cluster, sum(n) as size, coalesce(sum(n) filter (l <> '▯'), 0) as known from c group by cluster),
kn as (select c.*, per.known from c join per using (cluster) where l <> '▯'),
h as (select cluster, count(*) as n_labels, -sum(n / known * log2(n / known)) as h, max(n) as best, arg_min(l, (-n, l)) as dominant from kn group by cluster),
purity as (select per.cluster, size::bigint as size, known::bigint as known_size, (size - known)::bigint as unknown_count,
  best / known as purity, coalesce(h, 0.0) as entropy, case when n_labels > 1 then h / log2(n_labels) else 0.0 end as norm_entropy,
  coalesce(dominant, '▯') as dominant, coalesce(n_labels, 0)::bigint as n_labels from per left join h using (cluster))
"""


@register("agg_cluster_purity", PURITY + "select cluster, size, known_size, unknown_count, round(purity, 6) as purity, round(abs(entropy), 6) as entropy, round(abs(norm_entropy), 6) as norm_entropy, dominant, n_labels from purity")
def _(s, d):
    return L.cluster_purity(patches(s, d)).withColumns({c: F.round(c, 6) for c in ("purity", "entropy", "norm_entropy")})


@register("agg_biggest_cluster", K + "select l as label, max(n)::bigint as biggest, sum(n)::bigint as occurrences from (select cluster, l, count(*) as n from k where l <> '▯' group by all) group by l")
def _(s, d):
    return L.biggest_cluster(patches(s, d))


@register("agg_dominance", K.rstrip() + """, b as (select l, max(n) as biggest, sum(n) as o from (select cluster, l, count(*) as n from k where l <> '▯' group by all) group by l)
select t::int as threshold, round(avg((biggest >= t)::int), 6) as label_share, round(sum(case when biggest >= t then o else 0 end) / sum(o), 6) as occurrence_share
from b, (select unnest([1, 2, 3, 5, 10, 15, 20]) as t) group by t""")
def _(s, d):
    return L.dominance(patches(s, d)).withColumns({c: F.round(c, 6) for c in ("label_share", "occurrence_share")})


@register("agg_completeness", K.rstrip() + """, c as (select cluster, l, count(*) as n from k where l <> '▯' group by all),
t as (select *, sum(n) over (partition by l) as size from c)
select l as label, size::bigint as size, round(max(n) / size, 6) as best_share, round(abs(-sum(n / size * log2(n / size))), 6) as entropy,
 round(case when count(*) > 1 then -sum(n / size * log2(n / size)) / log2(count(*)) else 0.0 end, 6) as norm_entropy, arg_min(cluster, (-n, cluster)) as dominant_cluster, count(*)::bigint as n_clusters
from t group by l, size""")
def _(s, d):
    return L.completeness(patches(s, d)).withColumns({c: F.round(c, 6) for c in ("best_share", "entropy", "norm_entropy")})


@register("agg_contingency", "select l_suppkey as cluster, l_returnflag as label, count(*)::bigint as n from lineitem group by all")
def _(s, d):
    return L.contingency(read(s, d, "lineitem"), "l_suppkey", "l_returnflag")


@register("agg_exec_summary", PURITY + """select count(*)::bigint as n_clusters, round(avg(purity), 6) as mean_purity, round(avg(size), 6) as mean_size, (count(*) filter (size = 1))::bigint as n_singletons,
 arg_min(cluster, (-purity, cluster)) filter (purity is not null) as purest, arg_min(cluster, (purity, cluster)) filter (purity is not null) as least_pure, arg_min(cluster, (-size, cluster)) as largest from purity""")
def _(s, d):
    return L.executive_summary(patches(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_purity", "mean_size")})


# Small clusters for singletons: the cluster is the customer of an order.
@register("agg_hapax", """with c as (select o_custkey, count(*) as n, min(o_orderpriority) as lab from orders group by 1)
select (count(*) filter (n = 1))::bigint as n_hapax, round(100 * count(*) filter (n = 1) / count(*), 6) as hapax_pct, count(distinct case when n = 1 then lab end)::bigint as n_labels from c""")
def _(s, d):
    c = read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("lab"))
    one = F.col("n") == 1
    return c.agg(F.count_if(one).alias("n_hapax"), r6(100 * F.count_if(one) / F.count("*"), "hapax_pct"), F.count_distinct(F.when(one, F.col("lab"))).alias("n_labels"))


@register("agg_unknown", K + """select sum(u)::bigint as n_unknown, round(100 * sum(u) / sum(n), 6) as unknown_pct, (count(*) filter (u = n))::bigint as all_unknown
from (select cluster, count(*) as n, count(*) filter (l = '▯') as u from k group by cluster)""")
def _(s, d):
    c = patches(s, d).groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(~known(F.col("label"))).alias("u"), F.bool_and(~known(F.col("label"))).alias("every"))
    return c.agg(F.sum("u").alias("n_unknown"), r6(100 * F.sum("u") / F.sum("n"), "unknown_pct"), F.count_if("every").alias("all_unknown"))


@register("agg_page_stats", K.replace("from p)", "from p)", 1) + """select page, count(*)::bigint as n, round(avg(value), 3) as mean_conf, round(avg((label is not null and label = '▯')::int), 6) as unknown_fraction from k group by page""")
def _(s, d):
    lit = F.coalesce(F.col("label") == UNKNOWN, F.lit(False)).cast("int")  # only the mark, not null
    return patches(s, d).groupBy("page").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value").cast("string").try_cast("double")), 3).alias("mean_conf"), r6(F.avg(lit), "unknown_fraction"))


@register("agg_top_freq", "select p_name as label, count(*)::bigint as n from part group by 1 order by n desc, label limit 30")
def _(s, d):
    return read(s, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(30)


@register("agg_label_coverage", P + """select col, (count(*) filter (coalesce(v, '▯') <> '▯'))::bigint as known, count(*)::bigint as total, round(100 * count(*) filter (coalesce(v, '▯') <> '▯') / count(*), 6) as pct
from (select 'label' as col, label as v from p union all select 'label2', label2 from p) group by col""")
def _(s, d):
    t = patches(s, d).select(F.explode(F.array(F.struct(F.lit("label").alias("col"), F.col("label").alias("v")), F.struct(F.lit("label2").alias("col"), F.col("label2").alias("v")))).alias("x")).select("x.*")
    k = F.count_if(known(F.col("v")))
    return t.groupBy("col").agg(k.alias("known"), F.count("*").alias("total"), r6(100 * k / F.count("*"), "pct"))


@register("agg_discrepancy", P.rstrip() + """, x as (select coalesce(label, '▯') as a, coalesce(label2, '▯') as b from p)
select (count(*) filter (a <> '▯' and b <> '▯' and a = b))::bigint as match, (count(*) filter (a <> '▯' and b <> '▯' and a <> b))::bigint as mismatch, (count(*) filter (a <> '▯' and b = '▯'))::bigint as first_only,
 (count(*) filter (a = '▯' and b <> '▯'))::bigint as second_only, (count(*) filter (a = '▯' and b = '▯'))::bigint as both_unknown,
 round(count(*) filter (a <> '▯' and a = b) / count(*) filter (a <> '▯' and b <> '▯'), 6) as accuracy from x""")
def _(s, d):
    a, b = known(F.col("label")), known(F.col("label2"))
    same = F.coalesce(F.col("label") == F.col("label2"), F.lit(False))
    return patches(s, d).agg(
        F.count_if(a & b & same).alias("match"), F.count_if(a & b & ~same).alias("mismatch"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"),
        F.count_if(~a & ~b).alias("both_unknown"), r6(F.count_if(a & b & same) / F.count_if(a & b), "accuracy"),
    )


@register("agg_confusion_top", P + "select label2 as ocr, label as truth, count(*)::bigint as n from p where coalesce(label, '▯') <> '▯' and coalesce(label2, '▯') <> '▯' and label <> label2 group by all order by n desc, ocr, truth limit 20")
def _(s, d):
    t = patches(s, d).where(known(F.col("label")) & known(F.col("label2")) & (F.col("label") != F.col("label2")))
    return t.groupBy(F.col("label2").alias("ocr"), F.col("label").alias("truth")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ocr", "truth").limit(20)


@register("agg_size_stats", "select count(*)::bigint as n, round(avg(k), 6) as mean, median(k)::double as median, min(k)::bigint as min, max(k)::bigint as max, round(stddev_pop(k), 6) as std from (select o_custkey, count(*) as k from orders group by 1)")
def _(s, d):
    c = read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return c.agg(F.count("*").alias("n"), r6(F.avg("k"), "mean"), F.median("k").cast("double").alias("median"), F.min("k").alias("min"), F.max("k").alias("max"), r6(F.stddev_pop("k"), "std"))


X = "with o as (select c_nationkey as a, c_mktsegment as b, count(*) as overlap from customer group by all), s as (select *, sum(overlap) over (partition by a) as size_a, sum(overlap) over (partition by b) as size_b from o)\n"


def _cross(s, d):
    return L.overlap(read(s, d, "customer"), "c_nationkey", "c_mktsegment")


@register("agg_best_match", X + """select side, key, partner, overlap::bigint as overlap, size::bigint as size, round(100 * overlap / size, 1) as pct from (
 select 'a' as side, a::varchar as key, b as partner, overlap, size_a as size, row_number() over (partition by a order by overlap desc, b) as rn from s
 union all select 'b', b, a::varchar, overlap, size_b, row_number() over (partition by b order by overlap desc, a) from s) where rn = 1""")
def _(s, d):
    o = _cross(s, d)

    def side(name, x, y, size):
        t = L.representative(o, [x], [F.desc("overlap"), F.col(y)])
        return t.select(F.lit(name).alias("side"), F.col(x).cast("string").alias("key"), F.col(y).cast("string").alias("partner"), "overlap", F.col(size).alias("size"), F.round(100 * F.col("overlap") / F.col(size), 1).alias("pct"))

    return side("a", "a", "b", "size_a").unionByName(side("b", "b", "a", "size_b"))


@register("agg_orphans", X + "select a, count(*)::bigint as n_overlaps, sum(overlap)::bigint as size from s group by a having count(*) <= 5")
def _(s, d):
    return _cross(s, d).groupBy("a").agg(F.count("*").alias("n_overlaps"), F.sum("overlap").alias("size")).where("n_overlaps <= 5")


@register("agg_fragmentation_hist", "select m::bigint as n_mapped, count(*)::bigint as n_clusters from (select o_custkey, count(distinct o_orderpriority) as m from orders group by 1) group by m")
def _(s, d):
    return read(s, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_mapped")).groupBy("n_mapped").agg(F.count("*").alias("n_clusters"))


@register("agg_overlap_edges", X + """select a, b, overlap::bigint as overlap, round(100 * overlap / size_a, 6) as pct_a, round(100 * overlap / size_b, 6) as pct_b from s
where a in (select a from (select distinct a, size_a from s) order by size_a desc, a limit 10) and (overlap >= 0.2 * size_a or overlap >= 0.05 * size_b)""")
def _(s, d):
    o = _cross(s, d)
    top = o.select("a", "size_a").distinct().orderBy(F.desc("size_a"), "a").limit(10).select("a")
    keep = (F.col("overlap") >= 0.2 * F.col("size_a")) | (F.col("overlap") >= 0.05 * F.col("size_b"))
    return o.join(top, "a", "left_semi").where(keep).select("a", "b", "overlap", r6(100 * F.col("overlap") / F.col("size_a"), "pct_a"), r6(100 * F.col("overlap") / F.col("size_b"), "pct_b"))


@register("agg_majority", X + "select a, arg_min(b, (-overlap, b)) as partner, max(overlap)::bigint as n, round(100 * max(overlap) / sum(overlap), 6) as pct from s group by a")
def _(s, d):
    best = F.min(F.struct((-F.col("overlap")).alias("s"), F.col("b").alias("t")))
    return _cross(s, d).groupBy("a").agg(best["t"].alias("partner"), F.max("overlap").alias("n"), r6(100 * F.max("overlap") / F.sum("overlap"), "pct"))


@register("agg_crosstab", "select a, b, (select count(*) from customer where c_nationkey = a and c_mktsegment = b)::bigint as overlap from (select distinct c_nationkey as a from customer), (select distinct c_mktsegment as b from customer)")
def _(s, d):
    return L.full_crosstab(read(s, d, "customer"), "c_nationkey", "c_mktsegment")


@register("agg_mean_std", "select p_brand as grp, p_size as eps, round(avg(p_retailprice), 6) as mean, round(stddev_samp(p_retailprice), 6) as std from part group by all")
def _(s, d):
    return read(s, d, "part").groupBy(F.col("p_brand").alias("grp"), F.col("p_size").alias("eps")).agg(r6(F.avg("p_retailprice"), "mean"), r6(F.stddev_samp("p_retailprice"), "std"))


@register("agg_pivot", "select p_type, " + ", ".join(f"round(avg(p_retailprice) filter (p_size = {k}), 6) as s{k}" for k in range(1, 6)) + " from part group by p_type")
def _(s, d):
    t = read(s, d, "part").where(F.col("p_size").between(1, 5)).groupBy("p_type").pivot("p_size", [1, 2, 3, 4, 5]).agg(F.round(F.avg("p_retailprice"), 6))
    every = read(s, d, "part").select("p_type").distinct()
    return every.join(t, "p_type", "left").select("p_type", *[F.col(str(k)).alias(f"s{k}") for k in range(1, 6)])


@register("agg_unpivot", "select metric, round(value, 6) as value from (select avg(p_retailprice) as mean, min(p_retailprice) as low, max(p_retailprice) as high from part) unpivot (value for metric in (mean, low, high))")
def _(s, d):
    t = read(s, d, "part").agg(F.avg("p_retailprice").alias("mean"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return t.unpivot([], ["mean", "low", "high"], "metric", "value").select("metric", r6("value", "value"))


@register("agg_split_log", """with g as (select o_custkey, count(distinct o_orderpriority) as k from orders group by 1)
select k::bigint as degree, count(*)::bigint as n, sum(count(*)) over ()::bigint as n_split, max(k) over ()::bigint as max_sub from g where k > 1 group by k""")
def _(s, d):
    g = read(s, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("degree")).where("degree > 1").groupBy("degree").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return g.select("degree", "n", F.sum("n").over(every).alias("n_split"), F.max("degree").over(every).alias("max_sub"))


@register("agg_glossary_coverage", K + "select round(sum(n) filter (b > 20) / sum(n), 6) as coverage from (select l, sum(n) as n, max(n) as b from (select cluster, l, count(*) as n from k where l <> '▯' group by all) group by l)")
def _(s, d):
    b = L.biggest_cluster(patches(s, d))
    return b.agg(r6(F.sum(F.when(F.col("biggest") > 20, F.col("occurrences"))) / F.sum("occurrences"), "coverage"))


REASON = "case when l_quantity < 5 then 'too_small' when l_quantity > 45 then 'too_large' when l_extendedprice < 5000 then 'area_too_small' end"


def _reason():
    return F.when(F.col("l_quantity") < 5, "too_small").when(F.col("l_quantity") > 45, "too_large").when(F.col("l_extendedprice") < 5000, "area_too_small")


@register("agg_delete_reasons", f"select coalesce({REASON}, 'kept') as reason, count(*)::bigint as n, (select count(*) from lineitem)::bigint as initial from lineitem group by 1")
def _(s, d):
    t = read(s, d, "lineitem").groupBy(F.coalesce(_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return t.withColumn("initial", F.sum("n").over(Window.partitionBy()))


@register("filter_first_reason", f"select l_orderkey, l_linenumber, {REASON} as reason from lineitem where {REASON} is not null")
def _(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", _reason().alias("reason")).where("reason is not null")


@register("agg_distinct", "select p_name as label, count(*)::bigint as n, count(distinct p_brand)::bigint as n_clusters from part group by 1 order by n desc, label limit 20")
def _(s, d):
    return read(s, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_clusters")).orderBy(F.desc("n"), "label").limit(20)


@register("agg_corpus_macros", P + "select count(*)::bigint as n_patches, count(distinct page)::bigint as n_pages, count(distinct cluster)::bigint as n_clusters, count(distinct label) filter (coalesce(label, '▯') <> '▯')::bigint as n_glossary from p")
def _(s, d):
    """Numbers that a text about the corpus cites; the glossary counts known labels."""
    known_label = F.when(known(F.col("label")), F.col("label"))
    return patches(s, d).agg(F.count("*").alias("n_patches"), F.count_distinct("page").alias("n_pages"), F.count_distinct("cluster").alias("n_clusters"), F.count_distinct(known_label).alias("n_glossary"))


@register("agg_algorithm_summary", "select l_returnflag as algorithm, count(*)::bigint as n_runs, sum((l_quantity * 100)::bigint) / 100.0::double as total_time, round(sum((l_quantity * 100)::bigint) / 100.0::double / count(*), 6) as mean_time, min(l_quantity) as min_time, max(l_quantity) as max_time, round(avg(l_linenumber), 6) as mean_clusters, min(l_linenumber)::bigint as min_clusters, max(l_linenumber)::bigint as max_clusters from lineitem group by 1")
def _(s, d):
    """Times and cluster counts of each algorithm's runs; times add up in hundredths, alike in any order."""
    t, n = F.col("l_quantity"), F.col("l_linenumber")
    total = F.sum(F.round(t * 100).cast("long")) / 100.0
    return read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("algorithm")).agg(
        F.count("*").alias("n_runs"), total.alias("total_time"), F.round(total / F.count("*"), 6).alias("mean_time"), F.min(t).alias("min_time"), F.max(t).alias("max_time"),
        F.round(F.avg(n), 6).alias("mean_clusters"), F.min(n).cast("long").alias("min_clusters"), F.max(n).cast("long").alias("max_clusters"),
    )


@register("agg_fragmented", "select l_returnflag as label, count(distinct l_suppkey)::bigint as n_clusters from lineitem group by 1 having count(distinct l_suppkey) > 1")
def _(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count_distinct("l_suppkey").alias("n_clusters")).where("n_clusters > 1").orderBy(F.desc("n_clusters"), "label")


@register("agg_mean_vector", "select label, pos::int as pos, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all")
def _(s, d):
    t = read(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return t.groupBy("label", "pos").agg(r6(F.avg(F.col("x").cast("double")), "mean"))


@register("agg_circular_mean", """select l_suppkey as grp, round(atan2(sum(l_quantity * sin(2 * a)), sum(l_quantity * cos(2 * a))) / 2, 6) as angle
from (select l_suppkey, l_quantity, (l_linenumber * 0.4 + l_discount) as a from lineitem) group by 1""")
def _(s, d):
    a = 2 * (F.col("l_linenumber") * 0.4 + F.col("l_discount"))
    return read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(r6(F.atan2(F.sum(F.col("l_quantity") * F.sin(a)), F.sum(F.col("l_quantity") * F.cos(a))) / 2, "angle"))


@register("agg_bbox_union", "select l_suppkey as grp, min(l_quantity) as left_, min(l_tax) as top, max(l_quantity + l_linenumber) as right_, max(l_tax + l_discount) as bottom from lineitem group by 1")
def _(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(
        F.min("l_quantity").alias("left_"), F.min("l_tax").alias("top"), F.max(F.col("l_quantity") + F.col("l_linenumber")).alias("right_"), F.max(F.col("l_tax") + F.col("l_discount")).alias("bottom")
    )


@register("agg_canvas", "select (ceil(max(p_size) / 16.0) * 16)::bigint as width, (ceil(max(p_retailprice) / 16.0) * 16)::bigint as height from part")
def _(s, d):
    from patchweave.functions.scalar import round_up

    return read(s, d, "part").agg(round_up(F.max("p_size"), 16).alias("width"), round_up(F.max("p_retailprice"), 16).alias("height"))


@register("agg_barycenter", "select l_orderkey, (sum((l_quantity * l_linenumber * 100)::decimal(20, 0)) / sum((l_quantity * 100)::decimal(20, 0)))::double as cx, (sum((l_quantity * l_tax * 10000)::decimal(20, 0)) / sum((l_quantity * 10000)::decimal(20, 0)))::double as cy from lineitem group by 1")
def _(s, d):
    # whole numbers add up alike in any order
    total = lambda x, k: F.sum(F.round(x * k).cast("decimal(20,0)")).cast("double")
    q = F.col("l_quantity")
    return read(s, d, "lineitem").groupBy("l_orderkey").agg((total(q * F.col("l_linenumber"), 100) / total(q, 100)).alias("cx"), (total(q * F.col("l_tax"), 10_000) / total(q, 10_000)).alias("cy"))


@register("hist_cumulative", """with h as (select least(floor(value / 10), 49)::int as bin, count(*) as n from events group by 1)
select bin, n::bigint as n, sum(n) over (order by bin desc)::bigint as at_least, round(sum(n) over (order by bin desc) / (select count(distinct user_id) from events), 6) as average from h""")
def _(s, d):
    e = read(s, d, "events")
    h = e.groupBy(F.least(F.floor(F.col("value") / 10), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    k = e.agg(F.count_distinct("user_id").alias("k"))
    up = F.sum("n").over(Window.orderBy(F.desc("bin")))
    return h.crossJoin(F.broadcast(k)).select("bin", "n", up.alias("at_least"), r6(up / F.col("k"), "average"))


@register("agg_component_stats", "select l_suppkey as label, min(l_linenumber) as left_, min(l_quantity) as top, (max(l_linenumber) - min(l_linenumber) + 1)::int as width, max(l_quantity) - min(l_quantity) + 1 as height, count(*)::bigint as area from lineitem group by 1")
def _(s, d):
    x, y = "l_linenumber", "l_quantity"
    return read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(
        F.min(x).alias("left_"), F.min(y).alias("top"), (F.max(x) - F.min(x) + 1).cast("int").alias("width"), (F.max(y) - F.min(y) + 1).alias("height"), F.count("*").alias("area")
    )


@register("agg_corr", "select round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def _(s, d):
    return read(s, d, "lineitem").agg(r6(F.corr("l_quantity", "l_extendedprice"), "r"))


@register("agg_config_kv", "select key, value from (select count(*)::varchar as n_parts, min(p_size)::varchar as min_size, max(p_brand) as last_brand from part) unpivot (value for key in (n_parts, min_size, last_brand))")
def _(s, d):
    t = read(s, d, "part").agg(F.count("*").cast("string").alias("n_parts"), F.min("p_size").cast("string").alias("min_size"), F.max("p_brand").alias("last_brand"))
    return t.unpivot([], t.columns, "key", "value")


@register("agg_step_summary", "select o_orderstatus as step, count(*)::bigint as actions, (count(*) filter (o_totalprice > 250000))::bigint as accepted, round(sum(o_totalprice), 2) as source_size from orders group by 1")
def _(s, d):
    return read(s, d, "orders").groupBy(F.col("o_orderstatus").alias("step")).agg(F.count("*").alias("actions"), F.count_if(F.col("o_totalprice") > 250000).alias("accepted"), F.round(F.sum("o_totalprice"), 2).alias("source_size"))


@register("agg_dashboard", K + """select count(distinct cluster)::bigint as clusters, (count(*) filter (l <> '▯'))::bigint as known, round(100 * count(*) filter (l <> '▯') / count(*), 6) as known_pct,
 (select count(*) from (select o_custkey from orders group by 1 having count(*) = 1))::bigint as singletons from k""")
def _(s, d):
    one = read(s, d, "orders").groupBy("o_custkey").count().where("count = 1").agg(F.count("*").alias("singletons"))
    k = F.count_if(known(F.col("label")))
    return patches(s, d).agg(F.count_distinct("cluster").alias("clusters"), k.alias("known"), r6(100 * k / F.count("*"), "known_pct")).crossJoin(one)


@register("agg_split_breakdown", K.rstrip() + """, c as (select cluster as parent, page % 3 as sub, l, count(*) as n from k group by all)
select parent, sub, sum(n)::bigint as size, coalesce(arg_min(l, (-n, l)) filter (l <> '▯'), '▯') as dominant, round(max(n) filter (l <> '▯') / sum(n) filter (l <> '▯'), 6) as purity from c group by parent, sub""")
def _(s, d):
    t = patches(s, d).withColumn("sub", F.col("page") % 3).withColumn("key", F.struct(F.col("cluster").alias("parent"), "sub"))
    return L.cluster_purity(t, "key").select("cluster.parent", "cluster.sub", "size", "dominant", r6("purity", "purity"))


@register("agg_community_matches", """with q as (select event_type as c from events where event_id = 7)
select count(*)::bigint as size, (count(*) filter (value > 250))::bigint as accepted, (count(*) filter (value > 250 and event_type = (select c from q)))::bigint as accepted_same,
 (count(*) filter (value > 250 and event_type <> (select c from q)))::bigint as accepted_other,
 (select count(*) from (select event_type from events order by value desc, event_id limit 100) where event_type = (select c from q))::bigint as same_in_top from events""")
def _(s, d):
    e = read(s, d, "events")
    q = e.where("event_id = 7").select(F.col("event_type").alias("c"))
    t = e.crossJoin(F.broadcast(q))
    same, ok = F.col("event_type") == F.col("c"), F.col("value") > 250
    top = e.orderBy(F.desc("value"), "event_id").limit(100).crossJoin(F.broadcast(q)).agg(F.count_if(same).alias("same_in_top"))
    return t.agg(F.count("*").alias("size"), F.count_if(ok).alias("accepted"), F.count_if(ok & same).alias("accepted_same"), F.count_if(ok & ~same).alias("accepted_other")).crossJoin(top)


@register("agg_mismatch", P + """select (count(*) filter (length(coalesce(label, '')) > length(coalesce(label2, ''))))::bigint as more, (count(*) filter (length(coalesce(label, '')) < length(coalesce(label2, ''))))::bigint as less,
 (count(*) filter (length(coalesce(label, '')) = length(coalesce(label2, ''))))::bigint as matched from p""")
def _(s, d):
    a, b = F.length(F.coalesce("label", F.lit(""))), F.length(F.coalesce("label2", F.lit("")))
    return patches(s, d).agg(F.count_if(a > b).alias("more"), F.count_if(a < b).alias("less"), F.count_if(a == b).alias("matched"))


@register("agg_within_sum", """with m as (select doc_id as id, source from documents), pairs as (select a.doc_id as i, b.doc_id as j, 1.0 / (1 + abs(a.n_chars - b.n_chars)) as w from documents a join documents b on a.lang = b.lang and a.doc_id % 25 = b.doc_id % 25),
n as (select source, count(*) as k from documents group by 1)
select n.source as cluster, round(case when k < 2 then 0 else coalesce(sum(w), 0) end, 6) as total from n left join (select x.source, w from pairs join m x on i = x.id join m y on j = y.id where x.source = y.source) using (source) group by n.source, k""")
def _(s, d):
    m = read(s, d, "documents").select("doc_id", "source", "lang", "n_chars", (F.col("doc_id") % 25).alias("g"))
    a, b = m.alias("a"), m.alias("b")
    w = 1.0 / (1 + F.abs(F.col("a.n_chars") - F.col("b.n_chars")))
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.source") == F.col("b.source"))).groupBy(F.col("a.source").alias("cluster")).agg(F.sum(w).alias("t"))
    n = m.groupBy(F.col("source").alias("cluster")).agg(F.count("*").alias("k"))
    return n.join(pairs, "cluster", "left").select("cluster", r6(F.when(F.col("k") < 2, 0.0).otherwise(F.coalesce("t", F.lit(0.0))), "total"))


# -- windows, ranking, top-k -----------------------------------------------------------------------------------------
@register("win_group_size", "select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey)::bigint as n from lineitem")
def _(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))


@register("filter_group_size", "select o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 2)")
def _(s, d):
    o = read(s, d, "orders")
    return o.withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).where("n >= 2").select("o_orderkey")


@register("win_representative", P + "select cluster, id, value from (select *, row_number() over (partition by cluster order by value desc, strength desc, id) as rn from p) where rn = 1")
def _(s, d):
    return L.representative(patches(s, d), ["cluster"], [F.desc("value"), F.desc("strength"), F.col("id")]).select("cluster", "id", "value")


@register("win_rep_cluster_label", K + "select cluster, l as label, id from (select *, row_number() over (partition by cluster, l order by value desc, strength desc, id) as rn from k where l <> '▯') where rn = 1")
def _(s, d):
    return L.representative(patches(s, d).where(known(F.col("label"))), ["cluster", "label"], [F.desc("value"), F.desc("strength"), F.col("id")]).select("cluster", "label", "id")


@register("win_glossary", K.rstrip() + """, c as (select l, cluster, count(*) as n_chars_c from k where l <> '▯' group by all), s as (select cluster, sum(strength) as strength, count(*) as n_c from p group by 1),
b as (select *, row_number() over (partition by l order by n_chars_c desc, round(strength, 6) desc, cluster) as rn, sum(n_chars_c) over (partition by l) as n from c join s using (cluster)),
r as (select cluster, arg_min(id, (-value, -strength, id)) as rep from p group by 1)
select l as label, n::bigint as n, cluster, n_chars_c::bigint as n_chars_c, n_c::bigint as n_c, rep from b join r using (cluster) where rn = 1""")
def _(s, d):
    return L.glossary(patches(s, d).withColumnRenamed("value", "centrality"))


@register("win_reading_order", "select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) + coalesce((select sum(n) from (select o_custkey as c, count(*) as n from orders group by 1) where c < o_custkey), 0))::bigint as reading_order from orders")
def _(s, d):
    o = read(s, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    off = L.running_offset(n, "o_custkey", "n").select("o_custkey", F.col("offset").alias("off"))
    return o.join(off, "o_custkey").select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) + F.col("off")).cast("long").alias("reading_order"))


@register("sort_nulls_last", P + "select page, id, label from p order by page, label nulls last, id")
def _(s, d):
    return patches(s, d).select("page", "id", "label").orderBy("page", F.asc_nulls_last("label"), "id")


@register("sort_multi", P + "select cluster, id, value from p order by cluster, value desc, id")
def _(s, d):
    return patches(s, d).select("cluster", "id", "value").orderBy("cluster", F.desc("value"), "id")


@register("topk_per_group", P + "select cluster, id, rn::int as rank from (select *, row_number() over (partition by cluster order by value desc, id) as rn from p) where rn <= 5")
def _(s, d):
    return L.top_per_group(patches(s, d), ["cluster"], [F.desc("value"), F.col("id")], 5).select("cluster", "id", "rank")


@register("topk_best_per_group", "select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part) where rn = 1")
def _(s, d):
    return L.representative(read(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@register("topk_slices", """with g as (select p_name as label, count(*) as n, count(distinct p_brand) as n_c from part group by 1)
(select 'most' as slice, label, n::bigint as n from g order by n desc, label limit 10) union all (select 'least', label, n::bigint from g order by n, label limit 10) union all (select 'two', label, n::bigint from g where n_c = 2)""")
def _(s, d):
    g = read(s, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_c"))
    tag = lambda t, df: df.select(F.lit(t).alias("slice"), "label", "n")
    return tag("most", g.orderBy(F.desc("n"), "label").limit(10)).unionByName(tag("least", g.orderBy("n", "label").limit(10))).unionByName(tag("two", g.where("n_c = 2")))


@register("topk_multi", """(select 'price' as by, p_partkey from part order by p_retailprice desc, p_partkey limit 5) union all (select 'size', p_partkey from part order by p_size, p_partkey limit 5)
union all (select 'efficiency', p_partkey from part order by round(p_retailprice / (p_size + 1), 6) desc, p_partkey limit 5)""")
def _(s, d):
    p = read(s, d, "part")
    take = lambda name, *o: p.orderBy(*o, "p_partkey").limit(5).select(F.lit(name).alias("by"), "p_partkey")
    return take("price", F.desc("p_retailprice")).unionByName(take("size", F.col("p_size"))).unionByName(take("efficiency", F.round(F.col("p_retailprice") / (F.col("p_size") + 1), 6).desc()))


@register("win_cumsum_first", """with c as (select p_brand, count(*) as n from part group by 1), r as (select *, sum(n) over (order by n desc, p_brand) / (select count(*) from part) as share, row_number() over (order by n desc, p_brand) as k from c)
select min(k)::int as first_k from r where share >= 0.95""")
def _(s, d):
    c = read(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "p_brand")
    total = F.sum("n").over(Window.partitionBy())
    return c.select((F.sum("n").over(w) / total).alias("share"), F.row_number().over(w).alias("k")).where("share >= 0.95").agg(F.min("k").alias("first_k"))


@register("sample_hash", "select event_id from events order by md5(event_id::varchar || ':42'), event_id limit 50")
def _(s, d):
    return read(s, d, "events").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":42"))), "event_id").limit(50).select("event_id")


CAT = K.rstrip() + """, c as (select l, cluster, count(*) as n from k where l <> '▯' group by all), t as (select *, sum(n) over (partition by l) as freq, count(*) over (partition by l) as n_clusters, row_number() over (partition by l order by n desc, cluster) as cr from c)
"""


def _catalogue(s, d):
    c = L.contingency(patches(s, d), keep_unknown=False)
    w = Window.partitionBy("label")
    return c.withColumns({"freq": F.sum("n").over(w), "n_clusters": F.count("*").over(w), "cr": F.row_number().over(w.orderBy(F.desc("n"), "cluster"))})


@register("topk_catalogue", CAT + "select l as label, cluster, n::bigint as n, freq::bigint as freq, case when n_clusters = 1 then '1' when n_clusters <= 3 then '2-3' else '4+' end as band from t where cr <= 60")
def _(s, d):
    band = F.when(F.col("n_clusters") == 1, "1").when(F.col("n_clusters") <= 3, "2-3").otherwise("4+")
    return _catalogue(s, d).where("cr <= 60").select("label", "cluster", "n", "freq", band.alias("band")).orderBy(F.desc("freq"), "label", F.desc("n"), "cluster")


@register("topk_gallery", CAT + """select l as label, id, palette from (select t.l, k.id, ((t.cr - 1) % 10)::int as palette, row_number() over (partition by t.l order by t.cr, k.value desc, k.id) as rn from t join k on t.l = k.l and t.cluster = k.cluster) where rn <= 80""")
def _(s, d):
    t = _catalogue(s, d).select("label", "cluster", "cr")
    j = patches(s, d).join(t, ["label", "cluster"])
    return L.top_per_group(j, ["label"], [F.col("cr"), F.desc("value"), F.col("id")], 80).select("label", "id", ((F.col("cr") - 1) % 10).cast("int").alias("palette"))


@register("topk_partner_search", X + "select b as partner, overlap::bigint as overlap, round(100 * overlap / size_a, 1) as pct from s where a = 3 and overlap > 0 order by overlap desc, b limit 10")
def _(s, d):
    return _cross(s, d).where("a = 3 and overlap > 0").orderBy(F.desc("overlap"), "b").limit(10).select(F.col("b").alias("partner"), "overlap", F.round(100 * F.col("overlap") / F.col("size_a"), 1).alias("pct"))


@register("win_renumber", "select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::int as cluster from customer")
def _(s, d):
    c = read(s, d, "customer")
    ids = c.select("c_mktsegment").distinct().withColumn("cluster", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1)
    return c.join(ids, "c_mktsegment").select("c_custkey", "cluster")


ISL = """with x as (select distinct user_id, date_diff('hour', timestamp '2020-01-01', ts) as h from events),
r as (select *, case when h - lag(h) over (partition by user_id order by h) <= {gap} then 0 else 1 end as new from x), g as (select *, sum(new) over (partition by user_id order by h) as run from r)
select user_id, run::bigint as run, min(h)::bigint as start_, max(h)::bigint as stop_, count(*)::bigint as n from g group by user_id, run"""


def islands(df: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """Runs of positions that are at most ``gap`` apart: start_, stop_, n, numbered from 1 within ``by``."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.select(by, at).distinct().withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(by, "run").agg(F.min(at).alias("start_"), F.max(at).alias("stop_"), F.count("*").alias("n"))


def _hours(s, d):
    return read(s, d, "events").select("user_id", F.expr("timestampdiff(HOUR, timestamp'2020-01-01', date_trunc('hour', ts))").cast("long").alias("h"))


@register("win_islands", ISL.format(gap=1))
def _(s, d):
    return islands(_hours(s, d), "user_id", "h", 1)


@register("win_merge_gaps", ISL.format(gap=6))
def _(s, d):
    return islands(_hours(s, d), "user_id", "h", 6)


@register("win_change_groups", """with x as (select conv_id, turn, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as new, role from conversations)
select conv_id, turn, sum(new) over (partition by conv_id order by turn)::bigint as block from x""")
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(s, d, "conversations").withColumn("new", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    return t.select("conv_id", "turn", F.sum("new").over(w).alias("block"))


# -- sets ------------------------------------------------------------------------------------------------------------
@register("set_union", "select c_nationkey as k, 'c' as side from customer union all select s_nationkey, 's' from supplier")
def _(s, d):
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionByName(read(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")))


@register("set_intersect", "select l_orderkey from lineitem where l_returnflag = 'R' intersect select l_orderkey from lineitem where l_linestatus = 'F'")
def _(s, d):
    t = read(s, d, "lineitem")
    return t.where("l_returnflag = 'R'").select("l_orderkey").intersect(t.where("l_linestatus = 'F'").select("l_orderkey"))


@register("set_except", "select o_orderkey from orders except select l_orderkey from lineitem where l_returnflag = 'R'")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey").subtract(read(s, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"))


@register("set_distinct_ordered", "select p_name, min(p_partkey)::bigint as first_at from part group by 1")
def _(s, d):
    return read(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first_at")).orderBy("first_at")


@register("set_grid", "select distinct p_brand, n_name, r_name from (select distinct p_brand from part), nation, region")
def _(s, d):
    return read(s, d, "part").select("p_brand").distinct().crossJoin(F.broadcast(read(s, d, "nation").select("n_name"))).crossJoin(F.broadcast(read(s, d, "region").select("r_name"))).distinct()


@register("report_truncate", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def _(s, d):
    return read(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


# -- metrics ---------------------------------------------------------------------------------------------------------
PAIRS = K.rstrip() + """, c as (select cluster, l, count(*)::double as n from k where l <> '▯' group by all), a as (select l, sum(n) as n, max(n) as m from c group by 1), b as (select cluster, sum(n) as n, max(n) as m from c group by 1),
z as (select (select sum(n) from c) as n, (select sum(n * (n - 1) / 2) from c) as s, (select sum(n * (n - 1) / 2) from a) as a2, (select sum(n * (n - 1) / 2) from b) as b2,
 (select sum(n * ln(n)) from c) as hij, (select sum(n * ln(n)) from a) as ha_, (select sum(n * ln(n)) from b) as hb_, (select sum(m) from b) as mb, (select sum(m) from a) as ma),
y as (select *, ln(n) - ha_ / n as ha, ln(n) - hb_ / n as hb, greatest(hij / n - ha_ / n - hb_ / n + ln(n), 0) as mi, a2 * b2 / (n * (n - 1) / 2) as e from z)
"""
for _name, _cols, _sql in [
    ("metric_ari", ["ari"], "round((s - e) / ((a2 + b2) / 2 - e), 6) as ari"),
    ("metric_nmi", ["nmi"], "round(2 * mi / (ha + hb), 6) as nmi"),
    ("metric_fmi", ["fmi"], "round(s / sqrt(a2 * b2), 6) as fmi"),
    ("metric_vmeasure", ["homogeneity", "completeness", "v_measure"], "round(mi / ha, 6) as homogeneity, round(mi / hb, 6) as completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) as v_measure"),
    ("metric_purity", ["purity", "inverse_purity"], "round(mb / n, 6) as purity, round(ma / n, 6) as inverse_purity"),
    ("metric_pair_f1", ["pair_f1"], "round(2 * s / (a2 + b2), 6) as pair_f1"),
]:
    register(_name, PAIRS + f"select {_sql} from y")(lambda s, d, cols=_cols: M.scores(patches(s, d)).select(*[r6(c, c) for c in cols]))


@register("metric_noise", P + "select round(avg((label is null)::int), 6) as noise from p")
def _(s, d):
    return patches(s, d).agg(r6(F.avg(F.col("label").isNull().cast("int")), "noise"))


@register("metric_ocr_baseline", P + "select round(count(*) filter (label = label2) / count(*), 6) as accuracy, 1.0::double as baseline_ari from p where coalesce(label, '▯') <> '▯' and label2 = label")
def _(s, d):
    t = patches(s, d).withColumn("c", consensus(F.col("label"), F.col("label2"))).where(known(F.col("c")))
    return t.agg(r6(F.count_if(F.col("label") == F.col("label2")) / F.count("*"), "accuracy")).crossJoin(M.scores(t, "label2", "c").select(r6("ari", "baseline_ari")))


MULTI = P.rstrip() + """, u as (select 'label' as col, cluster, label as l from p union all select 'label2', cluster, label2 from p), c as (select col, cluster, l, count(*)::double as n from u where coalesce(l, '▯') <> '▯' group by all),
a as (select col, l, sum(n) as n from c group by all), b as (select col, cluster, sum(n) as n, max(n) as m from c group by all),
ca as (select col, sum(n) as n, sum(n * (n - 1) / 2) as s, sum(n * ln(n)) as hij from c group by col), aa as (select col, sum(n * (n - 1) / 2) as a2, sum(n * ln(n)) as ha_ from a group by col), bb as (select col, sum(n * (n - 1) / 2) as b2, sum(n * ln(n)) as hb_, sum(m) as mb from b group by col),
y as (select *, ln(n) - ha_ / n as ha, ln(n) - hb_ / n as hb, hij / n - ha_ / n - hb_ / n + ln(n) as mi, a2 * b2 / (n * (n - 1) / 2) as e from ca join aa using (col) join bb using (col))
select col, round((s - e) / ((a2 + b2) / 2 - e), 6) as ari, round(2 * mi / (ha + hb), 6) as nmi, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) as v_measure, round(mb / n, 6) as purity from y"""


@register("metric_multi_label", MULTI)
def _(s, d):
    t = patches(s, d).select("cluster", F.explode(F.array(F.struct(F.lit("label").alias("col"), F.col("label").alias("v")), F.struct(F.lit("label2").alias("col"), F.col("label2").alias("v")))).alias("x")).select("cluster", "x.*")
    return M.scores(t, "cluster", "v", ["col"]).select("col", *[r6(c, c) for c in ("ari", "nmi", "v_measure", "purity")])


@register("metric_ami")
def _(s, d):
    m, _, _ = M.table_of(patches(s, d))
    return s.createDataFrame([(round(M.ami(m), 6),)], "ami double")


@register("metric_hungarian")
def _(s, d):
    m, _, _ = M.table_of(patches(s, d))
    return s.createDataFrame([(round(M.hungarian_accuracy(m), 6),)], "accuracy double")


@register("metric_per_class")
def _(s, d):
    m, labels, _ = M.table_of(patches(s, d))
    return s.createDataFrame(M.per_class(m, labels), "label string, precision double, recall double, f1 double")


@register("agg_pipeline_metrics", PAIRS + "select 'baseline' as step, round((s - e) / ((a2 + b2) / 2 - e), 4) as ari, round(mb / n, 4) as purity from y union all select 'label', 1.0, 1.0")
def _(s, d):
    p = patches(s, d)
    one = lambda name, df, c: M.scores(df, c, "label").select(F.lit(name).alias("step"), F.round("ari", 4).alias("ari"), F.round("purity", 4).alias("purity"))
    return one("baseline", p, "cluster").unionByName(one("label", p.withColumn("l2", F.col("label")), "l2"))


@register("vote_ensemble", """with v as (select event_id % 500 as item, event_type as label, case when event_id % 3 = 0 then 0.0 else value end as weight from events),
t as (select item, label, sum(weight) as w from v group by all), x as (select item, sum(w) as total, count(*) filter (w > 0) as k, arg_min(label, (-w, label)) filter (w > 0) as best from t group by 1)
select item, coalesce(best, '') as winner, round(case when k = 0 then 1.0 when k = 1 then 0.0 else (select -sum(w / total * ln(w / total)) from t where t.item = x.item and w > 0) / ln(k) end, 6) as uncertainty from x""")
def _(s, d):
    i = F.col("event_id")
    v = read(s, d, "events").select((i % 500).alias("item"), F.col("event_type").alias("label"), F.when(i % 3 == 0, 0.0).otherwise(F.col("value")).alias("weight"))
    return L.vote(v).withColumn("uncertainty", F.round("uncertainty", 6))
