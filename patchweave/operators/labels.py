"""Label and cluster reports, all from one contingency aggregate (cluster, label, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchweave.functions.scalar import UNKNOWN, entropy_terms, fold_unknown, known


def contingency(df: DataFrame, cluster: str = "cluster", label: str = "label", keep_unknown: bool = True) -> DataFrame:
    t = df.select(F.col(cluster).alias("cluster"), fold_unknown(F.col(label)).alias("label"))
    t = t if keep_unknown else t.where(F.col("label") != UNKNOWN)
    return t.groupBy("cluster", "label").agg(F.count("*").alias("n"))


def best_first(score: Column, tie: Column) -> Column:
    """For max(): larger score first, then the smaller tie value, by max of (score) and min of tie through a struct."""
    return F.struct((-score).alias("s"), tie.alias("t"))


def cluster_purity(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """size, known_size, unknown_count, purity, entropy, norm_entropy, dominant, n_labels of each cluster.

    Unknown labels don't count for purity; a cluster of unknowns alone has purity null, the unknown label and 0.
    Ties of the dominant label go to the smaller one.
    """
    c = contingency(df, cluster, label)
    is_known = F.col("label") != UNKNOWN
    per = c.groupBy("cluster").agg(
        F.sum("n").alias("size"),
        F.coalesce(F.sum(F.when(is_known, F.col("n"))), F.lit(0)).alias("known_size"),
        F.min(F.when(is_known, F.struct((-F.col("n")).alias("s"), F.col("label").alias("t")))).alias("best"),
        F.count_if(is_known).alias("n_labels"),
        F.sum(F.when(is_known, F.col("n") * F.log2("n"))).alias("nlogn"),
    )
    k = F.col("known_size")
    h = F.when(k > 0, F.greatest(F.log2(k) - F.col("nlogn") / k, F.lit(0.0))).otherwise(F.lit(0.0))
    return per.select(
        "cluster", "size", "known_size", (F.col("size") - k).alias("unknown_count"),
        F.when(k > 0, -F.col("best.s") / k).alias("purity"),
        h.alias("entropy"),
        F.when(F.col("n_labels") > 1, h / F.log2("n_labels")).otherwise(F.lit(0.0)).alias("norm_entropy"),
        F.coalesce("best.t", F.lit(UNKNOWN)).alias("dominant"),
        F.col("n_labels").alias("n_labels"),
    )


def biggest_cluster(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Per known label: biggest (most rows in one cluster), occurrences."""
    return contingency(df, cluster, label, False).groupBy("label").agg(F.max("n").alias("biggest"), F.sum("n").alias("occurrences"))


def dominance(df: DataFrame, thresholds=(1, 2, 3, 5, 10, 15, 20), cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Per threshold: share of labels, and of their occurrences, whose biggest cluster reaches it; 0 if there are none."""
    b = biggest_cluster(df, cluster, label)
    t = df.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold int")
    hit = F.col("biggest") >= F.col("threshold")
    return t.join(F.broadcast(b.groupBy("biggest").agg(F.count("*").alias("k"), F.sum("occurrences").alias("o"))), F.lit(True), "left").groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(hit, F.col("k")).otherwise(0)) / F.sum("k"), F.lit(0.0)).alias("label_share"),
        F.coalesce(F.sum(F.when(hit, F.col("o")).otherwise(0)) / F.sum("o"), F.lit(0.0)).alias("occurrence_share"),
    )


def completeness(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Per known label: size, best_share, entropy, norm_entropy, dominant_cluster, n_clusters."""
    per = contingency(df, cluster, label, False).groupBy("label").agg(
        F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("s"), F.col("cluster").alias("t"))).alias("best"), F.count("*").alias("n_clusters"), F.sum(F.col("n") * F.log2("n")).alias("nlogn")
    )
    h = F.greatest(F.log2("size") - F.col("nlogn") / F.col("size"), F.lit(0.0))
    return per.select(
        "label", "size", (-F.col("best.s") / F.col("size")).alias("best_share"), h.alias("entropy"),
        F.when(F.col("n_clusters") > 1, h / F.log2("n_clusters")).otherwise(F.lit(0.0)).alias("norm_entropy"), F.col("best.t").alias("dominant_cluster"), "n_clusters",
    )


def executive_summary(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    p = cluster_purity(df, cluster, label)
    low = lambda s: F.min(F.when(F.col("purity").isNotNull(), F.struct(s.alias("s"), F.col("cluster").alias("t"))))["t"]
    return p.agg(
        F.count("*").alias("n_clusters"), F.avg("purity").alias("mean_purity"), F.avg("size").alias("mean_size"), F.count_if(F.col("size") == 1).alias("n_singletons"),
        low(-F.col("purity")).alias("purest"), low(F.col("purity")).alias("least_pure"), F.min(F.struct((-F.col("size")).alias("s"), F.col("cluster").alias("t")))["t"].alias("largest"),
    )


def representative(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order given."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def glossary(df: DataFrame) -> DataFrame:
    """Per known label: n, its best cluster (most rows of it, then higher strength, then smaller), n_chars_c, n_c, rep.

    ``df`` has id, cluster, label, centrality, strength. The representative is that of the whole best cluster.
    """
    c = df.where(known(F.col("label"))).groupBy("label", "cluster").agg(F.count("*").alias("n_chars_c"))
    s = df.groupBy("cluster").agg(F.sum("strength").alias("strength"), F.count("*").alias("n_c"))
    per = c.join(s, "cluster")
    w = Window.partitionBy("label").orderBy(F.col("n_chars_c").desc(), F.round("strength", 6).desc(), F.col("cluster"))
    best = per.withColumn("rn", F.row_number().over(w)).withColumn("n", F.sum("n_chars_c").over(Window.partitionBy("label"))).where("rn = 1")
    rep = representative(df, ["cluster"], [F.col("centrality").desc(), F.col("strength").desc(), F.col("id")]).select("cluster", F.col("id").alias("rep"))
    return best.join(rep, "cluster").select("label", "n", "cluster", "n_chars_c", "n_c", "rep")


def overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of each pair of clusters of two clusterings, with both sizes."""
    o = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("overlap"))
    return o.withColumn("size_a", F.sum("overlap").over(Window.partitionBy("a"))).withColumn("size_b", F.sum("overlap").over(Window.partitionBy("b")))


def full_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair of the two key sets, zeros included."""
    o = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("overlap"))
    keys = o.select("a").distinct().crossJoin(o.select("b").distinct())
    return keys.join(o, ["a", "b"], "left").select("a", "b", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def vote(votes: DataFrame) -> DataFrame:
    """Weighted vote of several readers (item, label, weight): winner and uncertainty, entropy over ln k.

    One candidate gives 0; no weight at all gives '' and 1. Ties go to the smaller label.
    """
    t = votes.groupBy("item", "label").agg(F.sum("weight").alias("w"))
    per = t.groupBy("item").agg(
        F.sum("w").alias("total"), F.count_if(F.col("w") > 0).alias("k"),
        F.min(F.when(F.col("w") > 0, F.struct((-F.col("w")).alias("s"), F.col("label").alias("t")))).alias("best"),
        F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w")).otherwise(0.0)).alias("wlnw"),
    )
    h = F.ln("total") - F.col("wlnw") / F.col("total")
    return per.select(
        "item", F.coalesce("best.t", F.lit("")).alias("winner"),
        F.when(F.col("k") == 0, 1.0).when(F.col("k") == 1, 0.0).otherwise(F.greatest(h, F.lit(0.0)) / F.ln("k")).alias("uncertainty"),
    )


def running_offset(df: DataFrame, key: str, value: str, buckets: int = 256) -> DataFrame:
    """``df`` with ``offset``: the sum of ``value`` over all rows of smaller ``key`` (numeric).

    Keys are cut in equal ranges; ranges are summed apart and only their totals, ``buckets`` rows, are put in one order.
    """
    lim = F.broadcast(df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")))
    b = F.floor((F.col(key) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * buckets).cast("int")
    t = df.crossJoin(lim).withColumn("_b", b).drop("_lo", "_hi")
    sums = t.groupBy("_b").agg(F.sum(value).alias("_s"))
    base = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_base"))
    before = F.sum(value).over(Window.partitionBy("_b").orderBy(key).rangeBetween(Window.unboundedPreceding, -1))
    return t.join(F.broadcast(base), "_b").withColumn("offset", F.col("_base") + F.coalesce(before, F.lit(0))).drop("_b", "_base")
