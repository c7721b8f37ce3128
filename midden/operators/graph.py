"""Edges from neighbours and co-binning, their weights, and what partitions make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Contigs of one class that become pairs with another unit's at once, and units of a bin that one task buffers.
UNIT, UNITS = 256, 128


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def cutoff(edges: DataFrame, ratio: int, d: str = "d") -> DataFrame:
    """(cutoff): the distance of index floor(ratio * n / 100) in ascending order, the last at most.

    By a histogram of distinct distances, which adds up before it is ordered; no task sorts all edges.
    """
    hist = edges.groupBy(d).agg(F.count(F.lit(1)).alias("n"))
    part = hist.withColumn("part", F.floor(F.log2(F.col(d) + 1e-12) * 64))
    sums = part.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
    run = part.join(F.broadcast(sums), "part").withColumn("cum", F.col("base") + F.sum("n").over(within))
    total = hist.agg(F.sum("n").alias("total"))
    at = F.least(F.floor(F.lit(ratio) * F.col("total") / 100), F.col("total") - 1)
    return run.join(F.broadcast(total)).where(F.col("cum") > at).agg(F.min(d).alias("cutoff"))


def kernel_edges(neighbours: DataFrame, ratio: int, bandwidth: float) -> DataFrame:
    """(u, v, d, w) of (i, j, d) up to the cutoff, once a pair with u > v, weighted by exp(-d / bandwidth)."""
    kept = neighbours.join(F.broadcast(cutoff(neighbours, ratio)), F.col("d") <= F.col("cutoff")).where("i > j")
    return kept.select(F.col("i").alias("u"), F.col("j").alias("v"), "d", F.exp(-F.col("d") / bandwidth).alias("w"))


def symmetric(edges: DataFrame, w: str = "w") -> DataFrame:
    """Each undirected pair once (u < v) with its largest weight."""
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max(w).alias(w))


def cobinned(labels: DataFrame) -> DataFrame:
    """(i, j, together, p) of (run, contig, bin): p = together / least number of runs that have either.

    Contigs of the same bins in all runs are one class, parted into units of about UNIT members. Units that share a bin meet once, in the least
    bin they share, where all that they share is counted; members become pairs there, and no pair is shuffled. Rows without a bin pair with none.
    """
    key = F.when(F.col("run").isNotNull() & F.col("bin").isNotNull(), F.struct("run", "bin"))
    own = labels.where("contig IS NOT NULL").groupBy("contig").agg(F.sort_array(F.collect_list(key)).alias("keys"), F.size(F.collect_set("run")).cast("long").alias("runs"))  # a row a run
    parts = own.groupBy("keys", "runs").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("parts"))
    dealt = own.join(parts, ["keys", "runs"]).withColumn("part", F.pmod(F.xxhash64("contig"), F.col("parts")))
    units = dealt.groupBy("keys", "runs", "part").agg(F.min("contig").alias("unit"), F.collect_list("contig").alias("members"))
    each = units.select("keys", "runs", "unit", "members", F.explode(F.array_distinct("keys")).alias("key"))
    blocks = each.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / UNITS).cast("int").alias("blocks"))
    x = each.join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = each.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")).alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.unit") <= F.col("y.unit")))
    met = met.where(F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    together = F.aggregate("x.keys", F.lit(0), lambda n, k: n + F.size(F.filter("y.keys", lambda o: o == k))).cast("long")
    met = met.select(F.col("x.members").alias("a"), F.col("y.members").alias("b"), (F.col("x.unit") == F.col("y.unit")).alias("one"), together.alias("together"), F.least("x.runs", "y.runs").alias("runs"))
    pairs = met.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).where(~F.col("one") | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "together", (F.col("together") / F.col("runs")).alias("p"), "runs")


def consensus_edges(pairs: DataFrame) -> DataFrame:
    """Pairs together in two thirds of their runs or more; compared in integers."""
    return pairs.where(3 * F.col("together") >= 2 * F.col("runs"))


def shared_markers(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """edges with the number of distinct markers that both ends carry, by two equi-joins."""
    have = hits.select("contig", "marker").distinct()
    met = edges.select("u", "v").join(have.withColumnRenamed("contig", "u"), "u").join(have.withColumnRenamed("contig", "v"), ["v", "marker"])
    counts = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    return edges.join(counts, ["u", "v"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def marker_weight(w: Column, shared: Column, both_have: Column, boost: float = 1.3, penalty: float = 3.0) -> Column:
    """Disjoint markers raise a weight, each shared one lowers it."""
    return F.when(shared > 0, w * F.exp(-penalty * shared)).when(both_have, w * boost).otherwise(w)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of (node, label) on undirected edges (u, v, w)."""
    ends = edges.select(F.col("u").alias("node"), "w").unionAll(edges.select(F.col("v").alias("node"), "w"))
    degree = ends.join(labels, "node").groupBy("label").agg(F.sum("w").alias("degree"))
    named = edges.join(labels.withColumnsRenamed({"node": "u", "label": "lu"}), "u").join(labels.withColumnsRenamed({"node": "v", "label": "lv"}), "v")
    inside = named.groupBy(F.col("lu").alias("label")).agg(F.sum(F.when(F.col("lu") == F.col("lv"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = edges.agg(F.sum("w").alias("m"))
    rows = degree.join(inside, "label", "left").join(F.broadcast(total))
    return rows.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def belonging(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, inside, total, share): how much of a node's edge weight stays in its own label."""
    both = edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    named = both.join(labels.withColumnsRenamed({"node": "u", "label": "lu"}), "u").join(labels.withColumnsRenamed({"node": "v", "label": "lv"}), "v")
    sums = named.groupBy(F.col("u").alias("node")).agg(F.sum(F.when(F.col("lu") == F.col("lv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    return sums.select("node", "inside", "total", (F.col("inside") / F.col("total")).alias("share"))


def idf_pairs(items: DataFrame, most: int = 5) -> DataFrame:
    """(i, j, shared, weight) of contigs that share keys (contig, key) met in 2 to `most` contigs; weight sums ln((n + 1) / (df + 1)).

    A contig brings all of its keys with it, so a pair is weighed once, in the least key that both have; no pair is shuffled.
    """
    have = items.where("contig IS NOT NULL").select("contig", "key").distinct()
    df = have.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, most))
    n = items.agg(F.count_distinct("contig").alias("n"))
    own = have.join(df, "key").groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("key", "df"))).alias("own"))
    each = own.select("contig", F.col("own.key").alias("keys"), F.col("own.df").alias("dfs"), F.explode("own").alias("at")).select("contig", "keys", "dfs", "at.*")
    a, b = each.alias("a"), each.alias("b")
    both = F.array_intersect("a.keys", "b.keys")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.contig") < F.col("b.contig"))).where(both[0] == F.col("a.key"))
    met = met.select(F.col("a.contig").alias("i"), F.col("b.contig").alias("j"), F.col("a.df").alias("df"), F.col("a.keys").alias("keys"), F.col("a.dfs").alias("dfs"), both.alias("both")).join(F.broadcast(n))  # one row
    idf = lambda df: F.log((F.col("n") + 1) / (df + 1))
    shared = F.zip_with("keys", "dfs", lambda k, df: F.when(F.array_contains("both", k), idf(df)).otherwise(0.0))
    weight = F.when(F.size("both") == 1, idf(F.col("df"))).otherwise(F.aggregate(shared, F.lit(0.0), lambda s, x: s + x))
    return met.select("i", "j", F.size("both").cast("long").alias("shared"), weight.alias("weight"))


def marker_separation(neighbours: DataFrame, hits: DataFrame) -> DataFrame:
    """(marker, pairs, apart) of markers on two contigs or more: pairs of carriers, and those where the smaller contig hasn't the greater among its neighbours (i, j).

    Pairs are counted from the sizes; only neighbours that share a marker are rows.
    """
    have = hits.select("contig", "marker").distinct()
    sizes = have.groupBy("marker").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = neighbours.where("i < j").select("i", "j").distinct()
    met = links.join(have.withColumnRenamed("contig", "i"), "i").join(have.withColumnRenamed("contig", "j"), ["j", "marker"])
    near = met.groupBy("marker").agg(F.count(F.lit(1)).alias("near"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return sizes.join(near, "marker", "left").select("marker", pairs.alias("pairs"), (pairs - F.coalesce("near", F.lit(0))).alias("apart"))


def separation_score(separated: DataFrame) -> DataFrame:
    """(score): the share of pairs of carriers that are apart over all markers; 1 without pairs."""
    return separated.agg(F.coalesce(F.sum("apart") / F.sum("pairs"), F.lit(1.0)).alias("score"))
