"""Completeness and contamination of bins by marker genes, tiers, scores, assembly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marker_counts(hits: DataFrame, bin_: str = "bin", marker: str = "marker") -> DataFrame:
    """(bin, marker, copies): every hit counts, repeats too."""
    return hits.groupBy(bin_, marker).agg(F.count(F.lit(1)).alias("copies"))


def flat_quality(hits: DataFrame, total: int, bin_: str = "bin", marker: str = "marker") -> DataFrame:
    """Per bin: distinct markers, all hits, those in excess, and shares of `total` markers. One aggregation of aggregates."""
    rows = marker_counts(hits, bin_, marker).groupBy(bin_).agg(
        F.count(F.lit(1)).alias("unique_markers"),
        F.sum("copies").alias("hits"),
        F.count_if(F.col("copies") > 1).alias("repeated_markers"),
    )
    return rows.select("*", (F.col("hits") - F.col("unique_markers")).alias("excess"), (100.0 * F.col("unique_markers") / total).alias("completeness"), (100.0 * (F.col("hits") - F.col("unique_markers")) / total).alias("contamination"))


def set_quality(hits: DataFrame, sets: DataFrame, bin_: str = "bin", marker: str = "marker") -> DataFrame:
    """Per bin the mean over marker sets of the present share and of the excess copies a marker.

    sets: (set_id, marker). Only counted markers are joined, so bins x sets is never built; sets without hits add zero.
    """
    sizes = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    n_sets = sizes.agg(F.count(F.lit(1)).alias("n_sets"))
    met = marker_counts(hits, bin_, marker).join(sets.withColumnRenamed("marker", marker), marker)
    by_set = met.groupBy(bin_, "set_id").agg(F.count(F.lit(1)).alias("present"), F.sum(F.col("copies") - 1).alias("extra")).join(sizes, "set_id")
    total = by_set.groupBy(bin_).agg(F.sum(F.col("present") / F.col("size")).alias("s"), F.sum(F.col("extra") / F.col("size")).alias("e"))
    return total.join(F.broadcast(n_sets)).select(bin_, (100.0 * F.col("s") / F.col("n_sets")).alias("completeness"), (100.0 * F.col("e") / F.col("n_sets")).alias("contamination"))


def tier(completeness: Column, contamination: Column) -> Column:
    return F.when((completeness >= 90) & (contamination < 5), "HQ").when((completeness >= 50) & (contamination < 10), "MQ").otherwise("LQ")


def tier_vector(quality: DataFrame) -> DataFrame:
    """How many bins pass each of 90/70/50 completeness under 5 and 10 contamination: one row."""
    counts = [F.count_if((F.col("completeness") >= c) & (F.col("contamination") <= x)).alias(f"n_{c}_{x}") for c in (90, 70, 50) for x in (5, 10)]
    return quality.agg(*counts)


def partition_score(hits: DataFrame, total: int, by: tuple[str, ...] = (), bin_: str = "bin", contig: str = "contig", marker: str = "marker", least: int = 5) -> DataFrame:
    """(by, score) of partitions, bins of `least` contigs or more: 1e6 a high-quality one, 1e4 a medium, 1e2 a near-high, each bin once, and a soft term; shares of `total` markers.

    Contigs without a marker are rows with a null one, as they count for a bin's size.
    """
    keys = [*by, bin_]
    sizes = hits.groupBy(*keys).agg(F.count_distinct(contig).alias("size")).where(F.col("size") >= least)
    copies = hits.where(F.col(marker).isNotNull()).groupBy(*keys, marker).agg(F.count(F.lit(1)).alias("copies"))
    rows = sizes.join(copies, keys, "left").groupBy(*keys).agg((F.count("copies") / total).alias("c"), ((F.coalesce(F.sum("copies"), F.lit(0)) - F.count("copies")) / total).alias("x"))
    c, x = F.col("c"), F.col("x")
    kind = F.when((c >= 0.75) & (x <= 0.05), 1e6).when((c >= 0.5) & (x <= 0.1), 1e4).when((c >= 0.3) & (x <= 0.05), 1e2).otherwise(0.0)
    score = (F.sum(kind) + F.sum(c - 5.0 * x) / 1e4).alias("score")
    return rows.groupBy(*by).agg(score) if by else rows.agg(score)


def best_domain(hits: DataFrame, domains: DataFrame, bin_: str = "bin", marker: str = "marker") -> DataFrame:
    """(bin, domain, completeness, contamination): of the domains (marker, domain) the one with the greatest completeness, then the least contamination."""
    total = domains.groupBy("domain").agg(F.count(F.lit(1)).alias("total"))
    rows = marker_counts(hits.join(domains, marker), bin_, marker).join(domains, marker).groupBy(bin_, "domain").agg(F.count(F.lit(1)).alias("found"), F.sum("copies").alias("copies")).join(total, "domain")
    share = rows.select(bin_, "domain", (100.0 * F.col("found") / F.col("total")).alias("completeness"), (100.0 * (F.col("copies") - F.col("found")) / F.col("total")).alias("contamination"))
    best = share.groupBy(bin_).agg(F.min(F.struct(-F.col("completeness"), F.col("contamination"), F.col("domain"))).alias("m"))
    return best.select(bin_, "m.domain", (-F.col("m.col1")).alias("completeness"), "m.contamination")


def n50(lengths: DataFrame, group: list[str], length: str = "length", tie: str = "contig") -> DataFrame:
    """Per group the first length, longest first, at which the running sum reaches half of the total (integer division)."""
    w = Window.partitionBy(*group).orderBy(F.desc(length), tie)
    every = Window.partitionBy(*group)
    run = lengths.withColumn("cum", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(length).over(every))
    return run.where(F.col("cum") >= F.floor(F.col("total") / 2)).groupBy(*group).agg(F.max(length).alias("n50"), F.first("total").alias("total"))


def sole_carriers(hits: DataFrame, bin_: str = "bin", contig: str = "contig", marker: str = "marker") -> DataFrame:
    """(bin, contig): the only contig of its bin with some marker; taking it away would lose the marker."""
    one = hits.groupBy(bin_, marker).agg(F.count_distinct(contig).alias("n"), F.min(contig).alias(contig)).where("n = 1")
    return one.select(bin_, contig).distinct()


def weakest_carriers(hits: DataFrame, weight: str, bin_: str = "bin", contig: str = "contig", marker: str = "marker") -> DataFrame:
    """(bin, marker, contig): of each marker with several carriers, the one of least weight, ties by contig."""
    best = hits.groupBy(bin_, marker).agg(F.count_distinct(contig).alias("n"), F.min(F.struct(F.col(weight), F.col(contig))).alias("m")).where("n > 1")
    return best.select(bin_, marker, F.col(f"m.{contig}").alias(contig))


def seed_marker(hits: DataFrame, contig: str = "contig", marker: str = "marker", qlen: str = "qlen") -> DataFrame:
    """The marker whose number of contigs is the upper median of all, the shortest of those, ties by name; the median comes from counts of equal numbers."""
    counts = hits.groupBy(marker).agg(F.count_distinct(contig).alias("n"), F.min(qlen).alias(qlen))
    equal = counts.groupBy("n").agg(F.count(F.lit(1)).alias("markers"))  # as many rows as different numbers
    run = equal.withColumn("cum", F.sum("markers").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    middle = run.join(F.broadcast(equal.agg(F.expr("sum(markers) DIV 2").alias("half"))), F.col("cum") > F.col("half")).agg(F.min("n").alias("middle"))  # one row each
    return counts.join(F.broadcast(middle), F.col("n") == F.col("middle")).orderBy(qlen, marker).limit(1).select(marker, "n", qlen)
