"""Aggregations of terminal damage and read posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.damage import smoothed_rate


def kish(rows: DataFrame, by: list[str], weight: Column, p: Column) -> DataFrame:
    """Weighted mean posterior, its Beta-like variance and the effective number, from five sums a group."""
    sums = rows.groupBy(*by).agg(F.sum(weight).alias("w"), F.sum(weight * weight).alias("w2"), F.sum(weight * p).alias("wp"), F.sum(weight * weight * p * (1 - p)).alias("w2v"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, "n", (F.col("wp") / F.col("w")).alias("p"), (F.col("w2v") / (F.col("w") * F.col("w"))).alias("var"), (F.col("w") * F.col("w") / F.col("w2")).alias("n_eff"))


def pooled_rates(counts: DataFrame, by: list[str], position: str = "position", k: str = "k", n: str = "n") -> DataFrame:
    """Counts pooled by group and position, with the smoothed rate."""
    sums = counts.groupBy(*by, position).agg(F.sum(k).alias("k"), F.sum(n).alias("n"))
    return sums.withColumn("rate", smoothed_rate(F.col("k"), F.col("n")))


def g_test(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, g): 2 sum k ln(k / e) of (by, category, k) against the categories' overall shares."""
    category = counts.groupBy("category").agg(F.sum("k").alias("c"))
    total = counts.agg(F.sum("k").alias("t"))
    own = counts.groupBy(*by).agg(F.sum("k").alias("n"))
    rows = counts.where("k > 0").join(F.broadcast(category), "category").join(own, by).join(F.broadcast(total))
    return rows.groupBy(*by).agg(F.first("n").alias("n"), (2 * F.sum(F.col("k") * F.log(F.col("k") * F.col("t") / (F.col("n") * F.col("c"))))).alias("g"))


def fragment_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, population standard deviation and upper median (element n div 2 in order), by counts of equal values."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    run = counts.withColumn("cum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(Window.partitionBy(*by)))
    median = run.where(F.col("cum") > F.expr("total DIV 2")).groupBy(*by).agg(F.min(value).alias("median"))
    base = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return base.join(median, by)
