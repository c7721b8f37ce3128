"""Positional signals: windows over ordered rows, breakpoints, votes, histograms, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jump(rows: DataFrame, group: list[str], order: list[str], value: str, width: int, ratio: float = 2.0, every: bool = False) -> DataFrame:
    """rows with the means of `width` rows before and from the row on, kept where one is `ratio` times the other.

    Breakpoints lie half a window apart, from the first with a whole window before it on, and have more than a whole
    window behind them; with `every`, each row that has one before it may be a breakpoint, and windows at the ends are
    shorter. Of null values the others' mean is taken.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    at, size = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*group))
    both = rows.withColumn("before", F.avg(value).over(w.rowsBetween(-width, -1))).withColumn("after", F.avg(value).over(w.rowsBetween(0, width - 1)))
    whole = both.where(F.col("before").isNotNull()) if every else both.withColumn("at", at).withColumn("rows", size).where((F.col("at") >= width) & (F.col("at") < F.col("rows") - width) & ((F.col("at") - width) % max(1, width // 2) == 0)).drop("at", "rows")
    least, most = F.least("before", "after"), F.greatest("before", "after")
    return whole.where((least > 0) & (most / least >= ratio))


def against_neighbours(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """rows that have both neighbours, with the neighbours' mean."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("around", (F.lag(value).over(w) + F.lead(value).over(w)) / 2).where(F.col("around").isNotNull())


def spikes(rows: DataFrame, group: list[str], order: list[str], value: str, ratio: float = 1.5) -> DataFrame:
    return against_neighbours(rows, group, order, value).where((F.col("around") > 0) & (F.col(value) >= ratio * F.col("around")))


def drops(rows: DataFrame, group: list[str], order: list[str], value: str, share: float = 0.15) -> DataFrame:
    return against_neighbours(rows, group, order, value).where((F.col("around") > 0) & (F.col(value) <= (1 - share) * F.col("around")))


def smoothed_shift(rows: DataFrame, group: list[str], order: list[str], k: str, n: str, least_n: int = 30, least: float = 0.08, half: int = 2, gap: int = 1) -> DataFrame:
    """Rates pooled over 2 half + 1 rows on either side, centred half + gap rows away, kept where they differ by `least` and both rest on least_n observations; groups of seven rows or more."""
    w = Window.partitionBy(*group).orderBy(*order)
    size, away = 2 * half + 1, half + gap
    sides = {"before": w.rowsBetween(-away - half, -away + half), "after": w.rowsBetween(away - half, away + half)}
    at = rows.withColumn("at", F.row_number().over(w)).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    for name, over in sides.items():
        at = at.withColumn(f"n_{name}", F.sum(n).over(over)).withColumn(name, F.sum(k).over(over) / F.col(f"n_{name}"))
    inside = (F.col("rows") >= size + 2 * gap) & (F.col("at") > away) & (F.col("at") <= F.col("rows") - away)
    return at.where(inside & (F.least("n_before", "n_after") >= least_n) & (F.abs(F.col("after") - F.col("before")) >= least))


def votes(signals: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Breakpoints by key with the kinds of evidence that name them."""
    every = None
    for name, rows in sorted(signals.items()):
        one = rows.select(*key, F.lit(name).alias("kind"))
        every = one if every is None else every.unionAll(one)
    return every.groupBy(*key).agg(F.count_distinct("kind").alias("families"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("evidence"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bucket, n) of values in [low, high)."""
    at = F.floor((value - low) * bins / (high - low)).cast("int")
    return rows.where((value >= low) & (value < high)).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def smoothed_histogram(hist: DataFrame, bins: int) -> DataFrame:
    """(bucket, n, mean, left, right): all buckets from 0 to bins - 1, empty ones too, with the means over three buckets of each and its neighbours."""
    spark = hist.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bucket")).join(hist, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("bucket")  # bins rows
    smooth = every.withColumn("mean", F.avg("n").over(w.rowsBetween(-1, 1)))
    return smooth.select("bucket", "n", "mean", F.lag("mean").over(w).alias("left"), F.lead("mean").over(w).alias("right"))


def valleys(hist: DataFrame, bins: int) -> DataFrame:
    """Buckets whose three-bucket mean is below both neighbours'."""
    return smoothed_histogram(hist, bins).where((F.col("mean") < F.col("left")) & (F.col("mean") < F.col("right"))).select("bucket", "n", "mean")


def peaks(hist: DataFrame, bins: int, least: float = 0.05) -> DataFrame:
    """Buckets whose three-bucket mean is above both neighbours' and above `least` of the greatest."""
    smooth = smoothed_histogram(hist, bins)
    top = smooth.agg(F.max("mean").alias("top"))
    return smooth.join(F.broadcast(top)).where((F.col("mean") > F.col("left")) & (F.col("mean") > F.col("right")) & (F.col("mean") > least * F.col("top"))).select("bucket", "n", "mean")


def thresholds(rows: DataFrame, p: Column, bins: int = 20) -> DataFrame:
    """(modern, ancient): one row; the deepest valley of the lower and of the upper half of a histogram of posteriors, within [.05, .45] and [.55, .95]; .2 and .8 without valleys."""
    at = F.least(F.lit(bins - 1), F.floor(p * bins).cast("int"))
    v = valleys(rows.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), bins)
    middle = lambda b: (b + 0.5) / bins
    low, high = (F.min(F.when(side, F.struct("mean", "bucket")))["bucket"] for side in (F.col("bucket") < bins // 2, F.col("bucket") >= bins // 2))
    return v.agg(F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(0.45), middle(low))), F.lit(0.2)).alias("modern"), F.coalesce(F.greatest(F.lit(0.55), F.least(F.lit(0.95), middle(high))), F.lit(0.8)).alias("ancient"))


def merged_intervals(rows: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that overlap or touch (start <= end + 1) become one."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = rows.withColumn("fresh", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    return first.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*group, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def covered(points: DataFrame, intervals: DataFrame, group: list[str], pos: str = "pos") -> DataFrame:
    """points inside any interval: of the last start at or before the point only the end matters, as merged intervals don't overlap."""
    marks = intervals.select(*group, F.col("start").alias(pos), F.col("end").alias("reach"), F.lit(0).alias("kind"))
    both = marks.unionByName(points.select(*group, pos, F.lit(None).cast("bigint").alias("reach"), F.lit(1).alias("kind")))
    w = Window.partitionBy(*group).orderBy(pos, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reach", F.last("reach", ignorenulls=True).over(w)).where((F.col("kind") == 1) & (F.col(pos) <= F.col("reach"))).select(*group, pos)


def depth_segments(blocks: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(group, from, to, depth): constant-depth runs of half-open blocks, by +1 and -1 events and a running sum."""
    events = blocks.select(*group, F.col(start).alias("from"), F.lit(1).alias("step")).unionAll(blocks.select(*group, F.col(end).alias("from"), F.lit(-1).alias("step")))
    net = events.groupBy(*group, "from").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*group).orderBy("from")
    run = net.withColumn("depth", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("from").over(w))
    return run.where(F.col("to").isNotNull() & (F.col("depth") > 0)).select(*group, "from", "to", "depth")
