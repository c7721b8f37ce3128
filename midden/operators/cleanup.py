"""Contigs that don't fit their bin, by one signal at a time; a bin that would lose too many keeps all.

Medians and deviations come from counts of equal values, so a large bin is partial sums before it is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence
from .iterate import cut, forget


def within_share(rows: DataFrame, out: DataFrame, by: list[str], key: str, least: int, most: float, strict: bool = False) -> DataFrame:
    """out (by, key, ...) of groups of `least` rows or more of which it is at most the share `most` (less than it if strict)."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
    gone = out.groupBy(*by).agg(F.count(F.lit(1)).alias("_gone"))
    limit = F.col("_gone") < most * F.col("_rows") if strict else F.col("_gone") <= most * F.col("_rows")
    return out.join(evidence.few(sizes.join(gone, by).where(limit).select(*by)), by, "left_semi")


def deviating(rows: DataFrame, by: list[str], value: str, limit: float, both_sides: bool, floor: float | None = 0.001) -> DataFrame:
    """rows whose z, the distance from the median by 1.4826 median absolute deviations, is over limit; deviations are at least floor, or groups under 0.001 are passed over if it is None."""
    near = rows.join(evidence.upper_median(rows, by, value, "median"), by).withColumn("deviation", F.round(F.abs(F.col(value) - F.col("median")), 9))
    mad = evidence.upper_median(near, by, "deviation", "mad").withColumn("scale", 1.4826 * F.col("mad")).drop("mad")
    full = near.join(mad if floor is not None else mad.where("scale >= 0.001"), by)
    scale = F.col("scale") if floor is None else F.greatest(F.lit(floor), F.col("scale"))
    z = (F.abs(F.col(value) - F.col("median")) if both_sides else F.col(value) - F.col("median")) / scale
    return full.withColumn("z", z).where(F.col("z") > limit).drop("deviation", "scale")


def cpg_outliers(rows: DataFrame, by: list[str], key: str, cpg: str, limit: float = 3.0, least: int = 10, most: float = 0.2) -> DataFrame:
    """Contigs whose CpG ratio is over limit deviations from the bin's median, either way."""
    return within_share(rows, deviating(rows, by, cpg, limit, True), by, key, least, most)


def _sums(contigs: DataFrame, by: list[str], values: str, weight: Column) -> DataFrame:
    """(by, sums): the weighted sums of arrays that are as long for each; a row a place is shuffled."""
    sums = contigs.select(*by, weight.alias("weight"), F.posexplode(values).alias("at", "value")).groupBy(*by, "at").agg(F.sum(F.col("value") * F.col("weight")).alias("sum"))
    return sums.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "sum"))), lambda s: s["sum"]).alias("sums"))


def karlin_outliers(contigs: DataFrame, by: list[str], key: str, rho: str = "rho", limit: float = 3.5, least: int = 20, most: float = 0.15) -> DataFrame:
    """(by, key, distance, z): contigs far from their bin's mean dinucleotide odds; contigs: (by, key, rho), an array of 16, missing ones 0.

    A contig stays one row and is read for its odds once; no contig is shuffled for its distance. Distances are written once.
    """
    contigs = cut(contigs)
    size = contigs.groupBy(*by).agg(F.count(F.lit(1)).alias("contigs"))
    mean = _sums(contigs, by, rho, F.lit(1.0)).join(size, by).select(*by, F.transform("sums", lambda s: s / F.col("contigs")).alias("mean"))
    distance = F.aggregate(F.zip_with(rho, "mean", lambda x, m: F.abs(x - m)), F.lit(0.0), lambda a, x: a + x) / 16
    rows = cut(contigs.join(evidence.few(mean), by).select(*by, key, F.round(distance, 9).alias("distance")))
    forget(contigs)
    return within_share(rows, deviating(rows, by, "distance", limit, False), by, key, least, most)


def composition_outliers(contigs: DataFrame, by: list[str], key: str, length: str = "length", shares: str = "shares", limit: float = 2.0, least: int = 10, keep: float = 0.8) -> DataFrame:
    """(by, key, distance, z): contigs far from the length-weighted mean of their bin's k-mer shares; contigs: (by, key, length, shares), an array as long for each.

    A contig stays one row: only a bin's sums are rows a k-mer, and no contig is shuffled for its distance. Distances are written once.
    """
    contigs = cut(contigs)
    total = contigs.groupBy(*by).agg(F.sum(length).alias("total"))
    mean = _sums(contigs, by, shares, F.col(length)).join(total, by).select(*by, F.transform("sums", lambda s: s / F.col("total")).alias("mean"))
    gaps = F.zip_with(shares, "mean", lambda x, m: (x - m) * (x - m))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x))
    rows = cut(contigs.join(evidence.few(mean), by).select(*by, key, F.round(distance, 9).alias("distance")))
    forget(contigs)
    return within_share(rows, deviating(rows, by, "distance", limit, False, None), by, key, least, 1 - keep)


def depth_outliers(rows: DataFrame, by: list[str], key: str, depth: str, deviation: float = 0.4, least_cv: float = 0.25, least_mean: float = 2.0, least: int = 10, keep: float = 0.8) -> DataFrame:
    """Contigs whose depth is over `deviation` of the median away from it, in bins whose depth varies."""
    stats = rows.groupBy(*by).agg(F.avg(depth).alias("mean"), F.stddev_pop(depth).alias("sd")).where((F.col("mean") >= least_mean) & (F.col("sd") / F.col("mean") >= least_cv)).select(*by)
    near = rows.join(stats, by, "left_semi").join(evidence.upper_median(rows, by, depth, "median"), by)
    out = near.where((F.col(depth) < F.col("median") * (1 - deviation)) | (F.col(depth) > F.col("median") * (1 + deviation)))
    return within_share(rows, out, by, key, least, 1 - keep)


def undamaged_contigs(rows: DataFrame, by: list[str], key: str, rate: str, least_bin: float = 0.08, least_contig: float = 0.02, ratio: float = 0.25, least: int = 10, most: float = 0.15) -> DataFrame:
    """Contigs with hardly any damage in bins whose median positive rate, of five or more, is that of ancient ones; at least `least` contigs stay."""
    seen = rows.where(F.col(rate) > 0)
    enough = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select(*by)
    ancient = evidence.few(evidence.upper_median(seen, by, rate, "median").join(enough, by, "left_semi").where(F.col("median") >= least_bin))
    out = rows.join(ancient, by).where((F.col(rate) >= 0) & ((F.col(rate) < least_contig) | (F.col(rate) < ratio * F.col("median"))))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")).join(out.groupBy(*by).agg(F.count(F.lit(1)).alias("_out")), by).where(F.col("_all") - F.col("_out") >= least).select(*by)
    return within_share(rows, out.join(evidence.few(sizes), by, "left_semi"), by, key, least, most)


def damage_compatibility(pairs: DataFrame, n0: float = 60.0, tau2: float = 1e-3, strength: float = 0.5, least: float = 0.5, least_neff: float = 20.0) -> Column:
    """A weight within [least, 1] of pairs (d_a, d_b: mean terminal rates; p_a, p_b, var_a, var_b, n_a, n_b): under 1 where one side alone is damaged, or both by different rates, and both rest on enough reads."""
    c = {x: F.col(x) for x in ("d_a", "d_b", "p_a", "p_b", "var_a", "var_b", "n_a", "n_b")}
    gap = F.abs(c["d_a"] - c["d_b"])
    a, b = c["d_a"] > 0.07, c["d_b"] > 0.07
    alike = (~a & ~b) | (a & b & (gap < 0.1)) | (F.least(c["n_a"], c["n_b"]) < least_neff)
    sure = c["n_a"] / (c["n_a"] + n0) * c["n_b"] / (c["n_b"] + n0)
    z = F.abs(c["p_a"] - c["p_b"]) / F.sqrt(F.greatest(F.lit(1e-12), c["var_a"] + c["var_b"] + tau2))
    near = 0.5 * (F.exp(-gap / 0.2) + F.exp(-0.5 * z * z))
    return F.when(alike, 1.0).otherwise(F.greatest(F.lit(least), F.least(F.lit(1.0), 1.0 - strength * sure * (1.0 - near))))


def natural_normal(value: Column, mean: float, var: float) -> Column:
    """Log density of a normal distribution."""
    return -0.5 * (F.log(F.lit(2 * 3.141592653589793 * var)) + (value - mean) * (value - mean) / var)
