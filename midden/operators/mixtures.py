"""Mixtures of normal distributions over one value of each group, for every number of components at once, and the number that an information criterion prefers.

Rows are counts of equal values first. A round is one join with a row of parameters a group and one sum, so a group may hold any share of
the rows; fits that have converged leave the rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut


def _density(j: int, x: Column) -> Column:
    m, v, w = (F.col(f"{c}{j}") for c in "mvw")
    return F.coalesce(w / F.sqrt(2 * math.pi * v) * F.exp(-(x - m) * (x - m) / (2 * v)), F.lit(0.0))


def fits(rows: DataFrame, by: list[str], value: str, most: int = 3, rounds: int = 100, tolerance: float = 1e-6, first_variance: float = 100.0, least_variance: float = 1.0) -> DataFrame:
    """(by, k, n, m0, v0, w0, ..., ll): for k from 1 to most the fitted means, variances and weights, null beyond k, and the log-likelihood of the parameters before the last step.

    Means start at the values of index (j + 1) n / (k + 1) in order. Groups of fewer than k values have no fit of k.
    """
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy(*by).orderBy("x")
    run = counts.withColumn("cum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda k, j: F.min(F.when(F.col("cum") > F.expr(f"({j} + 1) * n DIV ({k} + 1)"), F.col("x")))
    starts = None
    for k in range(1, most + 1):
        means = [(at(k, j) if j < k else F.lit(None).cast("double")).alias(f"m{j}") for j in range(most)]
        rest = [c for j in range(most) for c in ((F.lit(first_variance) if j < k else F.lit(None).cast("double")).alias(f"v{j}"), (F.lit(1.0 / k) if j < k else F.lit(None).cast("double")).alias(f"w{j}"))]
        one = run.groupBy(*by).agg(F.first("n").alias("n"), *means).where(F.col("n") >= k).select(*by, F.lit(k).alias("k"), "n", *(f"m{j}" for j in range(most)), *rest, F.lit(-1e30).alias("ll"), F.lit(False).alias("done"))
        starts = one if starts is None else starts.unionByName(one)
    fit = cut(starts)
    x = F.col("x")
    for _ in range(rounds):
        each = counts.join(fit.where("NOT done"), by)
        total = sum((_density(j, x) for j in range(1, most)), _density(0, x))
        share = [F.col("c") * F.when(F.col("total") > 0, _density(j, x) / F.col("total")).otherwise(_density(j, x)) for j in range(most)]
        sums = each.withColumn("total", total).groupBy(*by, "k").agg(
            F.first("n").alias("n"), F.first("ll").alias("before"), F.sum(F.when(F.col("total") > 0, F.col("c") * F.log("total"))).alias("ll"),
            *(F.first(f"{c}{j}").alias(f"old_{c}{j}") for c in "mvw" for j in range(most)),
            *(F.sum(s).alias(f"s{j}") for j, s in enumerate(share)), *(F.sum(s * x).alias(f"a{j}") for j, s in enumerate(share)), *(F.sum(s * x * x).alias(f"b{j}") for j, s in enumerate(share)),
        )
        new = []
        for j in range(most):
            good = (F.col(f"s{j}") > 1e-10) & (F.col("k") > j)
            mean = F.col(f"a{j}") / F.col(f"s{j}")
            new += [F.when(good, mean).otherwise(F.col(f"old_m{j}")).alias(f"m{j}"), F.when(good, F.greatest(F.lit(least_variance), F.col(f"b{j}") / F.col(f"s{j}") - mean * mean)).otherwise(F.col(f"old_v{j}")).alias(f"v{j}"), F.when(good, F.col(f"s{j}") / F.col("n")).otherwise(F.col(f"old_w{j}")).alias(f"w{j}")]
        step = sums.select(*by, "k", "n", *new, "ll", (F.abs(F.col("ll") - F.col("before")) < tolerance).alias("done"))
        fit = cut(fit.where("done").unionByName(step))
        if fit.where("NOT done").isEmpty():
            break
    return fit.drop("done")


def preferred(fitted: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """(by, k): the number of components of the least -2 ll + 2 (3 k - 1) log n, of equals the smallest; 1 for groups of fewer than `least` values."""
    cost = -2 * F.col("ll") + 2.0 * (3 * F.col("k") - 1) * F.log("n")
    best = fitted.groupBy(*by).agg(F.min(F.struct(cost.alias("cost"), F.col("k"))).alias("m"), F.first("n").alias("n"))
    return best.select(*by, F.when(F.col("n") < least, 1).otherwise(F.col("m.k")).alias("k"))


def parts(rows: DataFrame, fitted: DataFrame, by: list[str], value: str, most: int = 3) -> DataFrame:
    """rows with part: the place, by ascending mean, of the component of the greatest weighted density; fitted has one row a group."""
    ordered = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"m{j}").alias("m"), F.col(f"v{j}").alias("v"), F.col(f"w{j}").alias("w")) for j in range(most))), lambda c: c.m.isNotNull()))
    x = F.col(value)
    dense = F.transform("_parts", lambda c, i: F.struct((c.w / F.sqrt(c.v) * F.exp(-(x - c.m) * (x - c.m) / (2 * c.v))).alias("d"), (-i).alias("i")))
    return rows.join(fitted.select(*by, ordered.alias("_parts")), by).withColumn("part", -F.array_max(dense)["i"]).drop("_parts")
