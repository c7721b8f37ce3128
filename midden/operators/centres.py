"""Centres of points: farthest-first choice, rounds of means, medoids. Centres are a parameter's number of rows and are broadcast; a round is a pass and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import squared_distance
from .iterate import cut


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, v, centre, d): each point's nearest centre (centre, c), the smallest of equals, and its squared distance."""
    d = F.round(squared_distance(F.col("v"), F.col("c")), 9)
    rows = points.join(F.broadcast(centres), F.lit(True)).groupBy("id").agg(F.first("v").alias("v"), F.min(F.struct(d.alias("d"), F.col("centre"))).alias("m"))
    return rows.select("id", "v", "m.centre", "m.d")


def farthest_first(points: DataFrame, k: int) -> DataFrame:
    """(centre, id, c): the point of the least id, then k - 1 times the one farthest from all chosen, of equals that of the least id."""
    spark = points.sparkSession
    kind = f"centre int, id {points.schema['id'].dataType.simpleString()}, c array<double>"
    first = points.agg(F.min(F.struct("id", "v")).alias("m")).first()["m"]
    if first is None:
        return spark.createDataFrame([], kind)
    chosen = [(0, first["id"], list(first["v"]))]
    near = cut(points.select("id", "v", F.round(squared_distance(F.col("v"), F.array(*map(F.lit, first["v"]))), 9).alias("d")))
    for i in range(1, k):
        top = near.agg(F.max(F.struct("d", (-F.col("id")).alias("least"))).alias("m"), F.max_by(F.struct("id", "v"), F.struct("d", (-F.col("id")).alias("least"))).alias("p")).first()  # one row
        if top["m"]["d"] <= 0:
            break
        chosen.append((i, top["p"]["id"], list(top["p"]["v"])))
        near = cut(near.select("id", "v", F.least("d", F.round(squared_distance(F.col("v"), F.array(*map(F.lit, top["p"]["v"]))), 9)).alias("d")))
    return spark.createDataFrame(chosen, kind)


def means(points: DataFrame, centres: DataFrame, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(centre, c, n): centres moved to the mean of what is nearest to them until none moves by more than tolerance; one that has nothing goes."""
    for _ in range(rounds):
        own = nearest(points, centres.select("centre", "c"))
        spread = own.select("centre", F.posexplode("v").alias("k", "x")).groupBy("centre", "k").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
        new = cut(spread.groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s.m).alias("c"), F.first("n").alias("n")))  # a row a dimension
        moved = new.join(centres.select("centre", F.col("c").alias("old")), "centre").agg(F.max(squared_distance(F.col("c"), F.col("old"))).alias("d")).first()["d"]
        centres = new
        if moved is None or moved <= tolerance:
            break
    return centres


def medoids(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(centre, id, d): of the points nearest to each centre the one nearest to their mean, of equals that of the least id."""
    own = cut(nearest(points, centres.select("centre", "c")).select("id", "v", "centre"))
    spread = own.select("centre", F.posexplode("v").alias("k", "x")).groupBy("centre", "k").agg(F.avg("x").alias("m"))
    mean = spread.groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s.m).alias("c"))  # a row a dimension
    d = F.round(squared_distance(F.col("v"), F.col("c")), 9)
    return own.join(F.broadcast(mean), "centre").groupBy("centre").agg(F.min(F.struct(d.alias("d"), F.col("id"))).alias("m")).select("centre", "m.id", "m.d")
