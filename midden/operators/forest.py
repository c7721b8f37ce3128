"""Graphs at all thresholds at once, and the choice of links that keeps every node connected enough.

Links are ordered by falling weight, then by their ends; every result equals that of walking through them one by one in this order.
Null weights aren't links; links of a node with itself don't matter; repeated links count as their heaviest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import symmetric
from .iterate import cut, forget


def _order(e: str = "") -> list:
    return [F.desc(f"{e}w"), f"{e}u", f"{e}v"]


def spanning_forest(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The forest (by, u, v, w) of greatest weight and the components (by, node, component), named by their least node, of each graph of by.

    In each round (Boruvka) every component takes its first link to another one. What hangs together through these links
    is a tree with one pair that chose the same link; the lesser of the pair is its root, and names reach the others by doubling. Rounds are logarithmic
    in the number of nodes; a hot node's links are only ever aggregated.
    """
    keys = list(by)
    links = edges.where("u <> v AND w IS NOT NULL").groupBy(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))
    left = cut(links.withColumns({"cu": F.col("u"), "cv": F.col("v")}))
    labels = cut(nodes.select(*keys, "node").distinct().withColumn("component", F.col("node")))
    chosen: list[DataFrame] = []
    while True:
        rank = F.struct((-F.col("w")).alias("a"), F.col("u").alias("b"), F.col("v").alias("c"))
        side = lambda a, b: left.select(*keys, F.col(a).alias("from"), F.col(b).alias("to"), rank.alias("r"))  # noqa: B023, E731
        first = cut(side("cu", "cv").unionAll(side("cv", "cu")).groupBy(*keys, "from").agg(F.min(F.struct("r", "to")).alias("m")).select(*keys, "from", "m.to", "m.r"))
        if first.isEmpty():
            forget(first)
            break
        chosen.append(cut(first.select(*keys, F.col("r.b").alias("u"), F.col("r.c").alias("v"), (-F.col("r.a")).alias("w")).distinct()))
        back = first.select(*keys, F.col("from").alias("to"), F.col("to").alias("again"))
        up = cut(first.join(back, [*keys, "to"], "left").select(*keys, "from", F.when((F.col("again") == F.col("from")) & (F.col("from") < F.col("to")), F.col("from")).otherwise(F.col("to")).alias("to")))
        while True:  # everyone's name is that of whom it points to
            next_ = cut(up.join(up.select(*keys, F.col("from").alias("to"), F.col("to").alias("over")), [*keys, "to"]).select(*keys, "from", F.col("over").alias("to"), (F.col("over") != F.col("to")).alias("moved")))
            moved = not next_.where("moved").isEmpty()
            forget(up)
            up = next_.drop("moved")
            up.written_at = next_.written_at
            if not moved:
                break
        renamed = lambda df, c: df.join(up.select(*keys, F.col("from").alias(c), "to"), [*keys, c], "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        new_labels = cut(renamed(labels, "component").select(*keys, "node", "component"))
        new_left = cut(renamed(renamed(left, "cu"), "cv").where("cu <> cv").select(*keys, "u", "v", "w", "cu", "cv"))
        forget(first, up, labels, left)
        labels, left = new_labels, new_left
    least = labels.groupBy(*keys, "component").agg(F.min("node").alias("least"))
    named = labels.join(least, [*keys, "component"]).select(*keys, "node", F.col("least").alias("component"))
    forest = left.select(*keys, "u", "v", "w")  # nothing is left
    for part in chosen:
        forest = forest.unionAll(part)
    return forest, named


def components_by_threshold(forest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(w, components): at each weight of the forest the number of components that links of at least that weight leave; every link of a forest joins two."""
    steps = forest.groupBy("w").agg(F.count(F.lit(1)).alias("links"))
    # counts of equal weights are ordered by parts, so that no task orders all of them
    part = steps.withColumn("part", F.floor(F.log2(F.greatest(F.abs("w"), F.lit(1e-300))) * 8) * F.signum("w"))
    sums = part.groupBy("part").agg(F.sum("links").alias("links"))
    before = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("links").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(F.desc("w"))
    n = nodes.select("node").distinct().agg(F.count(F.lit(1)).alias("n"))
    return part.join(F.broadcast(base), "part").crossJoin(F.broadcast(n)).select("w", (F.col("n") - F.col("base") - F.sum("links").over(within)).alias("components"))  # a row of n; parts are exponents


def critical_threshold(forest: DataFrame, nodes: DataFrame, target: int = 2) -> DataFrame:
    """(threshold, components): the least weight of a forest's link from which on there are `target` components or more; the greatest if there are never so many."""
    rows = components_by_threshold(forest, nodes)
    found = F.min(F.when(F.col("components") >= target, F.struct("w", "components")))
    return rows.agg(F.coalesce(found, F.max(F.struct("w", "components"))).alias("m")).select(F.col("m.w").alias("threshold"), "m.components")


def components_at(edges: DataFrame, nodes: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, node, component) for each of a few thresholds, from the forest of all links, not from the links again."""
    forest, _ = spanning_forest(edges, nodes)
    each = F.explode(F.array(*map(F.lit, thresholds)))
    kept = forest.withColumn("threshold", each).where("w >= threshold")
    return spanning_forest(kept, nodes.withColumn("threshold", each), ("threshold",))[1]


def degree_floor(kept: DataFrame, scored: DataFrame, least: int = 20) -> DataFrame:
    """kept (u, v, w) and those of scored (u, v, w) that bring nodes to `least` links: heaviest first, a link is taken while one of its ends has fewer.

    In rounds: a link is taken for sure if, at one of its ends, those before it that are taken or open leave it a place, and passed over for sure if at both
    ends those taken fill it. The first open link is always decided, so the rounds end with what one pass in order gives.
    """
    have = symmetric(kept)
    degree = cut(have.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    open_ = cut(symmetric(scored.where("w IS NOT NULL")).join(have.select("u", "v"), ["u", "v"], "left_anti").withColumn("taken", F.lit(None).cast("boolean")))
    before = Window.partitionBy("node").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    while not open_.where("taken IS NULL").isEmpty():
        ends = open_.select("*", F.explode(F.array("u", "v")).alias("node")).join(degree, "node", "left")
        count = lambda c: F.coalesce(F.count_if(c).over(before), F.lit(0))
        full = F.coalesce("degree", F.lit(0)) + count(F.col("taken"))
        seen = ends.select("u", "v", "w", "taken", full.alias("full"), count(F.col("taken").isNull()).alias("open"))
        by = seen.groupBy("u", "v", "w", "taken").agg(F.min(F.col("full") + F.col("open")).alias("most"), F.min("full").alias("fewest"))
        new = cut(by.select("u", "v", "w", F.coalesce("taken", F.when(F.col("most") < least, True).when(F.col("fewest") >= least, False)).alias("taken")))
        forget(open_)
        open_ = new
    return have.unionByName(open_.where("taken").select("u", "v", "w"))
