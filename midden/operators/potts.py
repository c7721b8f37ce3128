"""Communities of the constant Potts model against density (RBER), with a start, fixed nodes and node sizes.

A partition's quality is the weight inside its communities less, for each, resolution x density x its possible links, n (n - 1) / 2 for
communities of n (sums of node sizes). So a node's gain in a community depends on sizes, not on degrees: its weight to
the community less resolution x density x its size x the others' size.

In a round every node proposes its best move, and a move is accepted if it is drawn first (by a hash of run, node and round) of all that touch the community it
leaves or the one it joins. Accepted moves touch different communities, so their gains add up and the quality never falls. A round is
joins and sums over links, for all runs at once, whatever a community's size. The graph is stored once for all runs.

Cases: nodes without links stay alone; links of a node with itself don't matter; repeated links add up; without links the quality is 0; a
start names any labels, nodes it doesn't name begin alone; fixed nodes keep their start's company, and communities with
different fixed labels never merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut, forget

LEAST_GAIN = 1e-9


def rber_quality(edges: DataFrame, labels: DataFrame, resolution: float = 1.0, sizes: DataFrame | None = None) -> DataFrame:
    """(quality): twice the sum over labels (node, label); density is that of the nodes in labels, whatever their sizes (node, size)."""
    named = edges.where("u <> v").join(labels.withColumnsRenamed({"node": "u", "label": "lu"}), "u").join(labels.withColumnsRenamed({"node": "v", "label": "lv"}), "v")
    inside = named.agg(F.coalesce(F.sum(F.when(F.col("lu") == F.col("lv"), F.col("w"))), F.lit(0.0)).alias("inside"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("m"))
    own = labels.withColumn("size", F.lit(1.0)) if sizes is None else labels.join(sizes, "node")
    by = own.groupBy("label").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("possible"))
    density = 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1.0))
    return inside.join(F.broadcast(by)).select(F.when((F.col("n") > 1) & (F.col("m") > 0), 2.0 * (F.col("inside") - resolution * density * F.col("possible"))).otherwise(0.0).alias("quality"))  # one row each


def move_gains(near: DataFrame, labels: DataFrame, mass: DataFrame, factor: DataFrame) -> DataFrame:
    """(run, node, old, size, label, gain, stay): each node's gain in every community around it, in its own, and alone; stay is its own's.

    near: links in both directions ([run,] u, v, w), the same for all runs without run; labels: (run, node, label); mass: (run, node, size); factor: (run, factor).
    """
    keys = ["run"] if "run" in near.columns else []
    own = labels.join(mass, ["run", "node"])
    sums = own.groupBy("run", "label").agg(F.sum("size").alias("all"))
    to = near.join(labels.withColumnRenamed("node", "v"), [*keys, "v"]).select("run", F.col("u").alias("node"), "label", "w")
    also = labels.select("run", "node", F.explode(F.array("label", "node")).alias("label"), F.lit(0.0).alias("w"))
    x = to.unionAll(also).groupBy("run", "node", "label").agg(F.sum("w").alias("x"))
    rows = x.join(own.select("run", "node", F.col("label").alias("old"), "size"), ["run", "node"]).join(sums, ["run", "label"], "left").join(factor, "run")
    others = F.coalesce(F.col("all"), F.lit(0.0)) - F.when(F.col("label") == F.col("old"), F.col("size")).otherwise(0.0)
    return rows.select("run", "node", "old", "size", "label", F.round(F.col("x") - F.col("factor") * F.col("size") * others, 9).alias("gain"))


def _accepted(gains: DataFrame, fixed: DataFrame | None, step: int) -> DataFrame:
    """(run, node, new) of the best moves that are drawn first of those that touch either of their communities."""
    tie = F.xxhash64("run", "node", "label")
    best = gains.groupBy("run", "node").agg(F.max(F.struct("gain", tie.alias("tie"), "label")).alias("b"), F.max(F.when(F.col("label") == F.col("old"), F.col("gain"))).alias("stay"), F.first("old").alias("old"))
    moves = best.select("run", "node", "old", F.col("b.label").alias("label"), (F.col("b.gain") - F.col("stay")).alias("delta")).where(F.col("delta") > LEAST_GAIN)
    if fixed is not None:
        moves = moves.join(fixed, ["run", "node"], "left_anti")
    touches = moves.select("run", "node", "label", F.explode(F.array("old", "label")).alias("community"), F.struct(F.xxhash64("run", "node", F.lit(step)).alias("drawn"), "node").alias("rank"))
    top = touches.groupBy("run", "community").agg(F.max("rank").alias("top"))
    won = touches.join(top, ["run", "community"]).where("rank = top").groupBy("run", "node", "label").count().where("count = 2")
    return won.select("run", "node", F.col("label").alias("new"))


def moved(near: DataFrame, labels: DataFrame, mass: DataFrame, factor: DataFrame, rounds: int, within: DataFrame | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """labels after rounds of moves, at most `rounds` of them, until none is left; within: (run, node, label), nodes only join what shares theirs."""
    if within is not None:
        keys = ["run"] if "run" in near.columns else []
        side = lambda c: within.select("run", F.col("node").alias(c), F.col("label").alias(f"in_{c}"))
        near = near.join(side("u"), [*keys, "u"]).join(side("v"), ["run", "v"]).where("in_u = in_v").select("run", "u", "v", "w")
        near = cut(near)
    labels = cut(labels.select("run", "node", "label"))
    for step in range(rounds):
        won = cut(_accepted(move_gains(near, labels, mass, factor), fixed, step))
        if won.isEmpty():
            forget(won)
            break
        new = cut(labels.join(won, ["run", "node"], "left").select("run", "node", F.coalesce("new", "label").alias("label")))
        forget(won, labels)
        labels = new
    if within is not None:
        forget(near)
    return labels


def _named(labels: DataFrame) -> DataFrame:
    """Labels renamed to their least node."""
    return labels.join(labels.groupBy("run", "label").agg(F.min("node").alias("least")), ["run", "label"]).select("run", "node", F.col("least").alias("label"))


def optimised(near: DataFrame, labels: DataFrame, mass: DataFrame, factor: DataFrame, fixed: DataFrame | None = None, levels: int = 10, rounds: int = 20, passes: int = 2) -> DataFrame:
    """(run, node, label) from a start: moves, refinement and aggregation by levels; passes begin again from the single nodes until nothing moves.

    Refined parts are formed by single nodes that join inside their community, and are the nodes of the next level; a part with a fixed node is fixed.
    """
    labels = cut(_named(labels))
    for _ in range(passes):
        at_near, at_mass, at_fixed, held = near, mass, fixed, []
        at = cut(labels)
        place = None
        for _ in range(levels):
            at = moved(at_near, at, at_mass, factor, rounds, fixed=at_fixed)
            parts = moved(at_near, at.select("run", "node", F.col("node").alias("label")), at_mass, factor, rounds, within=at, fixed=at_fixed)
            step = parts.select("run", F.col("node").alias("at"), F.col("label").alias("part"))
            place = cut(parts.select("run", "node", F.col("label").alias("at"))) if place is None else cut(place.join(step, ["run", "at"]).select("run", "node", F.col("part").alias("at")))
            above = _named(parts.join(at.withColumnRenamed("label", "of"), ["run", "node"]).groupBy("run", F.col("label").alias("node")).agg(F.min("of").alias("label")))
            merged = not parts.where("node <> label").isEmpty()
            if merged:
                keys = ["run"] if "run" in at_near.columns else []
                end = lambda c: parts.select("run", F.col("node").alias(c), F.col("label").alias(f"p_{c}"))  # noqa: B023, E731
                links = at_near.join(end("u"), [*keys, "u"]).join(end("v"), ["run", "v"]).where("p_u <> p_v")
                at_near = cut(links.groupBy("run", F.col("p_u").alias("u"), F.col("p_v").alias("v")).agg(F.sum("w").alias("w")))
                at_mass = cut(at_mass.join(parts, ["run", "node"]).groupBy("run", F.col("label").alias("node")).agg(F.sum("size").alias("size")))
                if at_fixed is not None:
                    at_fixed = cut(at_fixed.join(parts, ["run", "node"]).select("run", F.col("label").alias("node")).distinct())
                    held.append(at_fixed)
                held += [at_near, at_mass]
            above = cut(above)
            forget(at, parts)
            at = above
            if not merged:
                break
        new = cut(_named(place.join(at.select("run", F.col("node").alias("at"), "label"), ["run", "at"]).select("run", "node", "label")))
        forget(place, at, *held)
        same = new.join(labels.withColumnRenamed("label", "old"), ["run", "node"]).where("label <> old").isEmpty()
        forget(labels)
        labels = new
        if same:
            break
    return labels


def rber_communities(edges: DataFrame, resolutions: list[float], seeds: list[int], nodes: DataFrame | None = None, sizes: DataFrame | None = None, start: DataFrame | None = None, fixed: DataFrame | None = None, **how: int) -> DataFrame:
    """(resolution, seed, node, label) for each pair; a label is its least node.

    edges: undirected (u, v, w); nodes: (node), the edges' ends if not given; sizes: (node, size); start: (node, label); fixed: (node), which
    keep their start. A seed draws which moves come first; see best_of_seeds.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("u").alias("node")).unionAll(edges.select(F.col("v").alias("node")))
    nodes = cut((ends if nodes is None else nodes.select("node")).distinct())
    links = edges.where("u <> v").select("u", "v", "w")
    near = cut(links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    n, m = nodes.count(), (near.agg(F.sum("w")).first()[0] or 0.0) / 2
    density = 2.0 * m / (n * (n - 1.0)) if n > 1 else 0.0
    pairs = [(f"{r}/{s}", float(r), int(s), float(r) * density) for r in resolutions for s in seeds]
    grid = spark.createDataFrame(pairs, "run string, resolution double, seed int, factor double")  # a few rows of parameters
    each = nodes.withColumn("run", F.explode(F.array(*(F.lit(p[0]) for p in pairs)))).select("run", "node")
    own = each.withColumn("size", F.lit(1.0)) if sizes is None else each.join(sizes.select("node", F.col("size").cast("double").alias("size")), "node").select("run", "node", "size")
    mass = cut(own)
    begin = each.withColumn("label", F.col("node"))
    if start is not None:
        given = _named(start.select("node", "label", F.lit("").alias("run"))).select("node", F.col("label").alias("given"))
        begin = begin.join(given, "node", "left").select("run", "node", F.coalesce("given", "label").alias("label"))
    stay = None if fixed is None else cut(each.join(fixed.select("node").distinct(), "node").select("run", "node"))
    labels = optimised(near, begin, mass, grid.select("run", "factor"), stay, **how)
    return labels.join(F.broadcast(grid), "run").select("resolution", "seed", "node", "label")


def best_of_seeds(found: DataFrame, edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(resolution, seed, node, label): of each resolution the partition of the greatest quality, ties to the least seed. Nodes are those of found."""
    links = edges.where("u <> v")
    own = found.withColumn("size", F.lit(1.0)) if sizes is None else found.join(sizes, "node")
    each = own.groupBy("resolution", "seed", "label").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).groupBy("resolution", "seed").agg(F.sum("n").alias("n"), F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("possible"))
    side = lambda c: found.select("resolution", "seed", F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    inside = links.join(side("u"), "u").join(side("v"), ["resolution", "seed", "v"]).where("lu = lv").groupBy("resolution", "seed").agg(F.sum("w").alias("inside"))
    m = links.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("m"))  # one row
    rows = each.join(inside, ["resolution", "seed"], "left").join(F.broadcast(m))
    quality = F.round(F.coalesce("inside", F.lit(0.0)) - F.col("resolution") * 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1.0)) * F.col("possible"), 9)
    best = rows.groupBy("resolution").agg(F.min(F.struct((-quality).alias("q"), "seed")).alias("b")).select("resolution", "b.seed")
    return found.join(F.broadcast(best), ["resolution", "seed"]).select("resolution", "seed", "node", "label")  # a row a resolution
