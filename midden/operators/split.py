"""Splitting contaminated bins: communities of many sub-graphs at once, accepted bin by bin by marker quality.

Every contaminated bin is partitioned at each scale of a resolution in one set of rounds, keyed by (bin, scale). The first scale with two communities or more, but not
too many for the bin's size, is tried, and kept if its parts are better than the bin.

Cases: bins under the least size, without links, or clean ones stay whole; hits of unknown contigs don't count; a contig without length has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import potts, quality
from .iterate import cut, forget
from .repair import exact

SCALES = (0.05, 0.1, 0.2, 0.5, 1.0, None, 3.0)  # None: 3 over the root of hundreds of contigs, 3 at most


def _parts_allowed(bp: str, viable: int):
    return F.least(F.lit(12), 2 + F.floor(F.col(bp) / viable))


def accepted(hits: DataFrame, sets: DataFrame, lengths: DataFrame, parts: DataFrame, viable: int = 200_000, over: float = 5.5, least: int = 400_000, least_completeness: float = 0.0) -> DataFrame:
    """(bin, parts, contamination, left, accept): whether bins over `over` contamination are better as parts (bin, contig, part).

    left: the contamination of the viable parts, by their share of the bin's bases. From 15 on, one clean part or 10 less are enough; below, a part of the top tier, or 1 less at 2
    less completeness at most. Two viable parts at least, and a quarter of the bases outside them at most.
    """
    sized = parts.join(lengths.select("contig", "length"), "contig", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    by = sized.groupBy("bin", "part").agg(F.sum("length").alias("bp"))
    whole = by.groupBy("bin").agg(F.sum("bp").alias("total"), F.count(F.lit(1)).alias("parts"))
    now = quality.set_quality(hits.join(parts.select("bin", "contig"), ["bin", "contig"], "left_semi"), sets)
    bad = whole.join(now, "bin").where((F.col("total") >= least) & (exact(F.col("contamination")) > over) & (exact(F.col("completeness")) >= least_completeness))
    inside = hits.join(parts, ["bin", "contig"]).select(F.struct("bin", "part").alias("key"), "marker")
    of = quality.set_quality(inside, sets, "key").select("key.bin", "key.part", F.col("completeness").alias("c"), F.col("contamination").alias("x"))
    each = by.join(bad.select("bin", "total"), "bin").join(of, ["bin", "part"], "left")
    c, x, share = F.coalesce("c", F.lit(0.0)), F.coalesce("x", F.lit(0.0)), F.col("bp") / F.col("total")
    good = F.col("bp") >= viable
    sums = each.groupBy("bin").agg(
        F.count_if(good).alias("viable"), F.coalesce(F.sum(F.when(~good, F.col("bp"))), F.lit(0)).alias("spill"),
        F.coalesce(F.sum(F.when(good, share * c)), F.lit(0.0)).alias("kept"), F.coalesce(F.sum(F.when(good, share * x)), F.lit(0.0)).alias("left"),
        F.count_if(good & (exact(c) >= 90) & (exact(x) <= 5)).alias("top"), F.max(good & (exact(x) < 5)).alias("clean"),
    )
    both = bad.join(sums, "bin")
    fits = (F.col("parts") >= 2) & (F.col("parts") <= _parts_allowed("total", viable)) & (F.col("viable") >= 2) & (4 * F.col("spill") <= F.col("total"))
    before, after = F.col("contamination"), F.col("left")
    purified = F.col("clean") | (exact(after) <= exact(before - 10))
    better = (F.col("top") > 0) | ((exact(after) <= exact(before - 1)) & (exact(F.col("kept")) >= exact(F.col("completeness") - 2)))  # a bin over `over` isn't of the top tier
    return both.select("bin", "parts", "contamination", "left", (fits & F.when(exact(before) >= 15, purified).otherwise(better)).alias("accept"))


def split(hits: DataFrame, sets: DataFrame, edges: DataFrame, labels: DataFrame, lengths: DataFrame, resolution: float = 1.0, viable: int = 200_000, over: float = 5.5, least: int = 400_000, least_completeness: float = 0.0, **how: int) -> DataFrame:
    """(bin, contig, part) of all contigs: part is the least contig of its accepted part, null in bins that stay whole.

    hits: (bin, contig, marker); sets: (set_id, marker); edges: (u, v, w); labels: (node, label), the bins; lengths: (contig, length).
    """
    members = cut(labels.select(F.col("label").alias("bin"), F.col("node").alias("contig")))
    sized = members.join(lengths.select("contig", "length"), "contig", "left")
    whole = sized.groupBy("bin").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("total") >= least))
    bad = cut(quality.set_quality(hits, sets).where((exact(F.col("contamination")) > over) & (exact(F.col("completeness")) >= least_completeness)).join(whole, "bin").select("bin", "total", "n"))
    inside = members.join(bad.select("bin"), "bin", "left_semi")
    side = lambda c: inside.select(F.col("contig").alias(c), F.col("bin").alias(f"b{c}"))
    links = edges.where("u <> v").join(side("u"), "u").join(side("v"), "v").where("bu = bv").select(F.col("bu").alias("bin"), "u", "v", "w")
    near = links.unionAll(links.select("bin", F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("bin", "u", "v").agg(F.sum("w").alias("w"))
    scales = F.posexplode(F.array(*(F.lit(s) if s else F.least(F.lit(3.0), 3.0 / F.sqrt(F.greatest(F.lit(1.0), F.col("n") / 100))) for s in SCALES)))
    linked = near.groupBy("bin").agg((F.sum("w") / 2).alias("m"))
    runs = cut(bad.join(linked, "bin").select("bin", "total", "n", "m", scales.alias("scale", "x")).select(F.struct("bin", "scale").alias("run"), "bin", "scale", "total", (resolution * F.col("x") * 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1.0))).alias("factor")))
    # a bin's links are read once for each scale, which is what its sub-graphs differ by
    graph = cut(near.join(runs.select("bin", "run"), "bin").select("run", "u", "v", "w"))
    nodes = cut(inside.join(runs.select("bin", "run"), "bin").select("run", F.col("contig").alias("node")))
    mass = nodes.withColumn("size", F.lit(1.0))
    found = cut(potts.optimised(graph, nodes.withColumn("label", F.col("node")), mass, runs.select("run", "factor"), **{"passes": 1} | how))
    number = found.groupBy("run").agg(F.count_distinct("label").alias("parts")).join(runs, "run")
    first = number.where((F.col("parts") >= 2) & (F.col("parts") <= _parts_allowed("total", viable))).groupBy("bin").agg(F.min("scale").alias("scale"))
    pick = found.select("run.bin", "run.scale", F.col("node").alias("contig"), F.col("label").alias("part")).join(first, ["bin", "scale"]).select("bin", "contig", "part")
    pick = cut(pick)
    yes = accepted(hits, sets, lengths, pick, viable, over, least, least_completeness).where("accept").select("bin")
    out = members.join(pick.join(yes, "bin", "left_semi"), ["bin", "contig"], "left")
    forget(graph, nodes, found)
    return out
