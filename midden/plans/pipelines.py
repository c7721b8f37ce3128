"""The domain's commands as DataFrame programs: bins from embeddings, consensus of runs, damage of bins, chimeras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import damage as fd
from ..operators import damage_model, graph, iterate, knn, quality, signals


def best_partition(parts: DataFrame, hits: DataFrame, sets: DataFrame) -> DataFrame:
    """(contig, bin) of the (resolution, seed) whose bins score best by markers; ties to the smallest parameters.

    parts: (resolution, seed, node, label); hits: (contig, marker); sets: (set_id, marker).
    """
    total = sets.select("marker").distinct().count()
    named = parts.select("resolution", "seed", F.col("node").alias("contig"), F.col("label").alias("bin"))
    scores = quality.partition_score(named.join(hits, "contig", "left"), max(1, total), ("resolution", "seed"))
    runs = parts.select("resolution", "seed").distinct().join(scores, ["resolution", "seed"], "left")
    best = runs.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "resolution", "seed").limit(1).select("resolution", "seed")
    return named.join(F.broadcast(best), ["resolution", "seed"]).select("contig", "bin")  # one row is broadcast


def bins_of_embeddings(embeddings: DataFrame, hits: DataFrame, sets: DataFrame, k: int = 20, ratio: int = 50, bandwidth: float = 1.0, resolutions: tuple = (0.5, 1.0, 2.0), seeds: tuple = (1, 2, 3)) -> DataFrame:
    """(contig, bin) of (contig, embedding): neighbours, kernel edges raised by disjoint and lowered by shared markers, partitions, the best by markers."""
    near = iterate.cut(knn.knn(embeddings, k, "contig", "embedding"))
    edges = graph.shared_markers(graph.kernel_edges(near, ratio, bandwidth), hits)
    have = hits.select("contig").distinct()
    carries = edges.join(have.select(F.col("contig").alias("u"), F.lit(True).alias("hu")), "u", "left").join(have.select(F.col("contig").alias("v"), F.lit(True).alias("hv")), "v", "left")
    both = F.coalesce(F.col("hu") & F.col("hv"), F.lit(False))
    weighted = iterate.cut(carries.select("u", "v", graph.marker_weight(F.col("w"), F.col("shared"), both).alias("w")))
    return best_partition(iterate.cut(iterate.communities(weighted, list(resolutions), list(seeds))), hits, sets)


def consensus_of_runs(labels: DataFrame, embeddings: DataFrame, hits: DataFrame, sets: DataFrame, bandwidth: float = 1.0, least_contigs: int = 5, resolutions: tuple = (0.5, 1.0, 2.0), seeds: tuple = (1, 2, 3)) -> DataFrame:
    """(contig, bin) of runs' labels (run, contig, bin) and embeddings (run, contig, embedding).

    Contigs together in two thirds of their runs are linked by that share times exp(-distance / bandwidth) of their
    mean embeddings, adjusted by markers; clusters under least_contigs are left out.
    """
    spread = embeddings.select("contig", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    mean = spread.groupBy("contig", "k").agg(F.avg("x").alias("m")).groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s.m).alias("e"))
    pairs = graph.consensus_edges(graph.cobinned(labels)).select(F.col("i").alias("u"), F.col("j").alias("v"), "p")
    placed = pairs.join(mean.withColumnsRenamed({"contig": "u", "e": "eu"}), "u").join(mean.withColumnsRenamed({"contig": "v", "e": "ev"}), "v")
    edges = placed.select("u", "v", (F.col("p") * F.exp(-F.sqrt(graph.squared_distance(F.col("eu"), F.col("ev"))) / bandwidth)).alias("w")).where("w > 1e-6")
    shared = graph.shared_markers(edges, hits)
    weighted = iterate.cut(shared.select("u", "v", graph.marker_weight(F.col("w"), F.col("shared"), F.lit(False)).alias("w")))
    bins = best_partition(iterate.cut(iterate.communities(weighted, list(resolutions), list(seeds))), hits, sets)
    large = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_contigs).select("bin")
    return bins.join(large, "bin", "left_semi").select("contig", "bin")


def damage_of_bins(observations: DataFrame, bins: DataFrame) -> DataFrame:
    """The report of damage_model.bin_report; observations: (contig, end, position, k, n, p), positions 0-based from the end 5 or 3, p the posterior of the contig's reads."""
    named = observations.join(bins, "contig")
    contigs = named.groupBy("bin", "contig").agg(F.avg("p").alias("p"), F.sum("n").alias("n"))
    return damage_model.bin_report(named.select("bin", "end", "position", "k", "n"), contigs)


def chimeric_breakpoints(windows: DataFrame, least_families: int = 2) -> DataFrame:
    """(contig, pos, families, evidence) of windows (contig, pos, depth, score, mismatches, k, n): depth jumps, score drops, mismatch spikes and damage shifts that agree."""
    group, order = ["contig"], ["pos"]
    found = {
        "depth": signals.jump(windows, group, order, "depth", 5),
        "score": signals.drops(windows, group, order, "score"),
        "mismatch": signals.spikes(windows, group, order, "mismatches"),
        "damage": signals.smoothed_shift(windows, group, order, "k", "n"),
    }
    return signals.votes(found, ["contig", "pos"]).where(F.col("families") >= least_families)


def ancient_reads(reads: DataFrame, likelihoods: tuple[str, str]) -> DataFrame:
    """reads with the posterior of the first component under the contig's fitted share of it."""
    a, b = likelihoods
    share = iterate.two_components(reads, "contig", a, b).select("contig", "share")
    odds = F.log(F.col("share") / (1 - F.col("share")))
    return reads.join(share, "contig").withColumn("p_ancient", fd.logistic(F.col(a) - F.col(b) + odds))
