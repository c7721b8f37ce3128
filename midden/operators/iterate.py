"""Iterative operators: driver loops over DataFrames whose lineage is cut by written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="midden-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of results of cut that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): every round a node takes the label of the greatest weight around it, its own counting once more; ties to the smallest.

    edges: undirected (u, v, w).
    """
    both = cut(edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    own = both.groupBy("u").agg(F.max("w").alias("w")).select("u", F.col("u").alias("v"), "w")
    both = cut(both.unionAll(own))
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        near = both.join(labels.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node"), "label").agg(F.round(F.sum("w"), 9).alias("w"))
        new = cut(near.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")))
        moved = not new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        labels = new
        if not moved:
            break
    return labels


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.3, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): random walk on undirected (u, v, w) that returns to the seeds (node) with probability alpha; what dangles returns too."""
    both = edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    out = both.groupBy("u").agg(F.sum("w").alias("out"))
    step = cut(both.join(out, "u").select("u", "v", (F.col("w") / F.col("out")).alias("p")))
    n = seeds.distinct().count()
    nodes = step.select(F.col("u").alias("node")).unionAll(seeds.select("node")).distinct()
    start = cut(nodes.join(seeds.distinct().withColumn("home", F.lit(1.0 / max(1, n))), "node", "left").select("node", F.coalesce("home", F.lit(0.0)).alias("home")))
    ranks = start.select("node", F.col("home").alias("rank"))
    for _ in range(rounds):
        given = step.join(ranks, step["u"] == ranks["node"]).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        walked = start.join(given, "node", "left").select("node", "home", F.coalesce("got", F.lit(0.0)).alias("got"))
        lost = 1.0 - (walked.agg(F.sum("got")).first()[0] or 0.0)
        new = walked.select("node", (alpha * F.col("home") + (1 - alpha) * (F.col("got") + lost * F.col("home"))).alias("rank"))
        new = cut(new)
        change = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        ranks = new
        if change < tolerance:
            break
    return ranks


def two_components(rows: DataFrame, group: str, log_a: str, log_b: str, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """(group, share, n, rounds): the mixing share of component a by EM over rows' log-likelihoods; a group stops by itself, from its second round on.

    Each round is one partial aggregation, so a group may hold any share of the rows; groups that have stopped leave the rounds.
    """
    base = cut(rows.select(F.col(group).alias("g"), (F.col(log_b) - F.col(log_a)).alias("diff")))
    share = cut(base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", "n", F.lit(0.5).alias("share"), F.lit(0).alias("rounds"), F.lit(False).alias("done")))
    for step in range(1, rounds + 1):
        odds = F.col("share") / (1.0 - F.col("share"))
        post = 1.0 / (1.0 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("diff")))) / odds)
        new = base.join(share.where("NOT done"), "g").groupBy("g").agg(F.first("n").alias("n"), F.first("share").alias("old"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.avg(post))).alias("share"))
        near = (F.abs(F.col("share") - F.col("old")) < tolerance) & F.lit(step > 1)
        share = cut(share.where("done").unionByName(new.select("g", "n", "share", F.lit(step).alias("rounds"), near.alias("done"))))
        if share.where("NOT done").isEmpty():
            break
    return share.select(F.col("g").alias(group), "share", "n", "rounds")


def _graph(edges: DataFrame) -> DataFrame:
    """(run, u, v, w) in both directions, pairs added up; self-links, once."""
    both = edges.select("run", "u", "v", "w").unionAll(edges.where("u <> v").select("run", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return both.groupBy("run", "u", "v").agg(F.sum("w").alias("w"))


def local_moves(graph: DataFrame, labels: DataFrame, runs: DataFrame, within: DataFrame | None = None, rounds: int = 8) -> DataFrame:
    """(run, node, label): nodes move to the neighbouring label of the greatest gain in modularity, ties to their own, then to the least.

    In each round a seeded half of the nodes may move, so that neighbours seldom swap labels; it ends after two rounds with no move, or
    `rounds`. graph: of _graph; labels: (run, node, label); runs: (run, resolution, seed, m2), a few rows; within: (run, node, label), nodes
    only join labels of nodes that share theirs in it. A round is joins and sums over edges, whatever a label's size.
    """
    degree = cut(graph.groupBy("run", F.col("u").alias("node")).agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("degree")))
    near = graph.where("u <> v")
    if within is not None:
        side = lambda c: within.select("run", F.col("node").alias(c), F.col("label").alias(f"in_{c}"))
        near = near.join(side("u"), ["run", "u"]).join(side("v"), ["run", "v"]).where("in_u = in_v")
    near = cut(near.select("run", "u", "v", "w"))
    labels, quiet = cut(labels.select("run", "node", "label")), 0
    for step in range(rounds):
        own = labels.join(degree, ["run", "node"])
        mass = own.groupBy("run", "label").agg(F.sum("degree").alias("mass"))
        known = labels.join(mass, ["run", "label"])
        # Labels bring their mass to the links, which are dealt to the nodes once; all that follows is by node.
        to = near.join(known.withColumnRenamed("node", "v"), ["run", "v"]).select("run", F.col("u").alias("node"), "label", "w", "mass").unionAll(known.select("run", "node", "label", F.lit(0.0).alias("w"), "mass"))
        to = to.repartition("run", "node").groupBy("run", "node", "label").agg(F.sum("w").alias("x"), F.max("mass").alias("mass"))
        rows = to.join(own.select("run", "node", F.col("label").alias("old"), "degree"), ["run", "node"]).join(F.broadcast(runs), "run")  # a row a run is broadcast
        stays = F.col("label") == F.col("old")
        gain = F.round(F.col("x") - F.col("resolution") * F.col("degree") * (F.col("mass") - F.when(stays, F.col("degree")).otherwise(0.0)) / F.col("m2"), 9)
        best = rows.groupBy("run", "node").agg(F.min(F.struct((-gain).alias("g"), (~stays).alias("m"), F.col("label"))).alias("b"), F.first("old").alias("old"), F.first("seed").alias("seed"))
        may = F.pmod(F.xxhash64("node", "seed", F.lit(step // 2)), F.lit(2)) == step % 2
        new = cut(best.select("run", "node", F.when(may, F.col("b.label")).otherwise(F.col("old")).alias("label"), "old"))
        quiet = quiet + 1 if new.where("label <> old").isEmpty() else 0
        labels = new.select("run", "node", "label")
        if quiet == 2:
            break
    return labels


def aggregated(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph (run, u, v, w) of labels: links between two labels added up once, those inside one, and self-links, as its self-link."""
    side = lambda c: labels.select("run", F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    named = graph.where("u <= v").join(side("u"), ["run", "u"]).join(side("v"), ["run", "v"])
    return named.groupBy("run", F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).agg(F.sum("w").alias("w"))


def communities(edges: DataFrame, resolutions: list[float], seeds: list[int], levels: int = 3, rounds: int = 8) -> DataFrame:
    """(resolution, seed, node, label): a partition for each pair by local moves, refinement and aggregation; a label is its least node.

    All pairs go through the same joins, a run of each, so nothing is held by one task. In a level nodes move, then start
    anew as singles that may only join within their community; what they form are the nodes of the next level, which begin in
    their communities. It ends where a level's refined communities are its nodes.
    """
    spark = edges.sparkSession
    pairs = [(i, float(r), int(s)) for i, (r, s) in enumerate((r, s) for r in resolutions for s in seeds)]
    grid = spark.createDataFrame(pairs, "run int, resolution double, seed int")
    graph = cut(_graph(edges.select("u", "v", "w").crossJoin(F.broadcast(grid.select("run")))))  # the grid is a few rows of parameters
    total = graph.groupBy("run").agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("m2"))
    runs = cut(grid.join(total, "run"))
    place = graph.select("run", F.col("u").alias("node")).distinct().withColumn("at", F.col("node"))
    labels = place.select("run", "node", F.col("node").alias("label"))
    for _ in range(levels):
        labels = local_moves(graph, labels, runs, rounds=rounds)
        parts = local_moves(graph, labels.select("run", "node", F.col("node").alias("label")), runs, within=labels, rounds=rounds)
        place = cut(place.join(parts.select("run", F.col("node").alias("at"), "label"), ["run", "at"]).select("run", "node", F.col("label").alias("at")))
        above = cut(parts.join(labels.withColumnRenamed("label", "of"), ["run", "node"]).groupBy("run", F.col("label").alias("node")).agg(F.min("of").alias("label")))
        merged = not parts.where("node <> label").isEmpty()
        labels = above
        if not merged:
            break
        graph = cut(_graph(aggregated(graph, parts)))
    named = place.join(labels.select("run", F.col("node").alias("at"), "label"), ["run", "at"])
    least = named.groupBy("run", "label").agg(F.min("node").alias("least"))
    return named.join(least, ["run", "label"]).join(F.broadcast(grid), "run").select("resolution", "seed", "node", F.col("least").alias("label"))


def partition_quality(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(quality): weight inside labels less resolution * degree^2 / (2 m) of each, in units of weight; labels: (node, label)."""
    named = edges.join(labels.withColumnsRenamed({"node": "u", "label": "lu"}), "u").join(labels.withColumnsRenamed({"node": "v", "label": "lv"}), "v")
    inside = named.agg(F.sum(F.when(F.col("lu") == F.col("lv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    ends = named.select(F.col("lu").alias("label"), "w").unionAll(named.select(F.col("lv").alias("label"), "w"))
    square = ends.groupBy("label").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inside.join(F.broadcast(square)).select((F.col("inside") - resolution * F.col("k2") / (4 * F.col("m"))).alias("quality"))
