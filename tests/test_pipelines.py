"""The commands on planted bins."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from midden.plans import pipelines


def planted():
    rng = random.Random(4)
    rows = [(g * 20 + i, [g * 5.0 + rng.random() * 0.3, rng.random() * 0.3]) for g in range(3) for i in range(8)]
    hits = [(g * 20 + i, f"m{i}") for g in range(3) for i in range(6)]
    return rows, hits


def groups(bins) -> list[list[int]]:
    by: dict = {}
    for r in bins.collect():
        by.setdefault(r["bin"], []).append(r["contig"])
    return sorted(sorted(x) for x in by.values())


def test_bins_of_embeddings(spark):
    rows, hits = planted()
    e = spark.createDataFrame(rows, "contig long, embedding array<double>")
    h = spark.createDataFrame(hits, "contig long, marker string")
    sets = spark.createDataFrame([(i // 2, f"m{i}") for i in range(6)], "set_id int, marker string")
    got = groups(pipelines.bins_of_embeddings(e, h, sets, k=7, ratio=90, resolutions=(1.0,), seeds=(1,)))
    assert got == [[g * 20 + i for i in range(8)] for g in range(3)]


def test_consensus_of_runs(spark):
    rows, hits = planted()
    e = spark.createDataFrame([(r, c, v) for r in range(3) for c, v in rows], "run int, contig long, embedding array<double>")
    labels = [(r, c, c // 20 if (c + r) % 9 else None) for r in range(3) for c, _ in rows]
    lab = spark.createDataFrame(labels, "run int, contig long, bin int")
    h = spark.createDataFrame(hits, "contig long, marker string")
    sets = spark.createDataFrame([(0, f"m{i}") for i in range(6)], "set_id int, marker string")
    got = groups(pipelines.consensus_of_runs(lab, e, h, sets, resolutions=(1.0,), seeds=(1,)))
    assert all(len({c // 20 for c in x}) == 1 for x in got) and sum(map(len, got)) >= 20


def test_damage_of_bins(spark):
    obs = [(c, e, z, int(1000 * (0.01 + (0.2 if c < 2 else 0.0) * 0.6**z)), 1000, 0.9 if c < 2 else 0.1) for c in range(4) for e in (5, 3) for z in range(20)]
    bins = spark.createDataFrame([(c, c // 2) for c in range(4)], "contig long, bin int")
    rows = {r["bin"]: r for r in pipelines.damage_of_bins(spark.createDataFrame(obs, "contig long, end int, position int, k long, n long, p double"), bins).collect()}
    assert {k: r["damage_class"] for k, r in rows.items()} == {0: "ancient", 1: "modern"}
    assert abs(rows[0]["decay5"] - 0.5) <= 0.1 and abs(rows[0]["amplitude3"] - 0.2) <= 0.03 and rows[1]["amplitude5"] < 0.01


def test_chimeric_breakpoints(spark):
    rows = [("c", p, 10.0 if p < 21 else 30.0, 100.0 if p != 21 else 70.0, 1.0 if p != 21 else 9.0, 2 if p < 21 else 20, 50) for p in range(40)]
    got = pipelines.chimeric_breakpoints(spark.createDataFrame(rows, "contig string, pos int, depth double, score double, mismatches double, k long, n long")).collect()
    assert {r["pos"] for r in got} >= {21} and max(r["families"] for r in got) == 4


def test_ancient_reads(spark):
    rows = [("c", -1.0, -9.0)] * 70 + [("c", -9.0, -1.0)] * 30
    got = pipelines.ancient_reads(spark.createDataFrame(rows, "contig string, a double, b double"), ("a", "b"))
    assert got.where(F.col("p_ancient") > 0.5).count() == 70
