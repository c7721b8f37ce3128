"""Reads to observations, counts, models and calls, by hand and by brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from midden import sources
from midden.functions import damage as fd
from midden.functions import sequence as sq
from midden.operators import damage_model as dm
from midden.operators import iterate, knn, reads, repair

SAM = [
    "@HD",
    "\t".join(["r1", "0", "c", "11", "60", "2S4M1D3M", "*", "0", "0", "NNTCGTAAC", "IIIIIIIII", "MD:Z:0C3^A3", "NM:i:2"]),
    "\t".join(["r2", "16", "c", "5", "60", "6M", "*", "0", "0", "ACGTAA", "IIIIII", "MD:Z:5G0"]),
    "\t".join(["u", "4", "*", "0", "0", "*", "*", "0", "0", "ACGT", "IIII"]),
    "\t".join(["dup", "256", "c", "5", "60", "6M", "*", "0", "0", "ACGTAA", "IIIIII", "MD:Z:6"]),
    "\t".join(["nomd", "0", "c", "5", "60", "6M", "*", "0", "0", "ACGTAA", "*"]),
]


@pytest.fixture(scope="module")
def obs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sam") / "s"
    path.write_text("\n".join(SAM) + "\n")
    return reads.observations(sources.sam(spark, str(path)))


def test_pairs_from_cigar_and_md():
    place, ref, read = reads.aligned_pairs(b"NNTCGTAAC", "2S4M1D3M", "0C3^A3")
    assert place.tolist() == [2, 3, 4, 5, 6, 7, 8] and ref.tobytes() == b"CCGTAAC" and read.tobytes() == b"TCGTAAC"
    assert reads.aligned_pairs(b"ACGT", "1M2I1M", "2")[0].tolist() == [0, 3]
    assert len(reads.aligned_pairs(b"", "", "")[0]) == 0


def test_observations_and_counts(obs):
    rows = {(r["qname"], r["d5"]): r for r in obs.collect()}
    assert (rows["r1", 3]["ref"], rows["r1", 3]["base"], rows["r1", 3]["d3"]) == ("C", "T", 7)
    # The reverse read's last base, A for G, is its first as T for C.
    assert (rows["r2", 1]["ref"], rows["r2", 1]["base"], rows["r2", 1]["d3"], rows["r2", 1]["q"]) == ("C", "T", 6, 40)
    assert {q for q, _ in rows} == {"r1", "r2"}
    counts = {(r["end"], r["position"]): (r["k"], r["n"]) for r in reads.terminal_counts(obs, ["contig"], 3).collect()}
    assert counts[5, 0] == (1, 1) and counts[5, 2] == (1, 1)


def test_classifier_by_hand(spark):
    rows = spark.createDataFrame([("a", "C", "T", 40, 1, 30), ("b", "C", "T", 40, 30, 1), ("c", "A", "A", 40, 1, 1), ("d", "C", "T", 2, 1, 30)], "read string, ref string, base string, q int, d5 int, d3 int")
    got = {r["read"]: r for r in reads.classify(rows, ["read"]).collect()}
    d, e = 0.31, 1e-3
    ratio = math.log(d * (1 - e) + (1 - d) * e / 3) - math.log(e / 3)
    assert got["a"]["llr"] == pytest.approx(ratio) and got["a"]["consistent"] == 1 and got["a"]["p"] > 0.99
    assert got["b"]["inconsistent"] == 1 and got["c"]["p"] == 0.5 and got["d"]["mismatches"] == 0 and got["d"]["p"] == 0.5
    like = {r["read"]: r for r in reads.population_likelihoods(rows, ["read"]).collect()}
    assert like["a"]["detected"] == 1 and like["b"]["detected"] == 0 and like["a"]["expected"] == pytest.approx(d)
    share = reads.detection(reads.population_likelihoods(rows.withColumn("g", F.lit(1)), ["g", "read"]), ["g"]).first()
    assert share["observed"] == 0.5 and 0 <= share["undamaged"] <= 1


def test_calls_by_hand(spark):
    rows = [(1, "A", 40, 20, 20, 0.9)] * 3 + [(2, "T", 40, 1, 20, 0.9)] * 3 + [(3, "A", 40, 20, 20, 0.1), (3, "C", 40, 20, 20, 0.9)] * 3
    df = spark.createDataFrame(rows, "pos int, base string, q int, d5 int, d3 int, p_ancient double")
    two = {r["pos"]: r for r in reads.genotype_two_stage(df, ["pos"]).collect()}
    assert (two[1]["base"], two[1]["stage"]) == ("A", 1) and (two[2]["base"], two[2]["stage"]) == ("T", 2)
    both = {r["pos"]: r for r in reads.genotype_two_population(df, ["pos"]).collect()}
    assert both[3]["ancient_base"] == "C" and both[3]["modern_base"] == "A" and both[3]["disagree"] and both[3]["disagreement"] > 0.9
    ratio = reads.site_ratios(df, ["pos"]).where("pos = 2").first()
    assert ratio["ct"] > -10 and ratio["ga"] == 0


def test_log_gamma():
    x = np.array([0.01, 0.3, 1, 2.5, 7.99, 8, 100, 1e6])
    assert np.allclose(dm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_model_finds_the_curve():
    z = np.arange(20)
    n = np.full(20, 2000)
    k = np.round(n * (0.2 * np.exp(-0.6 * z) + 0.01)).astype(int)
    fit = dm.rates_fit(k, n)
    assert fit["amplitude"] == pytest.approx(0.2, abs=0.03) and fit["decay"] == pytest.approx(0.6, abs=0.15) and fit["r2"] > 0.95
    m = dm.model(k, n, k, n)
    assert m["p"] > 0.99 and dm.model(np.full(20, 20), n, np.full(20, 20), n)["p"] <= 0.5
    assert dm.model(*[np.zeros(20, int)] * 4)["p"] == 0.5


def test_shifts_equal_models_of_pooled_segments(spark):
    rng = np.random.default_rng(2)
    rows = []
    for w in range(20):
        for end in (5, 3):
            for z in range(20):
                rate = (0.25 * math.exp(-0.5 * z) if w < 10 else 0.0) + 0.01
                rows.append(("c", w, end, z, int(rng.binomial(300, rate)), 300))
    df = spark.createDataFrame(rows, "contig string, window long, end int, position int, k long, n long")
    got = {r["window"]: r for r in dm.model_shifts(df, ["contig"]).collect()}
    assert set(got) == {10}
    pool = lambda a, b, end, i: np.array([sum(r[i] for r in rows if a <= r[1] < b and r[2] == end and r[3] == z) for z in range(20)])
    want = dm.model(pool(5, 10, 5, 4), pool(5, 10, 5, 5), pool(5, 10, 3, 4), pool(5, 10, 3, 5))
    assert got[10]["p_before"] == pytest.approx(want["p"])


def test_accessions_aliases_and_folders(spark, tmp_path):
    (tmp_path / "m.hmm").write_text("HMMER3/f\nNAME  Alpha\nACC   PF00832.15\nLENG 3\n//\nHMMER3/f\nNAME  Beta\nLENG 2\n//\nHMMER3/f\nNAME  Gamma\nACC   TIGR1.2\n//\n")
    assert {(r["name"], r["accession"]) for r in sources.hmm_accessions(spark, str(tmp_path / "m.hmm")).collect()} == {("Alpha", "PF00832"), ("Gamma", "TIGR1.2")}
    df = spark.createDataFrame([("TIGR00388",), ("X",)], ["m"])
    assert [r["a"] for r in df.select(sq.marker_alias(F.col("m")).alias("a")).collect()] == ["TIGR00389", "X"]
    folder = tmp_path / "bins"
    folder.mkdir()
    (folder / "b1.fa").write_text(">c1 x\nAC\nGT\n>c2\nA\n")
    (folder / "b2.fasta").write_text(">c3\nTTT\n")
    (folder / "note.txt").write_text("nothing")
    assert sorted((r["bin"], r["contig"], r["length"]) for r in sources.bin_directory(spark, str(folder)).collect()) == [("b1", "c1", 4), ("b1", "c2", 1), ("b2", "c3", 3)]
    report = spark.createDataFrame([("b", 0.5, 1.0, 1.0, 0.1, 0.1, 0.2, 0.2, "ancient")], [f"c{i}" for i in range(9)])
    sources.write_report(report, str(tmp_path / "out"), "damage_per_bin")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).columns[:2] == ["bin", "p_ancient"]
    with pytest.raises(ValueError):
        sources.write_report(report.drop("c0"), str(tmp_path / "out2"), "damage_per_bin")


def test_likelihoods_by_hand(spark):
    df = spark.createDataFrame([(0.0, 99.0), (40.0, 100.0)], ["length", "identity"])
    got = df.select(fd.length_log_likelihood(F.col("length"), 40.0, 10.0).alias("a"), fd.identity_log_likelihood(F.col("identity"), 100.0, 2.0).alias("b")).collect()
    assert got[0]["a"] == -100.0 and got[1]["a"] == pytest.approx(-math.log(10)) and got[0]["b"] == pytest.approx(-0.125 - math.log(2))
    z = spark.createDataFrame([(0.975,), (0.5,), (0.0,)], ["p"]).select(fd.normal_quantile(F.col("p")).alias("z")).collect()
    assert z[0]["z"] == pytest.approx(1.96, abs=1e-3) and z[1]["z"] == 0 and z[2]["z"] == -6
    kinds = spark.createDataFrame([(0.9, 0.1, 0.5), (0.9, 0.1, 0.2), (0.4, 0.1, 0.5)], ["p", "a", "d"]).select(fd.model_class(F.col("p"), F.col("a"), F.col("d")).alias("c")).collect()
    assert [r["c"] for r in kinds] == ["ancient", "uncertain", "modern"]


def test_groups_stop_by_themselves(spark):
    rows = [("easy", -1.0, -30.0)] * 10 + [("mixed", -1.0, -1.5)] * 6 + [("mixed", -1.4, -1.0)] * 5
    got = {r["g"]: r for r in iterate.two_components(spark.createDataFrame(rows, ["g", "a", "b"]), "g", "a", "b").collect()}
    theta, steps = 0.5, 0
    while True:
        steps += 1
        post = [theta * math.exp(a) / (theta * math.exp(a) + (1 - theta) * math.exp(b)) for g, a, b in rows if g == "mixed"]
        new = min(1 - 1e-6, max(1e-6, sum(post) / len(post)))
        done = abs(new - theta) < 1e-4 and steps > 1
        theta = new
        if done or steps == 50:
            break
    assert got["mixed"]["share"] == pytest.approx(theta) and got["mixed"]["rounds"] == steps and got["easy"]["rounds"] < steps


def test_communities_of_cliques(spark):
    edges = [(a, b, 1.0) for g in range(0, 30, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10, 0.1), (10, 20, 0.1)]
    got = iterate.communities(spark.createDataFrame(edges, "u long, v long, w double"), [1.0], [1])
    assert {r["node"]: r["label"] for r in got.collect()} == {g + i: g for g in (0, 10, 20) for i in range(5)}


def test_neighbours_with_ties_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (90, 4)).astype(float)
    got = {(r["i"], r["rank"]): r["j"] for r in knn.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 5).collect()}
    for i in range(90):
        order = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(90) if j != i)[:5]
        assert [got[i, r + 1] for r in range(5)] == [j for _, j in order]


def test_removals_by_hand(spark):
    hits = spark.createDataFrame([(1, "x", "a"), (1, "y", "a"), (1, "y", "b"), (1, "z", "c")], "bin int, contig string, marker string")
    sets = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "set_id int, marker string")
    order = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "none", 3)], "bin int, contig string, rank int")
    got = {r["rank"]: (r["completeness"], r["contamination"]) for r in repair.prefix_quality(hits, sets, order).collect()}
    assert got[1] == (100.0, 0.0) and got[2] == (50.0, 0.0) and got[3] == (50.0, 0.0)


def test_principal_components(spark):
    from midden.operators import reduce

    x = np.random.default_rng(3).normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1]) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(5)
    pca = reduce.principal_components(df, "v", 2)
    values = np.linalg.svd(x - x.mean(axis=0))[1][:2] ** 2 / 199
    assert np.allclose(pca.variances, values) and np.allclose(pca.mean, x.mean(axis=0))
    got = {r["id"]: r["p"] for r in df.select("id", pca.project(F.col("v")).alias("p")).collect()}
    assert got[900] is None and np.allclose(np.array([got[i] for i in range(200)]).var(axis=0, ddof=1), values)


def test_mixtures_find_their_number(spark):
    from midden.operators import mixtures

    rng = np.random.default_rng(5)
    rows = [("one", float(v)) for v in rng.normal(50, 3, 200)] + [("two", float(v)) for v in np.concatenate((rng.normal(20, 2, 150), rng.normal(60, 2, 100)))] + [("few", 1.0)] * 4
    df = spark.createDataFrame(rows, "g string, x double")
    fitted = mixtures.fits(df, ["g"], "x", 2, 15)
    assert {r["g"]: r["k"] for r in mixtures.preferred(fitted, ["g"]).collect()} == {"one": 1, "two": 2, "few": 1}
    two = fitted.where("g = 'two' AND k = 2")
    r = two.first()
    assert sorted((r["m0"], r["m1"])) == pytest.approx([20, 60], abs=1) and r["w0"] + r["w1"] == pytest.approx(1)
    out = mixtures.parts(df, two, ["g"], "x", 2).groupBy("part").agg(F.count("*").alias("n"), F.max("x").alias("top")).collect()
    assert {(r["part"], r["n"]) for r in out} == {(0, 150), (1, 100)}
