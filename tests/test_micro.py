"""Hand-computed cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from midden import sources
from midden.functions import damage as fd
from midden.functions import fractal, kmers
from midden.functions import sequence as sq
from midden.operators import damage, damage_model, graph, iterate, knn, quality, signals


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_set_quality_by_hand(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], ["bin", "marker"])
    sets = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], ["set_id", "marker"])
    row = quality.set_quality(hits, sets).first()
    assert (row["completeness"], row["contamination"]) == (50.0, 25.0)


def test_flat_quality_by_hand(spark):
    row = quality.flat_quality(spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], ["bin", "marker"]), 3).first()
    assert row["completeness"] == pytest.approx(200 / 3) and row["contamination"] == pytest.approx(100 / 3)


def test_cobinned_by_hand(spark):
    labels = spark.createDataFrame([(0, "x", 1), (0, "y", 1), (1, "x", 1), (1, "y", 1), (2, "x", 1), (2, "y", 2)], ["run", "contig", "bin"])
    row = graph.cobinned(labels).first()
    assert row["together"] == 2 and row["p"] == pytest.approx(2 / 3)
    assert graph.consensus_edges(graph.cobinned(labels)).count() == 1


@pytest.mark.parametrize("lengths,want", [([5, 3, 2], 5), ([4, 3, 2], 4)])
def test_n50(spark, lengths, want):
    rows = spark.createDataFrame([(0, str(i), n) for i, n in enumerate(lengths)], ["bin", "contig", "length"])
    assert quality.n50(rows, ["bin"]).first()["n50"] == want


def test_smoothed_rate_and_kish(spark):
    assert one(spark, fd.smoothed_rate(F.col("k"), F.col("n")), k=3, n=9) == pytest.approx(0.35)
    assert one(spark, fd.smoothed_rate(F.col("k"), F.col("n")), k=0, n=0) == 0.5
    rows = spark.createDataFrame([(0, 1.0, 0.5), (0, 1.0, 0.5), (0, 2.0, 0.5)], ["g", "w", "p"])
    assert damage.kish(rows, ["g"], F.col("w"), F.col("p")).first()["n_eff"] == pytest.approx(16 / 6)


def test_upper_median(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4)], ["g", "v"])
    assert damage.fragment_stats(rows, ["g"], "v").first()["median"] == 3.0


def test_cutoff_of_four(spark):
    edges = spark.createDataFrame([(0.4,), (0.1,), (0.3,), (0.2,)], ["d"])
    assert graph.cutoff(edges, 50).first()["cutoff"] == 0.3


def test_decay_fit(spark):
    rows = [(0, z, 0.01 + 0.2 * math.exp(-0.5 * z)) for z in range(5)] + [(1, z, 0.01) for z in range(5)]
    got = {r["bin"]: (r["decay"], r["amplitude"]) for r in damage_model.decay_line(spark.createDataFrame(rows, ["bin", "position", "rate"]), ["bin"]).collect()}
    assert got[0] == pytest.approx((0.5, 0.2)) and got[1] == (0.5, 0.1)


def test_seed_marker(spark):
    rows = [("c1", "A", 10), ("c2", "A", 10)] + [(f"c{i}", m, q) for m, q in (("B", 100), ("C", 80)) for i in range(3)]
    assert quality.seed_marker(spark.createDataFrame(rows, ["contig", "marker", "qlen"])).first()["marker"] == "C"


def test_classes(spark):
    assert one(spark, fd.damage_class(F.col("p"), F.col("c")), p=0.6, c=0.03) == "ancient"
    assert one(spark, fd.consensus_class(F.col("a"), F.col("b")), a=0.06, b=0.02) == "moderate"


def test_sequences(spark):
    assert one(spark, sq.revcomp(F.col("s")), s="AACGTN") == "NACGTT"
    assert one(spark, sq.gc_fraction(F.col("s")), s="GGCATN") == pytest.approx(0.6)
    assert one(spark, sq.gc_fraction(F.col("s")), s="NNN") is None
    assert len(sq.canonical_kmers(4)) == 136
    assert one(spark, sq.contig_of_gene(F.col("s")), s="k_1_10_99_+") == "k_1"
    assert one(spark, sq.strip_version(F.col("s")), s="PF00001.21") == "PF00001"


def test_intervals(spark):
    rows = spark.createDataFrame([("c", 1, 5), ("c", 2, 3), ("c", 6, 8), ("c", 10, 12)], ["contig", "start", "end"])
    merged = signals.merged_intervals(rows, ["contig"])
    assert sorted((r["start"], r["end"]) for r in merged.collect()) == [(1, 8), (10, 12)]
    points = spark.createDataFrame([("c", p) for p in (0, 1, 8, 9, 10, 13)], ["contig", "pos"])
    assert sorted(r["pos"] for r in signals.covered(points, merged, ["contig"]).collect()) == [1, 8, 10]


def test_knn_blocks_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, knn.knn(rows, 3).collect()))
    monkeypatch.setattr(knn, "BLOCK_ROWS", 13)
    assert sorted(map(tuple, knn.knn(rows, 3).collect())) == want and len(want) == 180


def test_label_propagation_splits_cliques(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)]
    got = {r["node"]: r["label"] for r in iterate.label_propagation(spark.createDataFrame(edges, ["u", "v", "w"])).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[0] != got[10]


def brute_lz(s: str) -> float:
    known, at, n = set(), 0, 0
    while at < len(s):
        best = 1
        for size in range(1, min(len(s) - at, 100) + 1):
            if s[at : at + size] in known:
                best = size
                continue
            known.add(s[at : at + size])
            break
        at += best
        n += 1
    return math.log(n) / math.log(len(s))


def random_dna(n: int, seed: int = 1) -> str:
    return "".join("ACGT"[i] for i in np.random.default_rng(seed).integers(0, 4, n))


def test_kernels_by_brute_force():
    s = random_dna(700)
    code = kmers.bases(s)
    assert fractal.lz(s) == pytest.approx(brute_lz(s)) and fractal.lz("A") == 0.5 and fractal.lz("") == 0.0
    x, y, walk = 0.5, 0.5, []
    for c in s:
        cx, cy = {"A": (0, 0), "C": (1, 0), "G": (1, 1), "T": (0, 1)}[c]
        x, y = (x + cx) / 2, (y + cy) / 2
        walk.append((x, y))
    assert np.allclose(fractal.points(code, fractal.WALK_CORNERS), walk, atol=1e-15)
    assert kmers.counts(code, 4).sum() == 697 and len(kmers.counts(code, 4)) == 136
    swap = str.maketrans("ACGT", "TGCA")
    want = {}
    for i in range(697):
        k = min(s[i : i + 4], s[i : i + 4][::-1].translate(swap))
        want[k] = want.get(k, 0) + 1
    assert dict(zip(sq.canonical_kmers(4), kmers.counts(code, 4).tolist(), strict=True)) == {k: want.get(k, 0) for k in sq.canonical_kmers(4)}
    assert len(kmers.syncmer_codes(code)) and kmers.minhash_of(np.array([3, 5, 5])) == kmers.minhash_of(np.array([5, 3]))
    assert kmers.windows(kmers.bases("ACNGT"), 2)[1].tolist() == [True, False, False, True] and len(kmers.windows(kmers.bases("A"), 2)[0]) == 0
    assert np.allclose(kmers.clr_of(np.array([1, 2, 5])).sum(), 0)


def brute_fluctuation(profile: list, w: int) -> float:
    total, valid = 0.0, 0
    for a in range(len(profile) - w + 1):
        part = np.array(profile[a : a + w])
        line = np.polyfit(np.arange(w), part, 1)
        r = part - np.polyval(line, np.arange(w))
        r = r - r.mean()
        other = r * np.where(np.arange(w) % 2 == 0, 1, -1)
        va, vb = (r @ r) / (w - 1), (other @ other) / (w - 1)
        if va < 1e-12:
            continue
        ra, rb = (r @ r + r[1:] @ r[:-1]) / ((2 * w - 1) * va), (other @ other - other[1:] @ other[:-1]) / ((2 * w - 1) * vb)
        v = (ra + (1 + 3 * ra) / w + rb + (1 + 3 * rb) / w) * (1 - 1 / (2 * w)) * (va + vb) / 2
        if v > 0:
            total, valid = total + v, valid + 1
    return math.sqrt(total / (w * valid))


def test_exponents_by_brute_force():
    x = np.random.default_rng(2).normal(size=150)
    profile = np.cumsum(x - x.mean())
    assert fractal.fluctuation(profile, 13)[0] == pytest.approx(brute_fluctuation(profile.tolist(), 13))
    assert abs(fractal.dfa(np.random.default_rng(3).normal(size=2000))) < 0.2  # the fluctuation is by window, so noise has no slope
    rs = []
    for w in fractal.HURST_WINDOWS[:5]:
        own = []
        for a in range(0, len(x) - w + 1, w // 2):
            part = x[a : a + w]
            run = np.cumsum(part - part.mean())
            own.append((run.max() - run.min()) / part.std(ddof=1))
        rs.append((math.log(w), math.log(np.mean(own)), math.sqrt(len(own))))
    lx, ly, lw = map(np.array, zip(*rs, strict=True))
    slope = np.polyfit(lx, ly, 1, w=np.sqrt(lw))[0]
    assert fractal.hurst(x) == pytest.approx(slope)
    assert len(fractal.complexity(random_dna(12_000))) == 14 and fractal.complexity("ACG") == [0.0] * 14
    assert len(fractal.geometric(kmers.bases(random_dna(300)))) == 32 and fractal.cgr_distance(kmers.bases("ACGT" * 50), kmers.bases("ACGT" * 50)) == 0
    assert fractal.nine(kmers.bases(random_dna(499))) == [0.0] * 9 and len(fractal.window_metrics(random_dna(2600))) == 4
    with_n = kmers.bases(random_dna(600) + "N" + random_dna(600, 5))
    assert len(fractal.nine(with_n)) == 9 and len(fractal.cgr_features(with_n)) == 26


def test_a_long_sequence_takes_linear_time():
    import time

    began = time.process_time()
    code = kmers.bases(random_dna(1_000_000))
    assert kmers.counts(code, 4).sum() == 999_997 and len(kmers.entropies(code)) == 5 and len(kmers.syncmer_codes(code)) > 50_000
    fractal.nine(code)
    assert time.process_time() - began < 20


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nAC\n>c2\n" + "A" * 170 + "\n")
    got = sources.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r["contig"], r["length"]) for r in got.collect()) == [("c1", 6), ("c2", 170)]
    sources.write_fasta(got, str(tmp_path / "out"))
    again = sources.fasta(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_domtblout_and_sets(spark, tmp_path):
    cols = ["g_1_9_+", "-", "9", "PF1.2", "acc", "100"] + ["x"] * 9 + ["1", "80"] + ["x"] * 5
    short = cols[:15] + ["1", "20"] + cols[17:]
    (tmp_path / "d").write_text("# head\n" + " ".join(cols) + "\n" + " ".join(short) + "\n")
    assert [r["marker"] for r in sources.domtblout(spark, str(tmp_path / "d")).collect()] == ["PF1.2"]
    (tmp_path / "m").write_text("# c\nx\t1\t[set(['a', 'b']), set(['c'])]\nlater\t[set(['z'])]\n")
    rows = sources.marker_sets(spark, str(tmp_path / "m"), "bacteria").collect()
    assert sorted((r["set_id"], r["marker"]) for r in rows) == [(0, "a"), (0, "b"), (1, "c")]


def test_sam_depth(spark, tmp_path):
    (tmp_path / "s").write_text("@HD\n" + "\t".join(["r", "0", "c", "11", "60", "5M2D3M", "*", "0", "0", "ACGTACGT", "IIIIIIII", "NM:i:2", "MD:Z:8"]) + "\n" + "\t".join(["u", "4", "c", "11", "0", "5M", "*", "0", "0", "ACGTA", "IIIII"]) + "\n")
    reads = sources.sam(spark, str(tmp_path / "s"))
    assert reads.where("qname = 'r'").first()["nm"] == 2
    assert sorted((r["start"], r["end"]) for r in sources.aligned_blocks(reads).collect()) == [(10, 15), (17, 20)]
    depth = signals.depth_segments(sources.aligned_blocks(reads), ["contig"]).collect()
    assert sum((r["to"] - r["from"]) * r["depth"] for r in depth) == 8


def test_marker_separation(spark):
    near = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (1, 1)], "i int, j int")
    hits = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "a"), (2, "b"), (3, "b"), (1, "c")], "contig int, marker string")
    rows = graph.marker_separation(near, hits)
    # 3 names 2 among its neighbours, but the smaller of a pair has to name the greater.
    assert sorted(map(tuple, rows.collect())) == [("a", 3, 2), ("b", 1, 1)]
    assert graph.separation_score(rows).first()["score"] == 0.75
    assert graph.separation_score(rows.limit(0)).first()["score"] == 1.0


def test_jump_has_whole_windows(spark):
    depth = [1.0] * 7 + [9.0] * 9
    rows = spark.createDataFrame([("c", i, d) for i, d in enumerate(depth)] + [("short", i, float(i)) for i in range(8)], "contig string, pos int, depth double")
    found = {(r["contig"], r["pos"]): (r["before"], r["after"]) for r in signals.jump(rows, ["contig"], ["pos"], "depth", 4).collect()}
    want = {}
    for i in range(4, len(depth) - 4, 2):
        before, after = sum(depth[i - 4 : i]) / 4, sum(depth[i : i + 4]) / 4
        if max(before, after) / min(before, after) >= 2:
            want["c", i] = (before, after)
    assert found == want and len(want) == 3


def test_windows_cover_the_whole_sequence():
    code = kmers.bases(random_dna(5000))
    assert len(kmers.window_variances(code)) == 19 and kmers.window_variances(code, most=5) == kmers.window_variances(code)[:5]
    assert [round(kmers.entropy_of(w, 4), 9) for w in kmers.windows_of(code, 1000, 500)] == [round(kmers.entropies(code[a : a + 1000])[2], 9) for a in range(0, 4001, 500)]
