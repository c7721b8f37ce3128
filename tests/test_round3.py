"""Cases that round 3's findings name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from comparing import differences, duck
from midden.functions import kmers
from midden.llm import tokens
from midden.operators import cleanup, evidence, graph, knn, neighbour_index, overlaps, repair, signals, tangents
from midden.plans import cleanups, repairs, sequences, slate


def small_events(spark, tmp_path):
    """Users of one to fourteen events, whose values jump at odd and at outer places."""
    rows = [(100 * u + i, u, "view", [1.0, 1.0, 5.0, 0.2, 7.0, 7.0, 1.0][(i * i + u) % 7] + (90.0 if i >= u % 11 else 0.0)) for u in range(1, 15) for i in range(u)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "event_type", "value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    return con


def test_every_event_may_be_a_jump(spark, tmp_path):
    con = small_events(spark, tmp_path)
    assert differences(slate.coverage_jump(spark, str(tmp_path)), con, slate.ORACLES["coverage_jump"]) == []
    rows = spark.createDataFrame([("c", i, d) for i, d in enumerate([1.0, 9.0, 9.0, 9.0])], "contig string, pos int, depth double")
    assert [r["pos"] for r in signals.jump(rows, ["contig"], ["pos"], "depth", 4, every=True).orderBy("pos").collect()] == [1]


def test_every_event_may_have_votes(spark, tmp_path):
    con = small_events(spark, tmp_path)
    rows = slate.breakpoint_votes(spark, str(tmp_path))
    assert differences(rows, con, slate.ORACLES["breakpoint_votes"]) == []
    # The first five events of a user, before which no whole window lies, and every second one had no jumps.
    assert rows.where("event_id % 100 < 5 AND contains(evidence, 'jump')").count() > 0


def test_equal_evidence_calls_the_first_letter(spark):
    """N's and A's errors are the same, in another order; sums of floating-point numbers aren't."""
    rows = []
    for pos in range(60):
        lines = [(i * (pos + 3)) % 7 + 1 for i in range(9)]
        rows += [(pos, a, e) for a, e in zip("A" * 9 + "N" * 9, lines + lines[::-1], strict=True)]
    obs = spark.createDataFrame(rows, "pos int, letter string, n int").coalesce(1).withColumn("e", F.pow(F.lit(10.0), -(5 + F.col("n")) / 10.0))
    found = evidence.genotypes(obs, ["pos"], "letter", F.col("e"), ["A", "N", "R"]).collect()
    assert {r["call"] for r in found} == {"A"} and {round(r["posterior"], 3) for r in found} == {0.5}
    none = evidence.genotypes(obs.limit(1).withColumn("e", F.lit(None).cast("double")), ["pos"], "letter", F.col("e"), ["A", "N", "R"]).first()
    assert (none["call"], none["posterior"]) == ("R", None)


def test_equal_intervals_open_no_second_island(spark):
    """Of equal intervals the order is open; none of them may be dealt to the island before."""
    rows = spark.createDataFrame([("c", 1, 3), ("c", 9, 10), ("c", 9, 10), ("c", 11, 12), ("d", 9, 10), ("d", 9, 10)], "contig string, start long, end long")
    assert sorted(map(tuple, signals.merged_intervals(rows, ["contig"]).collect())) == [("c", 1, 3), ("c", 9, 12), ("d", 9, 10)]


def test_crowded_spans_meet_by_blocks(spark):
    spans = [(i, 1000 * (i % 3) + i % 11, 1000 * (i % 3) + 200 + i % 17) for i in range(90)]
    found = evidence.overlapping(spark.createDataFrame(spans, "k long, a long, b long"), "k", "a", "b", 0.8, block=8)
    ratio = lambda x, y: (min(x[2], y[2]) - max(x[1], y[1])) / (max(x[2], y[2]) - min(x[1], y[1]))
    want = sorted((x[0], y[0], ratio(x, y)) for x in spans for y in spans if x[0] < y[0] and ratio(x, y) >= 0.8)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_of_a_bin_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "UNIT", 3)
    monkeypatch.setattr(graph, "UNITS", 2)
    rows = [(run, c, None if (c + run) % 13 == 0 else c % (3 + run) if c % 5 else 0) for run in range(3) for c in range(40) if (c * 7 + run) % 11] + [(0, 4, 1)]
    got = graph.cobinned(spark.createDataFrame(rows, "run int, contig long, bin int"))
    want = {}
    for r, c, b in rows:
        for s, d, e in rows:
            if r == s and b is not None and b == e and c < d:
                want[c, d] = want.get((c, d), 0) + 1
    runs = {c: len({r for r, d, _ in rows if d == c}) for _, c, _ in rows}
    assert sorted(map(tuple, got.collect())) == sorted((i, j, n, n / min(runs[i], runs[j]), min(runs[i], runs[j])) for (i, j), n in want.items())
    # Above the pairs there is nothing to shuffle or to add up.
    assert "Exchange" not in planned(got)[: planned(got).index("Generate")]


def test_sets_meet_their_asks_in_place(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "HELD", 7)
    sets = [(i, sorted({(i * j) % 23 for j in range(i % 9)} | {i % 4})) for i in range(50)]
    rows = spark.createDataFrame(sets, "id long, codes array<int>")
    want = sorted((a, b, len(set(x) & set(y)), len(x), len(y)) for a, x in sets if a % 10 == 0 for b, y in sets if a != b and set(x) & set(y))
    for block in (1 << 20, 5):
        got = overlaps.with_asks(rows, F.col("id") % 10 == 0, block)
        assert sorted(map(tuple, got.collect())) == want and "Exchange" not in planned(got)
    assert overlaps.with_asks(rows, F.col("id") < 0).count() == 0


def test_a_search_sends_no_square_of_cells(spark, monkeypatch):
    points = np.random.default_rng(3).normal(size=(500, 4))
    index = neighbour_index.build(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>"), 3, cells=300)
    sent, looks = [], neighbour_index._looks
    monkeypatch.setattr(neighbour_index, "_looks", lambda asks, choose, columns: sent.append(len(cloudpickle.dumps(choose))) or looks(asks, choose, columns))
    found = neighbour_index.neighbours(index, 3, 2, exact=True)
    assert max(sent) < 200_000  # 300 * 300 distances have 720,000 bytes
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert {(r["i"], r["rank"]): r["j"] for r in found.collect()} == {(i, k + 1): int(j) for i, row in enumerate(d.argsort(axis=1)) for k, j in enumerate(row[:3])}


def test_minhash_mixes_all_seeds_at_once(monkeypatch):
    codes = np.unique(np.random.default_rng(5).integers(0, 1 << 42, 2500))
    want = [min(int(kmers.mixed(np.array([c], np.uint64), 0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)[0]) for c in codes.tolist()) for i in (0, 1, 127)]
    calls, mixed = [], kmers.mixed
    monkeypatch.setattr(kmers, "mixed", lambda h, seed: calls.append(len(h)) or mixed(h, seed))
    got = np.array(kmers.minhash_of(codes), np.int64).view(np.uint64)
    assert [int(got[i]) for i in (0, 1, 127)] == want and len(calls) == 3
    assert kmers.minhash_of(codes[:0]) == [-1] * 128


def test_odds_of_dinucleotides_shuffle_nothing(spark):
    sf = "/root/testdata/sf0.001"
    rows = sequences.dinucleotide_odds(spark, sf)
    assert differences(rows, duck(sf), slate.ORACLES["dinucleotide_odds"]) == []
    assert "Exchange" not in planned(rows)


def test_no_pair_of_shared_keys_is_shuffled(spark):
    """A pair is weighed where it meets, once, however many keys it shares."""
    rows = sorted({(c, (c * k) % 17) for c in range(30) for k in range(1, 5)})
    carriers = {k: sorted(c for c, o in rows if o == k) for _, k in rows}
    want = {}
    for k, found in carriers.items():
        for i in found if 2 <= len(found) <= 8 else ():
            for j in (x for x in found if x > i):
                n, w = want.get((i, j), (0, 0.0))
                want[i, j] = (n + 1, w + float(np.log(31 / (len(found) + 1))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.idf_pairs(spark.createDataFrame(rows, "contig long, key long"), 8)
        assert "Exchange hashpartitioning" not in planned(got)[: planned(got).index("SortMergeJoin")]
        assert {(r["i"], r["j"]): (r["shared"], round(r["weight"], 9)) for r in got.collect()} == {p: (n, round(w, 9)) for p, (n, w) in want.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert max(n for n, _ in want.values()) > 1


def test_links_come_once_with_their_labels(spark):
    """No pair is shuffled to find repeated ones or to look up its ends' bins."""
    sf = "/root/testdata/sf0.001"
    links = repairs._graph(spark, sf)[2]
    sql = f"WITH {repairs.LINKS} SELECT u, v, a.label AS lu, b.label AS lv, w FROM s JOIN lab a ON a.node = u JOIN lab b ON b.node = v"
    assert differences(links, duck(sf), sql) == [] and links.count() > 100
    assert "Join" not in planned(repair._ends(links, None)).split("Generate")[0]


def test_prefixes_are_dealt_by_bin_once(spark):
    hits = spark.createDataFrame([(b, b * 10 + i % 4, (i * 3 + b) % 5) for b in range(3) for i in range(9)], "bin long, contig long, marker long")
    order = spark.createDataFrame([(b, b * 10 + c, 1 + (c + b) % 3) for b in range(4) for c in range(3)], "bin long, contig long, rank int")
    sets = spark.createDataFrame([(m, m % 2) for m in range(6)], "marker long, set_id long")
    got = repair.prefix_quality(hits, sets, order, tasks=3)
    assert planned(got).count("Exchange hashpartitioning(bin") == 1
    ranks = {(r["bin"], r["contig"]): r["rank"] for r in order.collect()}
    want = []
    for b in range(3):
        for k in range(1, 4):
            left = [h["marker"] for h in hits.collect() if h["bin"] == b and ranks.get((b, h["contig"]), 9) > k]
            share = lambda of: round(100 * sum(of) / 3 / 2, 6)
            want.append((b, k, share([1] * len(set(left))), share([1] * (len(left) - len(set(left))))))
    assert sorted((r["bin"], r["rank"], round(r["completeness"], 6), round(r["contamination"], 6)) for r in got.collect()) == want


def test_medians_order_a_part_of_a_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=41), "b": np.array([0.0, -0.0, 0.0, 5e-324, -1e300]), "c": np.array([np.inf, np.nan, np.nan, 1.0]), "d": np.array([-np.inf, 3.0]), "e": np.repeat([20.0, 20.01, 20.02], [3, 9, 2])}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None)], "g string, x double")
    got = evidence.upper_median(rows, ["g"], "x", "m")
    assert {r["g"]: str(r["m"] + 0.0) for r in got.collect()} == {g: str(np.sort(v)[len(v) // 2] + 0.0) for g, v in groups.items()}
    monkeypatch.setattr(evidence, "few", lambda df: df)  # nothing is written in between
    assert all("part" in w.split("windowspecdefinition")[-1] for w in planned(evidence.upper_median(rows, ["g"], "x", "m")).split("\n") if "x#" in w and "Window " in w)


def test_a_block_is_searched_by_minima_of_groups(monkeypatch):
    """No ask orders its distances to a whole block; copies, ties and the ask's own row included."""
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=(1500, 3)), 1)
    base[1200:] = base[:300]
    ids, asks = np.arange(1500), np.r_[np.arange(0, 1500, 7), 5000, 5001]
    v = np.concatenate([base, base[np.minimum(asks, 1499)]])
    table = pa.table({"id": np.r_[ids, asks], "v": pa.array(v.tolist()), "ask": np.r_[np.zeros(1500, bool), np.ones(len(asks), bool)]})
    widths, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **o: widths.append(x.shape[1]) or partition(x, *a, **o))
    for k, others in ((10, True), (40, False)):
        got = knn.closest(table, k, others)
        want = []
        for i, x in zip(asks.tolist(), base[np.minimum(asks, 1499)], strict=True):
            d = ((x - base) ** 2).sum(axis=1)
            order = [j for j in np.lexsort((ids, d)).tolist() if not others or j != i][:k]
            want += [(i, j, round(float(d[j]), 9)) for j in order]
        assert sorted((r["i"], r["j"], round(r["d"], 9)) for r in got.to_pylist()) == sorted(want)
    assert widths and max(widths) < 1500
    assert knn.closest(table.slice(0, 1500), 3).num_rows == 0


def test_endings_make_no_other_chunks():
    """Words with and without punctuation behind them are tokenized once, and ids are the library's on whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = ["Wort", "caña", "naïve", "x9", "don't", "it's", "3.5", "a,b", "Ωμ", "日本", "über-all", "'", "''s", "é"]
    tails = ["", ",", ".", "!!", "&&&", "$$$", "'", "'s", "''", "...\"", ")", "…", ",1", "́,", "_"]
    texts = [" ".join(w + t for w in words) for t in tails] + ["\n".join(w + t for t in tails) for w in words] + ["", "!", " ", "a!\n\nb?  c", "end."]
    encoder = tokens.Encoder(path, False)
    made, make = [], encoder.cache.make
    encoder.cache.make = lambda names: made.extend(names) or make(names)
    flat, ends = encoder.encode(pa.array(texts))
    library = Tokenizer.from_file(path)
    assert [p.tolist() for p in np.split(flat, ends[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert " caña" in made and not any(n.startswith(" caña") and n[5:] in (",", ".", "!!", "&&&", "$$$") for n in made)


def test_bins_are_dealt_once_to_look_for_planes(spark, monkeypatch):
    """Small bins many at once, middle ones one by one, crowded ones by blocks; batches end inside bins."""
    rng = np.random.default_rng(8)
    rows = [(b, 1000 * b + i, v.tolist()) for b, n in enumerate((7, 4, 9, 30, 5, 61, 12, 9)) for i, v in enumerate(np.round(rng.normal(size=(n, 3)), 1))]
    rows += [(None, 9000 + i, [0.0, 1.0, float(i)]) for i in range(9)]
    frame = spark.createDataFrame(rows, "bin int, contig long, v array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    found = []
    try:
        for whole, small in ((4096, 128), (4096, 3), (20, 8), (0, 0)):
            monkeypatch.setattr(tangents, "BIN_ROWS", whole)
            monkeypatch.setattr(tangents, "SMALL_BIN", small)
            out = tangents.off_plane(frame, 4)
            if whole == 4096:
                assert planned(out).count("Exchange") == 1 and "Join" not in planned(out)
            found.append({(r["bin"], r["contig"]): round(r["off"], 9) for r in out.collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(found[0]) == 133
    assert found[1:] == found[:1] * 3


def test_a_contig_stays_one_row_for_its_composition(spark, monkeypatch):
    sf, seen, deviating = "/root/testdata/sf0.01", [], cleanup.deviating
    monkeypatch.setattr(cleanup, "deviating", lambda rows, *a: seen.append(rows) or deviating(rows, *a))
    rows = cleanups.composition_outliers(spark, sf)
    assert differences(rows, duck(sf), slate.ORACLES["composition_outliers"]) == [] and rows.count() > 0
    # The distances, a row a contig, are read where they were written; no sequence is gone through again.
    assert "ArrowEvalPython" not in planned(rows) and seen[0].columns == ["bin", "contig", "distance"]


def test_many_blocks_become_fewer(spark, monkeypatch):
    """A row is sent once a block, so large tables have larger ones; the neighbours are the same."""
    for name, rows in (("BLOCK_ROWS", 10), ("LARGE_BLOCK_ROWS", 40), ("LEAST_BLOCKS", 3)):
        monkeypatch.setattr(knn, name, rows)
    x = np.random.default_rng(6).normal(size=(130, 3))
    found = knn.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 4)
    assert ", 4) as int) AS block" in planned(found)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert {(r["i"], r["rank"]): r["j"] for r in found.collect()} == {(i, k + 1): int(j) for i, row in enumerate(d.argsort(axis=1)) for k, j in enumerate(row[:4])}


def test_texts_are_read_once_for_odds(spark):
    """Medians and shares of outliers go over written distances, not over the texts again."""
    assert "ArrowEvalPython" not in planned(cleanups.karlin_outliers(spark, "/root/testdata/sf0.001"))


def test_quartiles_and_blocks_of_both_sides(spark):
    rows = [(g, (i * 37 + g) % 23 if i % 5 else None) for g in range(4) for i in range(g * 7 + 1, g * 17 + 6)]
    got = evidence.quartiles(spark.createDataFrame(rows, "g int, x int"), ["g"], "x")
    own = {g: sorted(x for h, x in rows if h == g and x is not None) for g in range(4)}
    assert sorted(map(tuple, got.collect())) == [(g, v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]) for g, v in own.items()]
    spans = spark.range(100).select("id", F.lit(0).alias("a"), F.lit(1000).alias("b"))
    found = evidence.overlapping(spans, "id", "a", "b", 0.8, block=10)
    assert found.count() == 4950 and "part#" in planned(found)  # a span meets ten blocks, not the blocks of all spans on one side
