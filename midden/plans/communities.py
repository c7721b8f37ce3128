"""Queries on communities, splits, thresholds of graphs and the deconvolution of reads, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deconvolve, forest, iterate, potts, split
from .ancient import _curve, _given
from .repairs import MARKED, _graph, _hits, _of, _sets
from .slate import LAB, SYM, _labels, _symmetric, query, r6, read, vectors

DENSITY = "dense AS (SELECT 2.0::DOUBLE * (SELECT sum(w) FROM s) / ((SELECT count(*) FROM lab) * ((SELECT count(*) FROM lab) - 1.0::DOUBLE)) AS p)"


@query(f"""WITH {SYM}, {LAB}, {DENSITY}, n AS (SELECT label, count(*) AS n FROM lab GROUP BY 1)
SELECT round(2 * ((SELECT coalesce(sum(w), 0) FROM s JOIN lab a ON a.node = u JOIN lab b ON b.node = v WHERE a.label = b.label) - 0.7::DOUBLE * p * (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM n)), 5) AS quality FROM dense""")
def rber_quality(spark, sf):
    return potts.rber_quality(iterate.cut(_symmetric(spark, sf)), _labels(spark, sf), 0.7).select(F.round("quality", 5).alias("quality"))


@query(f"""WITH {SYM}, lab AS (SELECT vec_id AS node, min(vec_id) OVER (PARTITION BY label) AS label FROM embeddings), {DENSITY}, ends AS (SELECT u, v, w FROM s UNION ALL SELECT v, u, w FROM s), n AS (SELECT label, count(*) AS n FROM lab GROUP BY 1),
x AS (SELECT node, label, sum(w) AS x FROM (SELECT u AS node, label, w FROM ends JOIN lab ON lab.node = v UNION ALL SELECT node, label, 0.0 FROM lab UNION ALL SELECT node, node, 0.0 FROM lab) GROUP BY ALL)
SELECT x.node, x.label, round(x - p * (coalesce(n, 0) - CASE WHEN x.label = lab.label THEN 1 ELSE 0 END), 5) AS gain FROM x JOIN lab USING (node) LEFT JOIN n ON n.label = x.label, dense""")
def rber_move_gains(spark, sf):
    """What every node gains in its own community, alone, and in each around it, by the embeddings' labels."""
    edges, own = iterate.cut(_symmetric(spark, sf)), _labels(spark, sf)
    least = own.groupBy("label").agg(F.min("node").alias("least"))
    labels = own.join(least, "label").select(F.lit(0).alias("run"), "node", F.col("least").alias("label"))
    both = edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    n = own.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(edges.agg(F.sum("w").alias("m"))))  # one row each
    factor = n.select(F.lit(0).alias("run"), (2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1.0))).alias("factor"))
    gains = potts.move_gains(both, labels, labels.select("run", "node", F.lit(1.0).alias("size")), factor)
    return gains.select("node", "label", F.round("gain", 5).alias("gain"))


def rber_communities(spark, sf):
    """The embeddings' neighbour graph at two resolutions, in the company of one fixed vector a label; held against exhaustive search in the tests."""
    labels = _labels(spark, sf)
    fixed = labels.groupBy("label").agg(F.min("node").alias("node"))
    return potts.rber_communities(_symmetric(spark, sf), [0.5, 1.0], [1], start=fixed.select("node", "label"), fixed=fixed, levels=4, rounds=12, passes=1)


PARTS = "parts AS (SELECT o_custkey AS bin, o_orderkey AS contig, o_orderkey // 4 % 2 AS part FROM orders), lengths AS (SELECT o_orderkey AS contig, 1000 + o_orderkey * 37 % 9000 AS length FROM orders)"


@query(f"""WITH {MARKED}, {PARTS}, now AS ({_of('hits')}), each_ AS (SELECT bin, part, sum(length) AS bp FROM parts JOIN lengths USING (contig) GROUP BY ALL), whole AS (SELECT bin, sum(bp) AS total, count(*) AS parts FROM each_ GROUP BY 1),
inside AS (SELECT h.bin * 2 + part AS bin, marker FROM hits h JOIN parts USING (bin, contig)), q AS ({_of('inside')}), bad AS (SELECT * FROM whole JOIN now USING (bin) WHERE total >= 40000 AND round(contamination, 6) > 5.5),
e AS (SELECT each_.*, total, coalesce(q.completeness, 0) AS c, coalesce(q.contamination, 0) AS x FROM each_ JOIN bad USING (bin) LEFT JOIN q ON q.bin = each_.bin * 2 + each_.part),
s AS (SELECT bin, count(*) FILTER (bp >= 15000) AS viable, coalesce(sum(bp) FILTER (bp < 15000), 0) AS spill, coalesce(sum(bp / total::DOUBLE * c) FILTER (bp >= 15000), 0) AS kept, coalesce(sum(bp / total::DOUBLE * x) FILTER (bp >= 15000), 0) AS rest,
count(*) FILTER (bp >= 15000 AND round(c, 6) >= 90 AND round(x, 6) <= 5) AS top, coalesce(bool_or(bp >= 15000 AND round(x, 6) < 5), false) AS clean FROM e GROUP BY 1)
SELECT bin, parts, round(contamination, 6) AS contamination, round(rest, 6) AS "left", parts >= 2 AND parts <= least(12, 2 + total // 15000) AND viable >= 2 AND 4 * spill <= total AND
CASE WHEN round(contamination, 6) >= 15 THEN clean OR round(rest, 6) <= round(contamination - 10, 6) ELSE top > 0 OR (round(rest, 6) <= round(contamination - 1, 6) AND round(kept, 6) >= round(completeness - 2, 6)) END AS accept FROM bad JOIN s USING (bin)""")
def split_acceptance(spark, sf):
    parts = read(spark, sf, "orders").select(F.col("o_custkey").alias("bin"), F.col("o_orderkey").alias("contig"), F.expr("o_orderkey DIV 4 % 2").alias("part"))
    out = split.accepted(_hits(spark, sf), _sets(spark), _lengths(spark, sf), parts, viable=15_000, least=40_000)
    return out.withColumns({c: r6(F.col(c)) for c in ("contamination", "left")})


def _lengths(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("contig"), (1000 + F.col("o_orderkey") * 37 % 9000).alias("length"))


def split_bins(spark, sf):
    """Held against planted bins of one and two genomes in the tests."""
    hits, sets, edges, labels = _graph(spark, sf)
    return split.split(hits, sets, edges, labels, _lengths(spark, sf), viable=15_000, least=40_000, levels=3, rounds=8)


NEAR9 = "g AS (SELECT u, v, round(w, 9) AS w FROM s)"


def _rounded(spark, sf):
    return iterate.cut(_symmetric(spark, sf).withColumn("w", F.round("w", 9)))


@query(f"""WITH RECURSIVE {SYM}, {NEAR9}, kept AS (SELECT * FROM g WHERE (u * 31 + v * 17) % 3 = 0), c AS (SELECT u, v, w, row_number() OVER (ORDER BY w DESC, u, v) AS i FROM g WHERE (u * 31 + v * 17) % 3 <> 0),
d0 AS (SELECT list(coalesce(n, 0) ORDER BY vec_id) AS deg FROM embeddings LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT u AS node FROM kept UNION ALL SELECT v FROM kept) GROUP BY 1) ON node = vec_id),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS v, 0.0::DOUBLE AS w, false AS taken, deg FROM d0 UNION ALL SELECT c.i, c.u, c.v, c.w, deg[c.u + 1] < 6 OR deg[c.v + 1] < 6, CASE WHEN deg[c.u + 1] < 6 OR deg[c.v + 1] < 6 THEN [deg[j] + CASE WHEN j = c.u + 1 OR j = c.v + 1 THEN 1 ELSE 0 END for j in range(1, len(deg) + 1)] ELSE deg END FROM r JOIN c ON c.i = r.i + 1)
SELECT u, v, w FROM kept UNION ALL SELECT u, v, w FROM r WHERE taken""")
def degree_floor(spark, sf):
    """vec_id counts from 0 without gaps, which its SQL relies on."""
    edges = _rounded(spark, sf)
    return forest.degree_floor(edges.where("(u * 31 + v * 17) % 3 = 0"), edges, 6)


THRESHOLDS = (0.85, 0.88, 0.9, 0.92)


@query(f"""WITH RECURSIVE {SYM}, {NEAR9}, t AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]::DOUBLE[]) AS threshold), h AS (SELECT threshold, u, v FROM g, t WHERE w >= threshold UNION ALL SELECT threshold, v, u FROM g, t WHERE w >= threshold),
r AS (SELECT threshold, vec_id AS node, vec_id AS component FROM embeddings, t UNION SELECT h.threshold, h.v, r.component FROM r JOIN h ON h.threshold = r.threshold AND h.u = r.node AND r.component < h.v)
SELECT threshold, node, min(component) AS component FROM r GROUP BY ALL""")
def components_at_thresholds(spark, sf):
    return forest.components_at(_rounded(spark, sf), vectors(spark, sf).select(F.col("vec_id").alias("node")), list(THRESHOLDS))


#: Orders stand for reads, runs of 1,000 keys for contigs, parts for places.
READS = """o AS (SELECT l_orderkey // 1000 AS contig, l_orderkey AS read, l_partkey % 40 AS pos, CAST(20 + CAST(l_quantity AS BIGINT) % 20 AS INT) AS q, CAST((l_partkey * 3 + l_linenumber) % 25 + 1 AS INT) AS d5, CAST((l_partkey * 7 + l_orderkey) % 25 + 1 AS INT) AS d3, l_linenumber AS n FROM lineitem),
b AS (SELECT contig, read, pos, q, d5, d3, CASE WHEN (read + n) % 11 = 0 THEN substr('ACGT', CAST(1 + (pos + n) % 4 AS BIGINT), 1) WHEN pos % 4 = 1 AND read % 3 = 0 AND d5 <= 5 THEN 'T' WHEN pos % 4 = 2 AND read % 3 = 0 AND d3 <= 5 THEN 'A' ELSE substr('ACGT', CAST(1 + pos % 4 AS BIGINT), 1) END AS base FROM o)"""


def damaged_reads(spark, sf):
    at = lambda i: F.element_at(F.array(*map(F.lit, "ACGT")), (i % 4 + 1).cast("int"))
    rows = read(spark, sf, "lineitem").select(F.expr("l_orderkey DIV 1000").alias("contig"), F.col("l_orderkey").alias("read"), (F.col("l_partkey") % 40).alias("pos"), (20 + F.col("l_quantity").cast("long") % 20).cast("int").alias("q"), ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 25 + 1).cast("int").alias("d5"), ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 25 + 1).cast("int").alias("d3"), F.col("l_linenumber").alias("n"))
    r, n, pos = (F.col(c) for c in ("read", "n", "pos"))
    base = F.when((r + n) % 11 == 0, at(pos + n)).when((pos % 4 == 1) & (r % 3 == 0) & (F.col("d5") <= 5), "T").when((pos % 4 == 2) & (r % 3 == 0) & (F.col("d3") <= 5), "A").otherwise(at(pos))
    return rows.withColumn("base", base).drop("n")


ROUNDS = 6


def _rounds() -> str:
    """The loop as one query a round."""
    post = "CASE WHEN used > 0 THEN greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(llr + ln(prior / (1 - prior))))))) ELSE prior END"
    steps = ["t1 AS (SELECT contig, count(*) AS reads, 0.5::DOUBLE AS prior, 1 AS rounds, false AS done FROM m GROUP BY 1)"]
    for k in range(2, ROUNDS + 1):
        mean = f"round(greatest(0.1, least(0.9, sum((1 + 0.1 * in_zone) * ({post})) / greatest(1, sum(1 + 0.1 * in_zone)))), 12)"
        steps.append(f"n{k} AS (SELECT contig, any_value(t.reads) AS reads, any_value(prior) AS old, any_value(rounds) AS rounds, any_value(done) AS done, {mean} AS mean FROM m JOIN t{k - 1} t USING (contig) GROUP BY 1), t{k} AS (SELECT contig, reads, CASE WHEN done THEN old ELSE mean END AS prior, CASE WHEN done THEN rounds ELSE {k} END AS rounds, done OR abs(mean - old) < 0.01 AS done FROM n{k})")
    return ", ".join(steps)


LR = f"ln(greatest(1e-10, least(0.999, {_given('ref')}))) - ln(greatest(1e-10, least(0.999, CASE WHEN ref = base THEN 1 - e ELSE e / 3 END)))"
LOOP = f"""{READS}, c AS (SELECT contig, pos, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM b WHERE q >= 20 AND d5 > 5 AND d3 > 5 GROUP BY ALL),
f AS (SELECT contig, pos, CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS ref FROM c WHERE a + c + g + t >= 3 AND greatest(a, c, g, t) > (a + c + g + t) // 2),
x AS (SELECT b.*, ref, {_curve('d5')}::DOUBLE AS c5, {_curve('d3')}::DOUBLE AS c3, greatest(0.001, least(0.5, pow(10, -q / 10.0::DOUBLE))) AS e FROM b JOIN f USING (contig, pos)),
l AS (SELECT contig, read, sum({LR}) AS llr, count(*) FILTER (least(d5, d3) <= 5) AS in_zone, count(*) AS used FROM x WHERE q >= 20 GROUP BY ALL),
m AS (SELECT contig, read, coalesce(llr, 0) AS llr, coalesce(in_zone, 0) AS in_zone, coalesce(used, 0) AS used FROM (SELECT DISTINCT contig, read FROM b) LEFT JOIN l USING (contig, read)), {_rounds()}"""


@query(f"WITH {LOOP} SELECT contig, reads, round(prior, 6) AS prior, rounds FROM t{ROUNDS}")
def deconvolution_priors(spark, sf):
    return deconvolve.memberships(damaged_reads(spark, sf), rounds=ROUNDS)[1].withColumn("prior", r6(F.col("prior")))


@query(f"WITH {LOOP}, p AS (SELECT contig, CASE WHEN used > 0 THEN greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(llr + ln(prior / (1 - prior))))))) ELSE prior END AS p FROM m JOIN t{ROUNDS} USING (contig)), r AS (SELECT contig, round(p, 6) AS p FROM p) SELECT contig, count(*) AS reads, count(*) FILTER (p >= 0.8) AS ancient, count(*) FILTER (p <= 0.2) AS modern, count(*) FILTER (p > 0.2 AND p < 0.8) AS unclear, round(avg(p), 5) AS mean_p, round(avg(abs(p - 0.5)), 5) AS confidence FROM r GROUP BY 1")
def deconvolution_summary(spark, sf):
    rows = deconvolve.memberships(damaged_reads(spark, sf), rounds=ROUNDS)[0].withColumn("p", r6(F.col("p")))
    return deconvolve.summary(rows).withColumns({c: F.round(c, 5) for c in ("mean_p", "confidence")})


@query()
def deconvolution_consensus(spark, sf):
    """The two calls of each place; the loop and the calls have SQL of their own, both together are held against brute force in the tests."""
    out = deconvolve.consensus(damaged_reads(spark, sf), rounds=ROUNDS)
    return out.select("contig", "pos", r6(F.col("fraction")).alias("fraction"), "base", "ancient_base", "modern_base", "disagree")


