"""More queries of the slate: composition, outliers, read evidence, cuts, reassignment; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import evidence, graph, iterate, knn, signals
from .slate import DNA, ISL, KNN, LAB, SYM, _intervals, _labels, _positions, _symmetric, POS, dna, query, r6, read, reads, vectors


@query("""WITH b AS (SELECT l_suppkey AS contig, l_partkey // 100 AS win, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT contig, count(*) AS bins, avg(n) AS mean, var_samp(n) AS var FROM b GROUP BY 1)
SELECT contig, any_value(bins) AS bins, round(any_value(mean), 6) AS mean, round(any_value(var), 6) AS var, round(CASE WHEN any_value(var) > 0 THEN avg(pow(n - mean, 3)) / pow(any_value(var), 1.5) ELSE 0 END, 6) AS skew FROM b JOIN s USING (contig) GROUP BY contig""")
def depth_skew(spark, sf):
    b = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("contig"), F.floor(F.col("l_partkey") / 100).alias("win")).agg(F.count(F.lit(1)).alias("n"))
    return evidence.skewed_depth(b, ["contig"]).withColumns({c: r6(F.col(c)) for c in ("mean", "var", "skew")})


MED = "m AS (SELECT s, list_sort(list(x))[1 + count(*) // 2] AS median FROM v GROUP BY 1), d AS (SELECT v.*, median, abs(x - median) AS deviation FROM v JOIN m USING (s)), a AS (SELECT s, list_sort(list(deviation))[1 + count(*) // 2] AS mad FROM d GROUP BY 1)"


@query(f"WITH v AS (SELECT event_type AS s, event_id, value AS x FROM events WHERE value IS NOT NULL), {MED} SELECT s AS event_type, event_id, round(median, 6) AS median, round(mad, 6) AS mad FROM d JOIN a USING (s) WHERE mad > 0 AND deviation > 5 * mad")
def mad_outliers(spark, sf):
    rows = reads(spark, sf).where("value IS NOT NULL").select("event_type", "event_id", "value")
    return evidence.mad_outliers(rows, ["event_type"], "value", 5).select("event_type", "event_id", r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"))


@query("""WITH s AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders JOIN s ON o_orderpriority = p""")
def standardised(spark, sf):
    return evidence.standardised(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderkey", r6(F.col("z")).alias("z"))



@query(f"""WITH {DNA}, c AS (SELECT doc_id, length(s) AS n, length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'C', '')) AS c, length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'T', '')) AS t, (length(s) - length(replace(s, 'CG', ''))) / 2 AS cg FROM d)
SELECT doc_id, round(CASE WHEN g + c > 0 THEN (g - c)::DOUBLE / (g + c) END, 6) AS gc_skew, round(CASE WHEN a + t > 0 THEN (a - t)::DOUBLE / (a + t) END, 6) AS at_skew, round(CASE WHEN g * c > 0 THEN cg * n / (g * c)::DOUBLE END, 6) AS cpg FROM c""")
def composition(spark, sf):
    s = F.col("s")
    g, c, a, t = (sq.count_of(s, x) for x in "GCAT")
    cg = (F.length(s) - F.length(F.replace(s, F.lit("CG"), F.lit("")))) / 2
    return dna(spark, sf).select("doc_id", r6(F.when(g + c > 0, (g - c) / (g + c))).alias("gc_skew"), r6(F.when(a + t > 0, (a - t) / (a + t))).alias("at_skew"), r6(F.when(g * c > 0, cg * F.length(s) / (g * c))).alias("cpg"))


@query(f"""WITH {DNA}, p AS (SELECT doc_id, s, unnest(generate_series(500, length(s) - 500, 250)) AS pos FROM d), w AS (SELECT doc_id, pos, s[pos - 499:pos] AS b, s[pos + 1:pos + 500] AS a FROM p)
SELECT doc_id, pos, round(abs((500 - length(translate(a, 'GC', ''))) - (500 - length(translate(b, 'GC', ''))))::DOUBLE / 500, 6) AS shift FROM w""")
def gc_shift(spark, sf):
    s = F.col("s")
    at = F.when(F.length(s) >= 1000, F.sequence(F.lit(500), F.length(s) - 500, F.lit(250))).otherwise(F.array().cast("array<int>"))
    p = dna(spark, sf).select("doc_id", "s", F.explode(at).alias("pos"))
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), r6(F.abs(sq.count_of(s.substr(F.col("pos") + 1, F.lit(500)), "GC") - sq.count_of(s.substr(F.col("pos") - 499, F.lit(500)), "GC")) / 500).alias("shift"))






@query("""WITH c AS (SELECT user_id % 40 AS bin, event_type AS category, count(*) AS k FROM events GROUP BY ALL), g AS (SELECT category, sum(k) / (SELECT sum(k) FROM c) AS q FROM c GROUP BY 1), b AS (SELECT DISTINCT bin FROM c), n AS (SELECT bin, sum(k) AS n FROM c GROUP BY 1),
p AS (SELECT b.bin, g.category, coalesce(k, 0) / n AS p, q FROM b CROSS JOIN g JOIN n USING (bin) LEFT JOIN c ON c.bin = b.bin AND c.category = g.category)
SELECT bin, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + q * log2(q / ((p + q) / 2))) / 2, 6) AS jsd FROM p GROUP BY 1""")
def shannon_divergence(spark, sf):
    c = reads(spark, sf).groupBy((F.col("user_id") % 40).alias("bin"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("k"))
    return evidence.divergence(c, ["bin"]).withColumn("jsd", r6(F.col("jsd")))


@query("""WITH v AS (SELECT user_id % 40 AS bin, event_type = 'error' AS side, value AS x FROM events WHERE value IS NOT NULL), c AS (SELECT bin, x, count(*) FILTER (side) AS a, count(*) FILTER (NOT side) AS b FROM v GROUP BY ALL),
r AS (SELECT bin, sum(a) OVER w / sum(a) OVER (PARTITION BY bin) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY bin) AS fb FROM c WINDOW w AS (PARTITION BY bin ORDER BY x ROWS UNBOUNDED PRECEDING)) SELECT bin, round(max(abs(fa - fb)), 6) AS d FROM r GROUP BY 1""")
def kolmogorov_distance(spark, sf):
    rows = reads(spark, sf).select((F.col("user_id") % 40).alias("bin"), (F.col("event_type") == "error").alias("side"), "value")
    return evidence.kolmogorov(rows, ["bin"], "side", "value").withColumn("d", r6(F.col("d")))


GENO = ", ".join(f"sum(CASE WHEN l_returnflag = '{a}' THEN ln(1 - e) ELSE ln(e / 2) END) AS {a}" for a in "ANR")




CUTS = f"""{SYM}, {LAB}, x AS (SELECT u, v, w FROM s UNION ALL SELECT v, u, w FROM s), n AS (SELECT a.label AS lu, b.label AS lv, w FROM x JOIN lab a ON u = a.node JOIN lab b ON v = b.node), t AS (SELECT sum(w) AS total FROM n),
c AS (SELECT lu AS label, sum(w) AS volume, sum(CASE WHEN lu <> lv THEN w ELSE 0 END) AS cut FROM n GROUP BY 1)"""


@query(f"WITH {CUTS} SELECT label, round(cut, 6) AS cut, round(volume, 6) AS volume, round(cut / least(volume, total - volume), 6) AS conductance FROM c, t")
def label_conductance(spark, sf):
    return evidence.conductance(_symmetric(spark, sf), _labels(spark, sf)).select("label", *(r6(F.col(c)).alias(c) for c in ("cut", "volume", "conductance")))


#: Parts stand for markers; lines deal them to the vectors.
APART = f"""{KNN}, m AS (SELECT DISTINCT l_orderkey % (SELECT count(*) FROM embeddings) AS contig, l_partkey AS marker FROM lineitem), p AS (SELECT marker, a.contig AS i, b.contig AS j FROM m a JOIN m b USING (marker) WHERE a.contig < b.contig),
z AS (SELECT marker, count(*) AS pairs, count(*) FILTER (k.i IS NULL) AS apart FROM p LEFT JOIN k ON k.i = p.i AND k.j = p.j GROUP BY 1)"""


def _separated(spark, sf):
    e = vectors(spark, sf)
    size = e.agg(F.count(F.lit(1)).alias("size"))
    hits = read(spark, sf, "lineitem").join(F.broadcast(size)).select((F.col("l_orderkey") % F.col("size")).alias("contig"), F.col("l_partkey").alias("marker"))
    return graph.marker_separation(knn.knn(e, 10), hits)


@query(f"WITH {APART} SELECT marker, pairs, apart FROM z")
def separation(spark, sf):
    return _separated(spark, sf)


@query(f"WITH {APART} SELECT round(sum(apart) / sum(pairs)::DOUBLE, 9) AS score FROM z")
def separation_score(spark, sf):
    return graph.separation_score(_separated(spark, sf)).select(F.round("score", 9).alias("score"))


@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e), c AS (SELECT label AS "to", k, avg(x) AS m FROM x GROUP BY ALL),
d AS (SELECT id, x.label, "to", exp(-sum((x - m) * (x - m)) / 50) AS e FROM x JOIN c USING (k) GROUP BY ALL), q AS (SELECT id, label, "to", round(e / sum(e) OVER (PARTITION BY id), 6) AS share FROM d)
SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY share DESC, "to") AS INT) AS rank FROM q QUALIFY rank <= 2""")
def bin_confidence(spark, sf):
    p = vectors(spark, sf).select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return evidence.nearest_centroids(p, 1000, 2, 50.0)




@query(f"WITH {ISL}, p AS (SELECT l_suppkey AS contig, l_partkey + CAST(l_quantity AS BIGINT) AS pos FROM lineitem) SELECT DISTINCT p.contig, pos FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.contig = p.contig AND pos BETWEEN s AND e)")
def masked_positions(spark, sf):
    p = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("pos")).distinct()
    return p.join(signals.covered(p, _intervals(spark, sf), ["contig"]), ["contig", "pos"], "left_anti")


BRK = "b AS (SELECT user_id AS contig, CAST(floor(value * 10) AS BIGINT) AS pos FROM events WHERE event_type = 'error' AND value IS NOT NULL), l AS (SELECT user_id AS contig, CAST(1000 + user_id % 7 * 500 AS BIGINT) AS length FROM (SELECT DISTINCT user_id FROM events))"


def _breaks(spark, sf):
    e = reads(spark, sf)
    return e.select("user_id").distinct().select(F.col("user_id").alias("contig"), (1000 + F.col("user_id") % 7 * 500).alias("length")), e.where("event_type = 'error' AND value IS NOT NULL").select(F.col("user_id").alias("contig"), F.floor(F.col("value") * 10).alias("pos"))


@query(f"""WITH {BRK}, e AS (SELECT contig, CAST(0 AS BIGINT) AS spot FROM l UNION SELECT contig, length FROM l UNION SELECT contig, pos FROM b JOIN l USING (contig) WHERE pos > 0 AND pos < length), r AS (SELECT contig, spot, lead(spot) OVER (PARTITION BY contig ORDER BY spot) AS nx FROM e)
SELECT contig, spot AS start, nx AS "end" FROM r WHERE nx - spot >= 100""")
def clean_fragments(spark, sf):
    return evidence.fragments(*_breaks(spark, sf), 100)


@query(f"WITH {BRK}, c AS (SELECT contig, count(*) AS n, max(pos) AS top FROM b GROUP BY 1) SELECT contig, length, coalesce(n, 0) AS breaks, coalesce(top, -1) AS last, coalesce(n, 0) >= 3 AS chimeric FROM l LEFT JOIN c USING (contig)")
def contig_flags(spark, sf):
    lengths, breaks = _breaks(spark, sf)
    c = breaks.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("top"))
    n = F.coalesce("n", F.lit(0))
    return lengths.join(c, "contig", "left").select("contig", "length", n.alias("breaks"), F.coalesce("top", F.lit(-1)).alias("last"), (n >= 3).alias("chimeric"))


@query("""SELECT user_id % 10 AS run, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def evidence_stats(spark, sf):
    p = reads(spark, sf).groupBy((F.col("user_id") % 10).alias("run")).pivot("event_type", ["click", "view", "error"]).count()
    return p.select("run", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view", "error")))


@query("SELECT c_custkey, printf('contig_%06d', row_number() OVER (ORDER BY c_custkey)) AS name FROM customer")
def unique_names(spark, sf):
    """Names by rank: ranks within ranges of the key plus the ranges' bases, so that no task numbers all rows."""
    c = read(spark, sf, "customer").select("c_custkey").withColumn("part", F.floor(F.col("c_custkey") / 100_000))
    bases = c.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("c_custkey"))
    return c.join(bases, "part").select("c_custkey", F.format_string("contig_%06d", F.col("base") + rank).alias("name"))


@query("SELECT user_id, round(1 - exp(sum(ln(1 - least(0.99, value / 1000)))), 6) AS detected FROM events WHERE value IS NOT NULL GROUP BY 1")
def detection_rate(spark, sf):
    e = reads(spark, sf).where("value IS NOT NULL")
    return evidence.detection(e, ["user_id"], F.least(F.lit(0.99), F.col("value") / 1000)).withColumn("detected", r6(F.col("detected")))




@query("SELECT user_id, props, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events GROUP BY ALL")
def last_observation(spark, sf):
    return reads(spark, sf).groupBy("user_id", "props").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("seen"))


@query(f"""WITH o AS (SELECT l_partkey AS pos, l_returnflag, pow(10, -(5 + l_linenumber) / 10.0::DOUBLE) AS e FROM lineitem), s AS (SELECT pos, count(*) AS depth, {GENO} FROM o GROUP BY 1)
SELECT pos, depth, CASE WHEN greatest(A, N, R) = A THEN 'A' WHEN greatest(A, N, R) = N THEN 'N' ELSE 'R' END AS call, round(1 / (exp(A - greatest(A, N, R)) + exp(N - greatest(A, N, R)) + exp(R - greatest(A, N, R))), 4) AS posterior FROM s""")
def genotype_calls(spark, sf):
    o = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("pos"), "l_returnflag", F.pow(F.lit(10.0), -(5 + F.col("l_linenumber")) / 10.0).alias("e"))
    return evidence.genotypes(o, ["pos"], "l_returnflag", F.col("e"), ["A", "N", "R"]).select("pos", "depth", "call", F.round("posterior", 4).alias("posterior"))


SHIFT = ", ".join(f"sum(n) OVER (PARTITION BY bin ORDER BY position ROWS BETWEEN {a}) AS n{c}, sum(k) OVER (PARTITION BY bin ORDER BY position ROWS BETWEEN {a}) AS k{c}" for c, a in (("b", "5 PRECEDING AND 1 PRECEDING"), ("a", "1 FOLLOWING AND 5 FOLLOWING")))


@query(f"""WITH {POS}, w AS (SELECT bin, position, row_number() OVER (PARTITION BY bin ORDER BY position) AS i, count(*) OVER (PARTITION BY bin) AS c, {SHIFT} FROM o)
SELECT bin, position, round(kb::DOUBLE / nb, 6) AS before, round(ka::DOUBLE / na, 6) AS after FROM w WHERE c >= 7 AND i > 3 AND i <= c - 3 AND least(nb, na) >= 30 AND abs(ka::DOUBLE / na - kb::DOUBLE / nb) >= 0.03""")
def damage_shift(spark, sf):
    return signals.smoothed_shift(_positions(spark, sf), ["bin"], ["position"], "k", "n", 30, 0.03).select("bin", "position", r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"))


QUARTILES = """q AS (SELECT l_suppkey AS bin, quantile_disc(l_partkey, 0.25) AS a, quantile_disc(l_partkey, 0.75) AS b FROM lineitem GROUP BY 1)"""


@query(f"""WITH {QUARTILES} SELECT x.bin AS i, y.bin AS j, round((least(x.b, y.b) - greatest(x.a, y.a))::DOUBLE / (greatest(x.b, y.b) - least(x.a, y.a)), 6) AS overlap FROM q x JOIN q y ON x.bin < y.bin WHERE (least(x.b, y.b) - greatest(x.a, y.a))::DOUBLE / (greatest(x.b, y.b) - least(x.a, y.a)) >= 0.8""")
def coverage_overlap(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("bin"), F.col("l_partkey").alias("pos"))
    q = evidence.quartiles(lines, ["bin"], "pos").select("bin", F.col("lower").alias("a"), F.col("upper").alias("b"))
    return evidence.overlapping(iterate.cut(q), "bin", "a", "b", 0.8).withColumn("overlap", r6(F.col("overlap")))
