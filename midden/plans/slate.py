"""The domain's queries over the standard tables, each beside the SQL that it must match.

lineitem stands for marker hits (bin l_suppkey, contig l_orderkey, marker l_partkey), events
for reads of a contig user_id, embeddings for encoder output with `label` as a partition, and
documents for sequence-like strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import damage as fd
from ..operators import damage, graph, iterate, knn, neighbour_index, quality, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("bin"), F.col("l_orderkey").alias("contig"), F.col("l_partkey").alias("marker"), F.col("l_quantity").cast("long").alias("length"))


HITS = "hits AS (SELECT l_suppkey AS bin, l_orderkey AS contig, l_partkey AS marker, CAST(l_quantity AS BIGINT) AS length FROM lineitem)"


@query(f"""WITH {HITS}, c AS (SELECT bin, marker, count(*) AS copies FROM hits GROUP BY ALL)
SELECT bin, count(*) AS unique_markers, CAST(sum(copies) AS BIGINT) AS hits, count(*) FILTER (copies > 1) AS repeated_markers, CAST(sum(copies) - count(*) AS BIGINT) AS excess,
 round(100.0::DOUBLE * count(*) / 2000, 6) AS completeness, round(100.0::DOUBLE * (sum(copies) - count(*)) / 2000, 6) AS contamination FROM c GROUP BY bin""")
def bin_quality_flat(spark, sf):
    return quality.flat_quality(hits(spark, sf), 2000).withColumns({c: r6(F.col(c)) for c in ("completeness", "contamination")})


SETQ = f"""{HITS}, sets AS (SELECT p_brand AS set_id, p_partkey AS marker FROM part), sizes AS (SELECT set_id, count(*) AS size FROM sets GROUP BY 1),
c AS (SELECT bin, marker, count(*) AS copies FROM hits GROUP BY ALL),
b AS (SELECT bin, set_id, count(*) AS present, sum(copies - 1) AS extra FROM c JOIN sets USING (marker) GROUP BY ALL),
q AS (SELECT bin, 100.0::DOUBLE * sum(present::DOUBLE / size) / (SELECT count(*) FROM sizes) AS completeness, 100.0::DOUBLE * sum(extra::DOUBLE / size) / (SELECT count(*) FROM sizes) AS contamination FROM b JOIN sizes USING (set_id) GROUP BY bin)"""


def _sets(spark, sf):
    return read(spark, sf, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("marker"))


@query(f"WITH {SETQ} SELECT bin, round(completeness, 6) AS completeness, round(contamination, 6) AS contamination FROM q")
def set_quality(spark, sf):
    return quality.set_quality(hits(spark, sf), _sets(spark, sf)).withColumns({c: r6(F.col(c)) for c in ("completeness", "contamination")})


@query(f"WITH {SETQ} SELECT bin, CASE WHEN 3 * completeness >= 90 AND contamination < 5 THEN 'HQ' WHEN 3 * completeness >= 50 AND contamination < 10 THEN 'MQ' ELSE 'LQ' END AS tier FROM q")
def bin_tiers(spark, sf):
    q = quality.set_quality(hits(spark, sf), _sets(spark, sf))
    return q.select("bin", quality.tier(3 * F.col("completeness"), F.col("contamination")).alias("tier"))


@query(f"WITH {SETQ} SELECT {', '.join(f'count(*) FILTER (completeness >= {c} AND contamination <= {x}) AS n_{c}_{x}' for c in (90, 70, 50) for x in (5, 10))} FROM q")
def tier_vector(spark, sf):
    return quality.tier_vector(quality.set_quality(hits(spark, sf), _sets(spark, sf)))




@query(f"WITH {HITS}, m AS (SELECT bin, marker, count(DISTINCT contig) AS n, min(contig) AS contig FROM hits GROUP BY ALL) SELECT DISTINCT bin, contig FROM m WHERE n = 1")
def sole_carriers(spark, sf):
    return quality.sole_carriers(hits(spark, sf))


@query(f"WITH {HITS}, m AS (SELECT bin, marker, count(DISTINCT contig) AS n, arg_min(contig, (length, contig)) AS contig FROM hits GROUP BY ALL) SELECT bin, marker, contig FROM m WHERE n > 1")
def weakest_carriers(spark, sf):
    return quality.weakest_carriers(hits(spark, sf), "length")


@query(f"""WITH {HITS}, c AS (SELECT marker, count(DISTINCT contig) AS n, min(length) AS qlen FROM hits GROUP BY 1),
m AS (SELECT list_sort(list(n))[1 + count(*) // 2] AS middle FROM c) SELECT marker, n, qlen FROM c, m WHERE n = middle ORDER BY qlen, marker LIMIT 1""")
def seed_marker(spark, sf):
    return quality.seed_marker(hits(spark, sf).withColumnRenamed("length", "qlen"))


@query("""WITH l AS (SELECT l_suppkey AS bin, l_orderkey * 10 + l_linenumber AS contig, CAST(l_quantity AS BIGINT) AS length FROM lineitem),
r AS (SELECT *, sum(length) OVER (PARTITION BY bin ORDER BY length DESC, contig ROWS UNBOUNDED PRECEDING) AS cum, sum(length) OVER (PARTITION BY bin) AS total FROM l)
SELECT bin, max(length) FILTER (cum >= total // 2) AS n50, CAST(any_value(total) AS BIGINT) AS total FROM r GROUP BY bin""")
def n50_per_bin(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("bin"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("contig"), F.col("l_quantity").cast("long").alias("length"))
    return quality.n50(rows, ["bin"])


RUNS = """l AS (SELECT 0 AS run, c_custkey AS contig, hash_bin AS bin FROM (SELECT c_custkey, c_nationkey * 100 + c_custkey % 37 AS hash_bin FROM customer)
UNION ALL SELECT 1, c_custkey, c_nationkey * 100 + c_custkey % 41 FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 2, c_custkey, c_nationkey * 100 + c_custkey % 37 FROM customer WHERE c_acctbal > 0)"""


def _runs(spark, sf):
    c = read(spark, sf, "customer")
    one = lambda run, rows, k: rows.select(F.lit(run).alias("run"), F.col("c_custkey").alias("contig"), (F.col("c_nationkey") * 100 + F.col("c_custkey") % k).alias("bin"))
    return one(0, c, 37).unionAll(one(1, c.where("c_mktsegment <> 'BUILDING'"), 41)).unionAll(one(2, c.where("c_acctbal > 0"), 37))


COBIN = f"""{RUNS}, p AS (SELECT a.contig AS i, b.contig AS j, count(*) AS together FROM l a JOIN l b ON a.run = b.run AND a.bin = b.bin AND a.contig < b.contig GROUP BY ALL),
r AS (SELECT contig, count(DISTINCT run) AS runs FROM l GROUP BY 1),
q AS (SELECT i, j, together, together::DOUBLE / least(x.runs, y.runs) AS p, least(x.runs, y.runs) AS runs FROM p JOIN r x ON i = x.contig JOIN r y ON j = y.contig)"""


@query(f"WITH {COBIN} SELECT i, j, together, round(p, 6) AS p, runs FROM q")
def cobin_affinity(spark, sf):
    return graph.cobinned(_runs(spark, sf)).withColumn("p", r6(F.col("p")))


@query(f"WITH {COBIN} SELECT i, j, together, round(p, 6) AS p, runs FROM q WHERE 3 * together >= 2 * runs")
def consensus_edges(spark, sf):
    return graph.consensus_edges(graph.cobinned(_runs(spark, sf))).withColumn("p", r6(F.col("p")))


def vectors(spark, sf):
    return read(spark, sf, "embeddings")


KNN = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d QUALIFY rank <= 10)"""


@query(f"WITH {KNN} SELECT i, j, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM k")
def knn_topk(spark, sf):
    return knn.knn(vectors(spark, sf), 10).withColumn("d", r6(F.col("d")))


@query(f"WITH {KNN} SELECT i, j, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM k")
def indexed_neighbours(spark, sf):
    """The index's exact search, from as many cells as a recall of 0.9 takes."""
    index = neighbour_index.build(vectors(spark, sf), 10)
    return neighbour_index.neighbours(index, 10, neighbour_index.probes_for(index, 0.9), exact=True).withColumn("d", r6(F.col("d")))


POINTS = KNN.replace("FROM e a, e b WHERE", "FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a, e b WHERE").replace("rank <= 10", "rank <= 25")


@query(f"WITH {POINTS} SELECT i, j, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM k")
def point_neighbours(spark, sf):
    """Single points, every hundredth vector, against all rows."""
    index = neighbour_index.build(vectors(spark, sf), 25)
    return neighbour_index.neighbours(index, 25, 4, vectors(spark, sf).where("vec_id % 100 = 0"), exact=True).withColumn("d", r6(F.col("d")))


EDGES = f"{KNN}, c AS (SELECT list_sort(list(d))[1 + least(50 * count(*) // 100, count(*) - 1)] AS cutoff FROM k), g AS (SELECT i AS u, j AS v, d, exp(-d / 10) AS w FROM k, c WHERE d <= cutoff + 1e-12 AND i > j)"


@query(f"WITH {EDGES} SELECT u, v, round(w, 6) AS w FROM g")
def knn_kernel_edges(spark, sf):
    return graph.kernel_edges(knn.knn(vectors(spark, sf), 10), 50, 10.0).select("u", "v", r6(F.col("w")).alias("w"))


SYM = f"{KNN}, s AS (SELECT least(i, j) AS u, greatest(i, j) AS v, max(exp(-d / 10)) AS w FROM k GROUP BY ALL)"


def _symmetric(spark, sf):
    near = iterate.cut(knn.knn(vectors(spark, sf), 10))
    return graph.symmetric(near.select(F.col("i").alias("u"), F.col("j").alias("v"), F.exp(-F.col("d") / 10).alias("w")))


@query(f"WITH {SYM} SELECT u, v, round(w, 6) AS w FROM s")
def knn_symmetric(spark, sf):
    return _symmetric(spark, sf).withColumn("w", r6(F.col("w")))


LAB = "lab AS (SELECT vec_id AS node, label FROM embeddings)"


def _labels(spark, sf):
    return vectors(spark, sf).select(F.col("vec_id").alias("node"), "label")


@query(f"""WITH {SYM}, {LAB}, m AS (SELECT sum(w) AS m FROM s), ends AS (SELECT u AS node, w FROM s UNION ALL SELECT v, w FROM s),
deg AS (SELECT label, sum(w) AS degree FROM ends JOIN lab USING (node) GROUP BY 1),
ins AS (SELECT a.label, sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) AS inside FROM s JOIN lab a ON u = a.node JOIN lab b ON v = b.node GROUP BY 1)
SELECT round(sum(coalesce(inside, 0) / m - pow(degree / (2 * m), 2)), 6) AS modularity FROM deg LEFT JOIN ins USING (label), m""")
def label_modularity(spark, sf):
    return graph.modularity(iterate.cut(_symmetric(spark, sf)), _labels(spark, sf)).select(r6(F.col("modularity")).alias("modularity"))


@query(f"""WITH {SYM}, {LAB}, x AS (SELECT u, v, w FROM s UNION ALL SELECT v, u, w FROM s)
SELECT u AS node, round(sum(CASE WHEN a.label = b.label THEN w ELSE 0 END), 6) AS inside, round(sum(w), 6) AS total, round(sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) / sum(w), 6) AS share
FROM x JOIN lab a ON u = a.node JOIN lab b ON v = b.node GROUP BY u""")
def belonging_score(spark, sf):
    return graph.belonging(_symmetric(spark, sf), _labels(spark, sf)).select("node", *(r6(F.col(c)).alias(c) for c in ("inside", "total", "share")))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e),
c AS (SELECT label, k, avg(x) AS m FROM x GROUP BY ALL), d AS (SELECT vec_id, x.label, sqrt(sum((x - m) * (x - m))) AS d FROM x JOIN c USING (label, k) GROUP BY ALL)
SELECT vec_id, label, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY label ORDER BY round(d, 6), vec_id) AS INT) AS rank FROM d""")
def centroid_distance(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    centre = rows.groupBy("label", "k").agg(F.avg("x").alias("m"))
    d = rows.join(centre, ["label", "k"]).groupBy("vec_id", "label").agg(r6(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))))).alias("d"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("d", "vec_id")))


@query("""WITH p AS (SELECT DISTINCT a.o_orderkey AS u, b.o_orderkey AS v FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey),
h AS (SELECT DISTINCT l_orderkey AS contig, l_partkey AS marker FROM lineitem), s AS (SELECT u, v, count(*) AS shared FROM p JOIN h a ON u = a.contig JOIN h b ON v = b.contig AND a.marker = b.marker GROUP BY ALL)
SELECT u, v, coalesce(shared, 0) AS shared, round(CASE WHEN coalesce(shared, 0) > 0 THEN exp(-3.0::DOUBLE * shared) ELSE 1.3 END, 6) AS w FROM p LEFT JOIN s USING (u, v)""")
def shared_marker_penalty(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    pairs = o.alias("a").join(o.alias("b"), (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))).select(F.col("a.o_orderkey").alias("u"), F.col("b.o_orderkey").alias("v"))
    rows = graph.shared_markers(pairs, hits(spark, sf))
    return rows.withColumn("w", r6(graph.marker_weight(F.lit(1.0), F.col("shared"), F.lit(True))))


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS contig, l_partkey AS key FROM lineitem), df AS (SELECT key, count(*) AS df FROM h GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), n AS (SELECT count(DISTINCT contig) AS n FROM h)
SELECT a.contig AS i, b.contig AS j, count(*) AS shared, round(sum(ln((n + 1) / (df + 1))), 6) AS weight FROM h a JOIN df USING (key) JOIN h b ON a.key = b.key AND a.contig < b.contig, n GROUP BY ALL""")
def idf_connectivity(spark, sf):
    return graph.idf_pairs(hits(spark, sf).select("contig", F.col("marker").alias("key")), 40).withColumn("weight", r6(F.col("weight")))


@query("""SELECT s_suppkey, s_name, n_name, r_name, coalesce(lines, 0) AS lines, round(coalesce(total, 0), 2) AS total, CASE WHEN coalesce(lines, 0) >= 620 THEN 'HQ' WHEN coalesce(lines, 0) >= 580 THEN 'MQ' ELSE 'LQ' END AS tier
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_suppkey, count(*) AS lines, sum(l_quantity) AS total FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def summary_left_joins(spark, sf):
    agg = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("total"))
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    rows = read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(agg, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    lines = F.coalesce("lines", F.lit(0))
    return rows.select("s_suppkey", "s_name", "n_name", "r_name", lines.alias("lines"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), F.when(lines >= 620, "HQ").when(lines >= 580, "MQ").otherwise("LQ").alias("tier"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def modern_reads(spark, sf):
    bad = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return read(spark, sf, "orders").join(bad, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def unbinned(spark, sf):
    mine = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return read(spark, sf, "customer").join(mine, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


def reads(spark, sf):
    return read(spark, sf, "events")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, k, n, round((k + 0.5) / (n + 1), 6) AS rate, round(greatest(0, m - 1.96 * sd), 6) AS low, round(least(1, m + 1.96 * sd), 6) AS high
FROM (SELECT *, (k + 0.5::DOUBLE) / (n + 1) AS m, sqrt((k + 0.5::DOUBLE) * (n - k + 0.5::DOUBLE) / ((n + 1.0::DOUBLE) * (n + 1) * (n + 2))) AS sd FROM c)""")
def smoothed_rates(spark, sf):
    c = reads(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = fd.beta_interval(F.col("k"), F.col("n"))
    return c.select("user_id", "k", "n", r6(fd.smoothed_rate(F.col("k"), F.col("n"))).alias("rate"), r6(low).alias("low"), r6(high).alias("high"))


POST = "p AS (SELECT user_id, 1.0::DOUBLE + event_id % 5 AS w, 1 / (1 + exp(-greatest(-20, least(20, value / 50 - 1)))) AS p FROM events WHERE value IS NOT NULL)"


def _posterior(spark, sf):
    return reads(spark, sf).where("value IS NOT NULL").select("user_id", "event_id", (1.0 + F.col("event_id") % 5).alias("w"), fd.logistic(F.col("value") / 50 - 1).alias("p"))


@query(f"WITH {POST} SELECT user_id, count(*) AS n, round(sum(w * p) / sum(w), 6) AS p, round(sum(w * w * p * (1 - p)) / (sum(w) * sum(w)), 6) AS var, round(sum(w) * sum(w) / sum(w * w), 6) AS n_eff FROM p GROUP BY 1")
def kish_neff(spark, sf):
    return damage.kish(_posterior(spark, sf), ["user_id"], F.col("w"), F.col("p")).select("user_id", "n", *(r6(F.col(c)).alias(c) for c in ("p", "var", "n_eff")))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-20, least(20, value / 50 - 1)))), 6) AS p, round(pow(10, -(event_id % 40) / 10.0::DOUBLE), 6) AS error FROM events WHERE value IS NOT NULL")
def read_posterior(spark, sf):
    return _posterior(spark, sf).select("event_id", r6(F.col("p")).alias("p"), r6(fd.phred_error(F.col("event_id") % 40)).alias("error"))


POS = "o AS (SELECT user_id % 50 AS bin, event_id % 15 AS position, count(*) FILTER (event_type = 'error' OR event_id % (3 + event_id % 15) = 0) AS k, count(*) AS n FROM events GROUP BY ALL)"


def _positions(spark, sf):
    e = reads(spark, sf)
    hit = (F.col("event_type") == "error") | (F.col("event_id") % (3 + F.col("event_id") % 15) == 0)
    return e.groupBy((F.col("user_id") % 50).alias("bin"), (F.col("event_id") % 15).alias("position")).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {POS} SELECT bin, position, k, n, round((k + 0.5) / (n + 1), 6) AS rate FROM o")
def pooled_rates(spark, sf):
    return damage.pooled_rates(_positions(spark, sf), ["bin"]).withColumn("rate", r6(F.col("rate")))






@query("""WITH c AS (SELECT user_id % 40 AS bin, event_type AS category, count(*) AS k FROM events GROUP BY ALL), g AS (SELECT category, sum(k) AS c FROM c GROUP BY 1), o AS (SELECT bin, sum(k) AS n FROM c GROUP BY 1), t AS (SELECT sum(k) AS t FROM c)
SELECT bin, CAST(any_value(n) AS BIGINT) AS n, round(2 * sum(k * ln(k::DOUBLE * t / (n * g.c))), 6) AS g FROM c JOIN g USING (category) JOIN o USING (bin), t GROUP BY bin""")
def gtest_score(spark, sf):
    c = reads(spark, sf).groupBy((F.col("user_id") % 40).alias("bin"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("k"))
    return damage.g_test(c, ["bin"]).withColumn("g", r6(F.col("g")))


@query("SELECT l_suppkey AS bin, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var, round(var_samp(l_quantity), 6) AS var_samp FROM lineitem GROUP BY 1")
def depth_mean_var(spark, sf):
    q = F.col("l_quantity")
    return read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(q)).alias("mean"), r6(F.var_pop(q)).alias("var"), r6(F.var_samp(q)).alias("var_samp"))


@query("SELECT l_suppkey AS contig, CAST(l_partkey // 100 AS BIGINT) AS win, count(*) AS n, round(sum(l_quantity), 2) AS depth, round(avg(l_discount), 6) AS rate FROM lineitem GROUP BY ALL")
def window_coverage(spark, sf):
    rows = read(spark, sf, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("contig"), F.floor(F.col("l_partkey") / 100).alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("depth"), r6(F.avg("l_discount")).alias("rate"))


@query("""WITH b AS (SELECT l_suppkey AS contig, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem), v AS (SELECT contig, s AS f, 1 AS step FROM b UNION ALL SELECT contig, e, -1 FROM b), n AS (SELECT contig, f, sum(step) AS step FROM v GROUP BY ALL),
r AS (SELECT contig, f, sum(step) OVER (PARTITION BY contig ORDER BY f) AS depth, lead(f) OVER (PARTITION BY contig ORDER BY f) AS t FROM n) SELECT contig, f AS "from", t AS "to", CAST(depth AS BIGINT) AS depth FROM r WHERE t IS NOT NULL AND depth > 0""")
def depth_segments(spark, sf):
    b = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return signals.depth_segments(b, ["contig"])


ORD = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""WITH w AS (SELECT user_id, event_id, avg(value) OVER ({ORD} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(value) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM events)
SELECT user_id, event_id, round(b, 6) AS before, round(a, 6) AS after FROM w WHERE b IS NOT NULL AND least(a, b) > 0 AND greatest(a, b) / least(a, b) >= 2""")
def coverage_jump(spark, sf):
    """Every event, those near a user's first and last too."""
    return signals.jump(reads(spark, sf), ["user_id"], ["ts", "event_id"], "value", 5, every=True).select("user_id", "event_id", r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"))


@query(f"WITH w AS (SELECT user_id, event_id, value, (lag(value) OVER ({ORD}) + lead(value) OVER ({ORD})) / 2 AS m FROM events) SELECT user_id, event_id, round(m, 6) AS around FROM w WHERE m > 0 AND value >= 1.5 * m")
def lag_spike(spark, sf):
    return signals.spikes(reads(spark, sf), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", r6(F.col("around")).alias("around"))


@query(f"""WITH j AS (SELECT user_id, event_id, avg(value) OVER ({ORD} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(value) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a, value, (lag(value) OVER ({ORD}) + lead(value) OVER ({ORD})) / 2 AS m FROM events),
k AS (SELECT user_id, event_id, 'jump' AS kind FROM j WHERE b IS NOT NULL AND least(a, b) > 0 AND greatest(a, b) / least(a, b) >= 2 UNION ALL SELECT user_id, event_id, 'spike' FROM j WHERE m > 0 AND value >= 1.5 * m UNION ALL SELECT user_id, event_id, 'drop' FROM j WHERE m > 0 AND value <= 0.85 * m)
SELECT user_id, event_id, count(DISTINCT kind) AS families, array_to_string(list_sort(list(DISTINCT kind)), ',') AS evidence FROM k GROUP BY ALL HAVING count(DISTINCT kind) >= 2""")
def breakpoint_votes(spark, sf):
    e, g, o = reads(spark, sf), ["user_id"], ["ts", "event_id"]
    found = {"jump": signals.jump(e, g, o, "value", 5, every=True), "spike": signals.spikes(e, g, o, "value"), "drop": signals.drops(e, g, o, "value")}
    return signals.votes(found, ["user_id", "event_id"]).where("families >= 2")




@query("""WITH h AS (SELECT b.i AS bucket, count(o.at) AS n FROM (SELECT unnest(generate_series(0, 19)) AS i) b LEFT JOIN (SELECT CAST(floor(o_totalprice * 20 / 500000) AS INT) AS at FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 500000) o ON o.at = b.i GROUP BY 1),
s AS (SELECT bucket, n, avg(n) OVER (ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mean FROM h), x AS (SELECT *, lag(mean) OVER (ORDER BY bucket) AS l, lead(mean) OVER (ORDER BY bucket) AS r FROM s)
SELECT CAST(bucket AS INT) AS bucket, n, round(mean, 6) AS mean FROM x WHERE mean < l AND mean < r""")
def hist_valleys(spark, sf):
    h = signals.histogram(read(spark, sf, "orders"), F.col("o_totalprice"), 0, 500000, 20)
    return signals.valleys(h, 20).withColumn("mean", r6(F.col("mean")))


@query("""WITH h AS (SELECT b.i AS bucket, count(o.at) AS n FROM (SELECT unnest(generate_series(0, 49)) AS i) b LEFT JOIN (SELECT least(49, CAST(floor(o_totalprice / 10000) AS INT)) AS at FROM orders) o ON o.at = b.i GROUP BY 1),
s AS (SELECT bucket, n, avg(n) OVER (ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mean FROM h), x AS (SELECT *, lag(mean) OVER (ORDER BY bucket) AS l, lead(mean) OVER (ORDER BY bucket) AS r, max(mean) OVER () AS top FROM s)
SELECT CAST(bucket AS INT) AS bucket, n, round(mean, 6) AS mean FROM x WHERE mean > l AND mean > r AND mean > 0.05 * top""")
def hist_peaks(spark, sf):
    v = read(spark, sf, "orders")
    h = v.groupBy(F.least(F.lit(49), F.floor(F.col("o_totalprice") / 10000).cast("int")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return signals.peaks(h, 50).withColumn("mean", r6(F.col("mean")))


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, max(value) FILTER (i = c // 2) AS median FROM v GROUP BY 1""")
def fragment_stats(spark, sf):
    return damage.fragment_stats(reads(spark, sf), ["event_type"], "value").select("event_type", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"), "median")


ISL = """i AS (SELECT l_suppkey AS contig, l_partkey AS s, l_partkey + l_linenumber AS e FROM lineitem), x AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
y AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM x), m AS (SELECT contig, island, min(s) AS s, max(e) AS e FROM y GROUP BY ALL)"""


def _intervals(spark, sf):
    i = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).alias("end"))
    return signals.merged_intervals(i, ["contig"])


@query(f'WITH {ISL} SELECT contig, s AS start, e AS "end" FROM m')
def merged_intervals(spark, sf):
    return _intervals(spark, sf)


@query(f"WITH {ISL}, p AS (SELECT l_suppkey AS contig, l_partkey + CAST(l_quantity AS BIGINT) AS pos FROM lineitem) SELECT p.contig, pos FROM p WHERE EXISTS (SELECT 1 FROM m WHERE m.contig = p.contig AND pos BETWEEN s AND e)")
def covered_positions(spark, sf):
    p = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("pos"))
    return signals.covered(p, _intervals(spark, sf), ["contig"])


DNA = "d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)"


def dna(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))







@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, len(string_split(url, '/')) AS parts FROM pages""")
def name_strip(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"), F.size(F.split("url", "/")).cast("long").alias("parts"))


LEN = "b AS (SELECT user_id AS g, CASE WHEN value > 0 THEN -pow(value - 120, 2) / (2 * 40.0::DOUBLE * 40) - ln(40.0::DOUBLE) ELSE -100 END - CASE WHEN value > 0 THEN -pow(value - 40, 2) / (2 * 25.0::DOUBLE * 25) - ln(25.0::DOUBLE) ELSE -100 END AS diff FROM events WHERE value IS NOT NULL)"


@query(f"""WITH RECURSIVE {LEN}, r(g, it, share, old) AS (SELECT DISTINCT g, 0, 0.5::DOUBLE, NULL::DOUBLE FROM b UNION ALL SELECT g, it + 1, greatest(1e-6, least(1 - 1e-6, avg(1 / (1 + exp(greatest(-500, least(500, diff))) / (share / (1 - share)))))), any_value(share) FROM r JOIN b USING (g) WHERE it < 50 AND (it < 2 OR abs(share - old) >= 1e-4) GROUP BY g, it),
n AS (SELECT g, count(*) AS n FROM b GROUP BY 1) SELECT g AS user_id, round(arg_max(share, it), 6) AS share, any_value(n) AS n, CAST(max(it) AS INT) AS rounds FROM r JOIN n USING (g) GROUP BY g""")
def em_two_component(spark, sf):
    rows = reads(spark, sf).where("value IS NOT NULL").select("user_id", fd.length_log_likelihood(F.col("value"), 40.0, 25.0).alias("a"), fd.length_log_likelihood(F.col("value"), 120.0, 40.0).alias("b"))
    return iterate.two_components(rows, "user_id", "a", "b").withColumn("share", r6(F.col("share")))


BOTH = f"{SYM}, x AS (SELECT u, v, w FROM s UNION ALL SELECT v, u, w FROM s)"


@query(f"""WITH RECURSIVE {BOTH}, y AS (SELECT u, v, w FROM x UNION ALL SELECT u, u, max(w) FROM x GROUP BY u), r(it, node, label) AS (SELECT DISTINCT 0, u, u FROM x UNION ALL SELECT it + 1, node, arg_min(label, (-w, label)) FROM (SELECT it, y.u AS node, label, round(sum(w), 9) AS w FROM r JOIN y ON y.v = r.node WHERE it < 10 GROUP BY it, y.u, label) GROUP BY it, node)
SELECT node, label FROM r WHERE it = 10""")
def label_propagation(spark, sf):
    return iterate.label_propagation(_symmetric(spark, sf))


@query(f"""WITH RECURSIVE {BOTH}, o AS (SELECT u, sum(w) AS out FROM x GROUP BY 1), p AS (SELECT x.u, x.v, w / out AS p FROM x JOIN o USING (u)), h AS (SELECT vec_id AS node, CASE WHEN label = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM embeddings WHERE label = 0) ELSE 0 END AS home FROM embeddings),
r(it, node, rank) AS (SELECT 0, node, home FROM h UNION ALL SELECT it + 1, node, 0.3 * home + 0.7 * (got + (1 - sum(got) OVER (PARTITION BY it)) * home) FROM (SELECT it, p.v AS node, sum(p * rank) AS got FROM r JOIN p ON p.u = r.node WHERE it < 60 GROUP BY it, p.v) JOIN h USING (node))
SELECT node, round(rank, 4) AS rank FROM r WHERE it = 60""")
def personalised_pagerank(spark, sf):
    return _ranked(spark, sf).withColumn("rank", F.round("rank", 4))


def _ranked(spark, sf):
    return iterate.personalised_pagerank(_symmetric(spark, sf), vectors(spark, sf).where("label = 0").select(F.col("vec_id").alias("node")))


@query()
def consensus_communities(spark, sf):
    return iterate.communities(_symmetric(spark, sf), [0.5, 1.0, 2.0], [1, 2, 3])




