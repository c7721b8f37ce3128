"""Queries on contigs that don't fit their bin, each beside its SQL; customers' classes stand for bins of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kmers
from ..operators import cleanup
from .sequences import odds_of_each
from .slate import DNA, dna, query, r6, read

ROWS = "v AS (SELECT o_custkey % 40 AS bin, o_orderkey AS contig, {x} AS x FROM orders)"


def _rows(spark, sf, x):
    return read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("bin"), F.col("o_orderkey").alias("contig"), x.alias("x"))


def _deviating(limit: float, least: int, most: float, expr: str, scale: str = "greatest(0.001, 1.4826 * mad)") -> str:
    """Contigs over the limit, of groups of v (bin, contig, x) that lose at most a share."""
    return f"""m AS (SELECT bin, list_sort(list(x))[1 + count(*) // 2] AS median, count(*) AS n FROM v GROUP BY 1), dv AS (SELECT v.*, median, n, round(abs(x - median), 9) AS dev FROM v JOIN m USING (bin)), k AS (SELECT bin, list_sort(list(dev))[1 + count(*) // 2] AS mad FROM dv GROUP BY 1),
z AS (SELECT dv.*, {expr} / {scale} AS z, 1.4826 * mad AS s FROM dv JOIN k USING (bin)), o AS (SELECT *, count(*) OVER (PARTITION BY bin) AS gone FROM z WHERE z > {limit} AND n >= {least}) SELECT bin, contig, round(x, 6) AS value, round(z, 5) AS z FROM o WHERE gone <= {most} * n"""


@query(f"WITH {ROWS.format(x='CASE WHEN o_orderkey % 23 = 0 THEN 3.0 ELSE 1.0 END + o_totalprice / 500000')}, {_deviating(3.0, 10, 0.2, 'abs(x - median)')}")
def cpg_outliers(spark, sf):
    rows = _rows(spark, sf, F.when(F.col("o_orderkey") % 23 == 0, 3.0).otherwise(1.0) + F.col("o_totalprice") / 500000)
    return cleanup.cpg_outliers(rows, ["bin"], "contig", "x").select("bin", "contig", r6(F.col("x")).alias("value"), F.round("z", 5).alias("z"))


XY = f"{DNA}, t AS (SELECT doc_id, s[i:i + 1] AS xy, count(*) AS n FROM (SELECT doc_id, s, unnest(generate_series(1, length(s) - 1)) AS i FROM d) GROUP BY ALL), r AS (SELECT doc_id % 8 AS bin, doc_id AS contig, xy, n::DOUBLE * sum(n) OVER (PARTITION BY doc_id) / (sum(n) OVER (PARTITION BY doc_id, xy[1]) * sum(n) OVER (PARTITION BY doc_id, xy[2])) AS rho FROM t)"


@query(f"""WITH {XY}, g AS (SELECT bin, count(DISTINCT contig) AS n FROM r GROUP BY 1), c AS (SELECT bin, xy, sum(rho) / any_value(n) AS mean FROM r JOIN g USING (bin) GROUP BY ALL), q AS (SELECT DISTINCT bin, contig FROM r),
v AS (SELECT q.bin, q.contig, round(sum(abs(coalesce(rho, 0) - mean)) / 16, 9) AS x FROM q JOIN c USING (bin) LEFT JOIN r ON r.bin = q.bin AND r.contig = q.contig AND r.xy = c.xy GROUP BY ALL), {_deviating(2.0, 20, 0.4, '(x - median)')}""")
def karlin_outliers(spark, sf):
    rows = odds_of_each(spark, sf).where(F.exists("rho", lambda x: x.isNotNull()))
    rho = rows.select((F.col("doc_id") % 8).alias("bin"), F.col("doc_id").alias("contig"), F.transform("rho", lambda x: F.coalesce(x, F.lit(0.0))).alias("rho"))
    return cleanup.karlin_outliers(rho, ["bin"], "contig", limit=2.0, least=20, most=0.4).select("bin", "contig", r6(F.col("distance")).alias("value"), F.round("z", 5).alias("z"))


TNF = f"{DNA}, t AS (SELECT doc_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM (SELECT doc_id, s[i:i + 3] AS k FROM (SELECT doc_id, s, unnest(generate_series(1, length(s) - 3)) AS i FROM d)) GROUP BY ALL), r AS (SELECT doc_id % 8 AS bin, doc_id AS contig, length(s) AS length, kmer, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS share FROM t JOIN d USING (doc_id))"


@query(f"""WITH {TNF}, l AS (SELECT bin, sum(length) AS total FROM (SELECT DISTINCT bin, contig, length FROM r) GROUP BY 1), c AS (SELECT bin, kmer, sum(share * length) / any_value(total) AS mean FROM r JOIN l USING (bin) GROUP BY ALL), q AS (SELECT DISTINCT bin, contig FROM r),
v AS (SELECT q.bin, q.contig, round(sqrt(sum(pow(coalesce(share, 0) - mean, 2))), 9) AS x FROM q JOIN c USING (bin) LEFT JOIN r ON r.bin = q.bin AND r.contig = q.contig AND r.kmer = c.kmer GROUP BY ALL), {_deviating(2.0, 10, 0.4, '(x - median)', '(1.4826 * mad)').replace('WHERE z > 2.0', 'WHERE s >= 0.001 AND z > 2.0')}""")
def composition_outliers(spark, sf):
    rows = dna(spark, sf).select("doc_id", F.length("s").alias("length"), kmers.of_counts(F.col("s"), 4).alias("n")).withColumn("total", F.aggregate("n", F.lit(0.0), lambda a, x: a + x)).where("total > 0")
    shares = rows.select((F.col("doc_id") % 8).alias("bin"), F.col("doc_id").alias("contig"), "length", F.transform("n", lambda x: x / F.col("total")).alias("shares"))
    return cleanup.composition_outliers(shares, ["bin"], "contig", keep=0.6).select("bin", "contig", F.round("distance", 6).alias("value"), F.round("z", 5).alias("z"))


@query(f"""WITH {ROWS.format(x='o_totalprice / CASE WHEN o_orderkey % 11 = 0 THEN 1000 ELSE 10000 END + 20')}, m AS (SELECT bin, list_sort(list(x))[1 + count(*) // 2] AS median, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM v GROUP BY 1), o AS (SELECT v.*, n, count(*) OVER (PARTITION BY bin) AS gone FROM v JOIN m USING (bin) WHERE mean >= 2 AND sd / mean >= 0.25 AND n >= 10 AND (x < median * 0.4 OR x > median * 1.6))
SELECT bin, contig, round(x, 6) AS value FROM o WHERE gone <= 0.2 * n""")
def depth_outliers(spark, sf):
    rows = _rows(spark, sf, F.col("o_totalprice") / F.when(F.col("o_orderkey") % 11 == 0, 1000).otherwise(10000) + 20)
    return cleanup.depth_outliers(rows, ["bin"], "contig", "x", deviation=0.6).select("bin", "contig", r6(F.col("x")).alias("value"))


@query(f"""WITH {ROWS.format(x='CASE WHEN o_orderkey % 17 = 0 THEN 0.01 ELSE 0.05 + o_totalprice / 2500000 END')}, m AS (SELECT bin, list_sort(list(x) FILTER (x > 0))[1 + count(*) FILTER (x > 0) // 2] AS median, count(*) AS n, count(*) FILTER (x > 0) AS seen FROM v GROUP BY 1), o AS (SELECT v.*, n, count(*) OVER (PARTITION BY bin) AS gone FROM v JOIN m USING (bin) WHERE seen >= 5 AND median >= 0.08 AND x >= 0 AND (x < 0.02 OR x < 0.25 * median))
SELECT bin, contig, round(x, 6) AS value FROM o WHERE gone <= 0.15 * n AND n >= 10 AND n - gone >= 10""")
def undamaged_contigs(spark, sf):
    rows = _rows(spark, sf, F.when(F.col("o_orderkey") % 17 == 0, 0.01).otherwise(0.05 + F.col("o_totalprice") / 2500000))
    return cleanup.undamaged_contigs(rows, ["bin"], "contig", "x").select("bin", "contig", r6(F.col("x")).alias("value"))


@query("""WITH p AS (SELECT l_orderkey AS a, l_linenumber AS b, l_discount AS d_a, l_tax AS d_b, l_quantity / 50 AS p_a, l_partkey % 100 / 100.0::DOUBLE AS p_b, 0.01::DOUBLE AS var_a, 0.02::DOUBLE AS var_b, l_partkey % 150 AS n_a, l_suppkey + 10 AS n_b FROM lineitem)
SELECT a, b, round(CASE WHEN (d_a <= 0.07 AND d_b <= 0.07) OR (d_a > 0.07 AND d_b > 0.07 AND abs(d_a - d_b) < 0.1) OR least(n_a, n_b) < 20 THEN 1 ELSE greatest(0.5, least(1, 1 - 0.5 * (n_a / (n_a + 60.0::DOUBLE)) * (n_b / (n_b + 60.0::DOUBLE)) * (1 - 0.5 * (exp(-abs(d_a - d_b) / 0.2) + exp(-0.5 * pow(abs(p_a - p_b) / sqrt(var_a + var_b + 0.001), 2)))))) END, 6) AS w FROM p""")
def damage_compatibility(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_discount").alias("d_a"), F.col("l_tax").alias("d_b"), (F.col("l_quantity") / 50).alias("p_a"), (F.col("l_partkey") % 100 / 100).alias("p_b"), F.lit(0.01).alias("var_a"), F.lit(0.02).alias("var_b"), (F.col("l_partkey") % 150).alias("n_a"), (F.col("l_suppkey") + 10).alias("n_b"))
    return lines.select("a", "b", r6(cleanup.damage_compatibility(lines)).alias("w"))


@query("""SELECT o_orderkey, round(-0.5 * (ln(2 * pi() * 4.0::DOUBLE) + pow(o_totalprice / 50000 - 3, 2) / 4), 6) AS log_density FROM orders""")
def normal_log_density(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", r6(cleanup.natural_normal(F.col("o_totalprice") / 50000, 3.0, 4.0)).alias("log_density"))


def _round(i: int) -> str:
    d = [f"w{j} / sqrt(2 * pi() * v{j}) * exp(-pow(x - m{j}, 2) / (2 * v{j}))" for j in (0, 1)]
    return f"""p{i + 1} AS (SELECT bin, any_value(n) AS n, sum(r0 * x) / sum(r0) AS m0, sum(r1 * x) / sum(r1) AS m1, greatest(1, sum(r0 * x * x) / sum(r0) - pow(sum(r0 * x) / sum(r0), 2)) AS v0, greatest(1, sum(r1 * x * x) / sum(r1) - pow(sum(r1 * x) / sum(r1), 2)) AS v1, sum(r0) / any_value(n) AS w0, sum(r1) / any_value(n) AS w1, sum(ln(t)) AS ll
FROM (SELECT *, d0 / t AS r0, d1 / t AS r1 FROM (SELECT bin, n, x, {d[0]} AS d0, {d[1]} AS d1, d0 + d1 AS t FROM v JOIN p{i} USING (bin))) GROUP BY 1)"""


MIX = "v AS (SELECT o_custkey % 5 AS bin, CASE WHEN o_orderkey % 3 = 0 THEN 60.0 ELSE 20.0 END + o_totalprice / 40000 AS x FROM orders), s AS (SELECT bin, list_sort(list(x)) AS l, count(*) AS n FROM v GROUP BY 1), p0 AS (SELECT bin, n, l[1 + n // 3] AS m0, l[1 + 2 * n // 3] AS m1, 100.0::DOUBLE AS v0, 100.0::DOUBLE AS v1, 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1 FROM s)"


def _mixed(spark, sf):
    return read(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("bin"), "o_orderkey", (F.when(F.col("o_orderkey") % 3 == 0, 60.0).otherwise(20.0) + F.col("o_totalprice") / 40000).alias("x"))


@query(f"WITH {MIX}, {', '.join(map(_round, range(4)))} SELECT bin, round(m0, 5) AS m0, round(m1, 5) AS m1, round(v0, 4) AS v0, round(v1, 4) AS v1, round(w0, 6) AS w0, round(ll, 4) AS ll FROM p4")
def depth_mixtures(spark, sf):
    from ..operators import mixtures

    rows = mixtures.fits(_mixed(spark, sf), ["bin"], "x", 2, 4, 0.0).where("k = 2")
    return rows.select("bin", F.round("m0", 5).alias("m0"), F.round("m1", 5).alias("m1"), F.round("v0", 4).alias("v0"), F.round("v1", 4).alias("v1"), r6(F.col("w0")).alias("w0"), F.round("ll", 4).alias("ll"))
