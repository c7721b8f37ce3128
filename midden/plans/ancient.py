"""Queries on reads and damage models, each beside its SQL, which restates the published formulas on its own.

Lines of orders stand for aligned bases: read l_orderkey, site l_partkey, contig l_suppkey.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import damage as fd
from ..operators import damage_model as dm
from ..operators import quality
from ..operators import reads as rd
from .slate import HITS, POST, _posterior, hits, query, r6, read

OBS = """o AS (SELECT l_orderkey AS read, l_suppkey AS contig, l_partkey AS pos, substr('ACGT', CAST(1 + l_partkey % 4 AS BIGINT), 1) AS ref,
CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN substr('ACGT', CAST(1 + (l_partkey + l_linenumber) % 4 AS BIGINT), 1) WHEN l_partkey % 4 = 1 AND l_orderkey % 3 = 0 THEN 'T' WHEN l_partkey % 4 = 2 AND l_orderkey % 4 = 0 THEN 'A' ELSE substr('ACGT', CAST(1 + l_partkey % 4 AS BIGINT), 1) END AS base,
CAST(10 + CAST(l_quantity AS BIGINT) % 30 AS INT) AS q, CAST(l_partkey % 25 + 1 AS INT) AS d5, CAST(l_partkey * 7 % 25 + 1 AS INT) AS d3 FROM lineitem)"""


def observed(spark, sf):
    at = lambda i: F.element_at(F.array(*map(F.lit, "ACGT")), (i % 4 + 1).cast("int"))
    o, p, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber"))
    base = F.when((o + n) % 5 == 0, at(p + n)).when((p % 4 == 1) & (o % 3 == 0), "T").when((p % 4 == 2) & (o % 4 == 0), "A").otherwise(at(p))
    q = (10 + F.col("l_quantity").cast("long") % 30).cast("int")
    return read(spark, sf, "lineitem").select(o.alias("read"), F.col("l_suppkey").alias("contig"), p.alias("pos"), at(p).alias("ref"), base.alias("base"), q.alias("q"), (p % 25 + 1).cast("int").alias("d5"), (p * 7 % 25 + 1).cast("int").alias("d3"))


def _curve(d: str) -> str:
    return f"greatest(0.001, least(0.999, 0.3 * exp(-0.5 * ({d} - 1)) + 0.01))"


RATED = f"{OBS}, x AS (SELECT *, {_curve('d5')}::DOUBLE AS c5, {_curve('d3')}::DOUBLE AS c3, greatest(0.001, least(0.5, pow(10, -q / 10.0::DOUBLE))) AS e FROM o)"


def _given(true: str) -> str:
    """P(base | true) in SQL."""
    return f"CASE {true} WHEN 'C' THEN CASE base WHEN 'C' THEN (1 - c5) * (1 - e) + c5 * e / 3 WHEN 'T' THEN c5 * (1 - e) + (1 - c5) * e / 3 ELSE e / 3 END WHEN 'G' THEN CASE base WHEN 'G' THEN (1 - c3) * (1 - e) + c3 * e / 3 WHEN 'A' THEN c3 * (1 - e) + (1 - c3) * e / 3 ELSE e / 3 END ELSE CASE WHEN base = {true} THEN 1 - e ELSE e / 3 END END"


def _classifier(use: str) -> str:
    damaged = "((ref = 'C' AND base = 'T' AND d5 <= 5) OR (ref = 'G' AND base = 'A' AND d3 <= 5))"
    odd = "((ref = 'C' AND base = 'T' AND d3 <= 5 AND d5 > 5) OR (ref = 'G' AND base = 'A' AND d5 <= 5 AND d3 > 5) OR NOT ((ref = 'C' AND base = 'T') OR (ref = 'G' AND base = 'A')))"
    lr = f"ln(greatest(1e-10, least(0.999, {_given('ref')}))) - ln(greatest(1e-10, least(0.999, CASE WHEN ref = base THEN 1 - e ELSE e / 3 END)))"
    return f"""WITH {RATED}, s AS (SELECT read, count(*) FILTER (q >= 20 AND ref <> base) AS mismatches, count(*) FILTER (q >= 20 AND ref <> base AND {damaged}) AS consistent, count(*) FILTER (q >= 20 AND ref <> base AND NOT {damaged} AND {odd}) AS inconsistent,
count(*) FILTER ({use} AND least(d5, d3) <= 5) AS in_zone, count(*) FILTER ({use}) AS used, coalesce(sum({lr}) FILTER ({use}), 0) AS llr FROM x GROUP BY 1)
SELECT read, mismatches, consistent, inconsistent, in_zone, round(llr, 6) AS llr, round(CASE WHEN used > 0 THEN greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-llr)))) ELSE 0.5 END, 6) AS p FROM s"""


@query(_classifier("q >= 20 AND ref <> base"))
def classify_reads(spark, sf):
    return rd.classify(observed(spark, sf), ["read"]).withColumns({c: r6(F.col(c)) for c in ("llr", "p")})


@query(_classifier("q >= 20"))
def classify_reads_full(spark, sf):
    return rd.classify(observed(spark, sf), ["read"], full=True).withColumns({c: r6(F.col(c)) for c in ("llr", "p")})


ZONES = "(ref = 'C' AND d5 <= 5) AS c, (ref = 'G' AND d3 <= 5) AS g"


def _likelihoods(key: str) -> str:
    return f"""l AS (SELECT {key}, coalesce(sum(ln(greatest(1e-15, {_given('ref')}))) FILTER (q >= 20), 0) AS dep, coalesce(sum(ln(greatest(1e-15, CASE WHEN ref = base THEN 1 - e ELSE e / 3 END))) FILTER (q >= 20), 0) AS cryo,
count(*) FILTER (q >= 20 AND (c OR g)) AS informative, 1 - exp(sum(CASE WHEN c THEN ln(greatest(1e-10, 1 - c5)) WHEN g THEN ln(greatest(1e-10, 1 - c3)) ELSE 0 END)) AS expected, CAST(max(CASE WHEN (c AND base = 'T') OR (g AND base = 'A') THEN 1 ELSE 0 END) AS INT) AS detected FROM (SELECT *, {ZONES} FROM x) GROUP BY ALL)"""


@query(f"WITH {RATED}, {_likelihoods('read')} SELECT read, round(dep, 6) AS dep, round(cryo, 6) AS cryo, informative, detected, round(expected, 6) AS expected FROM l")
def population_likelihoods(spark, sf):
    return rd.population_likelihoods(observed(spark, sf), ["read"]).withColumns({c: r6(F.col(c)) for c in ("dep", "cryo", "expected")})


DETECT = f"{RATED}, {_likelihoods('contig, read')}, t AS (SELECT contig, count(*) AS reads, avg(expected) AS expected, avg(detected) AS observed FROM l GROUP BY 1), u AS (SELECT *, CASE WHEN expected < 1e-6 THEN 0.5 ELSE greatest(0, least(1, 1 - observed / expected)) END AS undamaged FROM t)"


@query(f"WITH {DETECT} SELECT contig, reads, round(expected, 6) AS expected, round(observed, 6) AS observed, round(undamaged, 6) AS undamaged FROM u")
def detection_estimates(spark, sf):
    rows = rd.detection(rd.population_likelihoods(observed(spark, sf), ["contig", "read"]), ["contig"])
    return rows.withColumns({c: r6(F.col(c)) for c in ("expected", "observed", "undamaged")})


@query(f"""WITH {DETECT}, f AS (SELECT contig, greatest(0.05, least(0.95, undamaged)) AS share FROM u), m AS (SELECT contig, share, exp(cryo) AS a, exp(dep) AS b FROM l JOIN f USING (contig)),
i AS (SELECT contig, any_value(share) AS share, sum(pow((a - b) / (share * a + (1 - share) * b), 2)) FILTER (share * a + (1 - share) * b > 1e-30) AS fisher FROM m GROUP BY 1)
SELECT contig, round(share, 6) AS share, round(1 / sqrt(fisher), 6) AS se, round(greatest(0, share - 1.96 / sqrt(fisher)), 6) AS low, round(least(1, share + 1.96 / sqrt(fisher)), 6) AS high FROM i""")
def share_intervals(spark, sf):
    like = rd.population_likelihoods(observed(spark, sf), ["contig", "read"])
    shares = rd.detection(like, ["contig"]).select("contig", fd.clamped(F.col("undamaged"), 0.05, 0.95).alias("share"))
    return rd.share_interval(like, shares, ["contig"]).withColumns({c: r6(F.col(c)) for c in ("share", "se", "low", "high")})


def _ratio(true: str, turned: str, d: str) -> str:
    return f"sum(CASE WHEN base = '{turned}' THEN ln(greatest(0.001, {d} * (1 - f) + (1 - {d}) * f / 3)) - ln(1 - f) WHEN base = '{true}' THEN ln(greatest(0.001, (1 - {d}) * (1 - f) + {d} * f / 3)) - ln(f / 3) ELSE 0 END)"


@query(f"WITH {RATED}, y AS (SELECT *, greatest(0.001, least(0.999, pow(10, -q / 10.0::DOUBLE))) AS f FROM x) SELECT pos, round({_ratio('C', 'T', 'c5')}, 6) AS ct, round({_ratio('G', 'A', 'c3')}, 6) AS ga FROM y GROUP BY pos")
def site_log_ratios(spark, sf):
    return rd.site_ratios(observed(spark, sf), ["pos"]).select("pos", r6(F.col("ct")).alias("ct"), r6(F.col("ga")).alias("ga"))


PLAIN = {g: f"ln(greatest(1e-10, CASE WHEN base = '{g}' THEN 1 - e ELSE e / 3 END))" for g in "ACGT"}
FULL = {g: f"""ln(greatest(1e-10, {_given(f"'{g}'")}))""" for g in "ACGT"}


def _ranked(prefix: str, source: str) -> str:
    """Posteriors of four log sums as rows, and the two best."""
    rows = " UNION ALL ".join(f"SELECT pos, {i} AS i, '{g}' AS g, {prefix}_{g} AS s FROM {source}" for i, g in enumerate("ACGT"))
    return f"(SELECT pos, max(p) AS p, arg_max(g, (p, -i)) AS base, list_sort(list(p), 'DESC')[2] AS second FROM (SELECT pos, i, g, exp(s - m) / sum(exp(s - m)) OVER w AS p FROM (SELECT *, max(s) OVER (PARTITION BY pos) AS m FROM ({rows})) WINDOW w AS (PARTITION BY pos)) GROUP BY pos)"


@query(f"""WITH {RATED}, z AS (SELECT *, d5 > 5 AND d3 > 5 AS inner_ FROM x), s AS (SELECT pos, count(*) AS reads, count(*) FILTER (inner_) AS interior, {', '.join(f'coalesce(sum({PLAIN[g]}) FILTER (inner_), 0) AS i_{g}, sum(CASE WHEN inner_ THEN {PLAIN[g]} ELSE {FULL[g]} END) AS a_{g}' for g in 'ACGT')} FROM z GROUP BY pos),
i AS {_ranked('i', 's')}, a AS {_ranked('a', 's')}
SELECT s.pos, reads, interior, CASE WHEN interior >= 2 AND i.p >= 0.95 THEN i.base ELSE a.base END AS base, round(CASE WHEN interior >= 2 AND i.p >= 0.95 THEN i.p ELSE a.p END, 5) AS p, round(CASE WHEN interior >= 2 AND i.p >= 0.95 THEN i.second ELSE a.second END, 5) AS second, CAST(CASE WHEN interior >= 2 AND i.p >= 0.95 THEN 1 ELSE 2 END AS INT) AS stage FROM s JOIN i USING (pos) JOIN a USING (pos)""")
def genotype_two_stage(spark, sf):
    return rd.genotype_two_stage(observed(spark, sf), ["pos"]).withColumns({c: F.round(c, 5) for c in ("p", "second")})


@query(f"""WITH {RATED}, y AS (SELECT *, (read % 10 + 0.5::DOUBLE) / 10 AS w FROM x), s AS (SELECT pos, sum(w) AS w, sum(1 - w) AS v, {', '.join(f'sum(w * {FULL[g]}) AS o_{g}, sum((1 - w) * {PLAIN[g]}) AS n_{g}, sum(w * {FULL[g]} + (1 - w) * {PLAIN[g]}) AS b_{g}' for g in 'ACGT')} FROM y GROUP BY pos),
old AS {_ranked('o', 's')}, new AS {_ranked('n', 's')}, b AS {_ranked('b', 's')}
SELECT s.pos, round(w / (w + v), 6) AS fraction, b.base, round(b.p, 5) AS p, round(b.second, 5) AS second, CASE WHEN w >= 1 THEN old.base END AS ancient_base, CASE WHEN v >= 1 THEN new.base END AS modern_base, w >= 1 AND v >= 1 AND old.base <> new.base AS disagree FROM s JOIN old USING (pos) JOIN new USING (pos) JOIN b USING (pos)""")
def genotype_two_population(spark, sf):
    rows = rd.genotype_two_population(observed(spark, sf).withColumn("p_ancient", (F.col("read") % 10 + 0.5) / 10), ["pos"])
    return rows.drop("disagreement").withColumns({"fraction": r6(F.col("fraction")), "p": F.round("p", 5), "second": F.round("second", 5)})


@query(f"""WITH {OBS} SELECT contig, 5 AS "end", d5 - 1 AS position, count(*) FILTER (base = 'T') AS k, count(*) AS n FROM o WHERE ref = 'C' AND d5 <= 15 GROUP BY ALL UNION ALL SELECT contig, 3, d3 - 1, count(*) FILTER (base = 'A'), count(*) FROM o WHERE ref = 'G' AND d3 <= 15 GROUP BY ALL""")
def terminal_counts(spark, sf):
    return rd.terminal_counts(observed(spark, sf), ["contig"])


def _of(a: str, b: str) -> str:
    return f"(ref = '{a}' AND base = '{b}')"


@query(f"""WITH {OBS}, s AS (SELECT contig, count(*) FILTER (d5 <= 5) AS n5, count(*) FILTER (d3 <= 5) AS n3, count(*) FILTER (d5 <= 5 AND {_of('T', 'C')}) AS tc5, count(*) FILTER (d5 <= 5 AND {_of('A', 'G')}) AS ag5, count(*) FILTER (d5 <= 5 AND ref <> base AND NOT ({_of('T', 'C')} OR {_of('A', 'G')} OR {_of('C', 'T')})) AS other5,
count(*) FILTER (d3 <= 5 AND {_of('C', 'T')}) AS ct3, count(*) FILTER (d3 <= 5 AND {_of('T', 'C')}) AS tc3, count(*) FILTER (d3 <= 5 AND ref <> base AND NOT ({_of('C', 'T')} OR {_of('T', 'C')} OR {_of('G', 'A')})) AS other3 FROM o GROUP BY 1)
SELECT contig, {', '.join(f'CASE WHEN n{c[-1]} > 10 THEN round({c}::DOUBLE / n{c[-1]}, 6) END AS {c}' for c in ('tc5', 'ag5', 'other5', 'ct3', 'tc3', 'other3'))} FROM s""")
def mismatch_spectrum(spark, sf):
    rows = rd.mismatch_spectrum(observed(spark, sf), ["contig"])
    return rows.withColumns({c: r6(F.col(c)) for c in rows.columns[1:]})


@query(f"""WITH {OBS}, x AS (SELECT ref, base, greatest(0.001, least(0.5, pow(10, -q / 10.0::DOUBLE))) AS e, {_curve('d5')}::DOUBLE AS c5, {_curve('d3')}::DOUBLE AS c3 FROM o), t AS (SELECT unnest(['A', 'C', 'G', 'T']) AS was), b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base)
SELECT was, b.base AS became, round(avg({_given('was').replace('base', 'b.base')}), 6) AS p FROM x, t, b GROUP BY ALL""")
def transition_matrix(spark, sf):
    """Mean P(observed | true) over all observations' distances and qualities: sixteen sums in one pass."""
    d5, d3, error = rd._rates(rd.CURVE, rd.CURVE)
    means = observed(spark, sf).agg(*(F.avg(fd.observed_given(F.lit(a), F.lit(b), d5, d3, error)).alias(a + b) for a in "ACGT" for b in "ACGT"))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("was"), F.lit(b).alias("became"), r6(F.col(a + b)).alias("p")) for a in "ACGT" for b in "ACGT")))
    return means.select(cells.alias("x")).select("x.*")


COUNTS = """c AS (SELECT l_suppkey % 8 AS bin, CASE WHEN l_linenumber % 2 = 1 THEN 5 ELSE 3 END AS e, l_partkey % 20 AS position, count(*) FILTER (l_orderkey % (4 + 2 * (l_partkey % 20)) = 0) AS k, count(*) AS n FROM lineitem GROUP BY ALL)"""


def _counts(spark, sf, *more):
    p = F.col("l_partkey") % 20
    return read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("bin"), *more, F.when(F.col("l_linenumber") % 2 == 1, 5).otherwise(3).alias("end"), p.alias("position")).agg(F.count_if(F.col("l_orderkey") % (4 + 2 * (F.col("l_partkey") % 20)) == 0).alias("k"), F.count(F.lit(1)).alias("n"))


MODEL = f"""{COUNTS}, b AS (SELECT bin, e, CASE WHEN sum(n) FILTER (position >= 15) >= 10 THEN sum(k) FILTER (position >= 15) / sum(n) FILTER (position >= 15)::DOUBLE ELSE 0.01 END AS base, max(k::DOUBLE / n) FILTER (position = 0 AND n >= 10) AS first, sum(n) FILTER (position < 15) AS total FROM c GROUP BY ALL),
h AS (SELECT bin, e, base, CASE WHEN first IS NULL THEN 0 ELSE greatest(0.001, first - base) END AS first FROM b WHERE total >= 100), g AS (SELECT bin, e, base, decay, first * multiple AS amplitude FROM h, (SELECT unnest({dm.DECAYS}::DOUBLE[]) AS decay), (SELECT unnest({dm.MULTIPLES}::DOUBLE[]) AS multiple) WHERE first * multiple >= 0.001 AND first * multiple <= 0.5),
l AS (SELECT g.*, k, n, 100 * greatest(1e-10, least(1 - 1e-10, amplitude * exp(-decay * position) + base)) AS a FROM g JOIN c USING (bin, e) WHERE position < 15),
s AS (SELECT bin, e, decay, amplitude, sum(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + greatest(a, 0.01)) + lgamma(n - k + greatest(100 - a, 0.01)) - lgamma(n + greatest(a, 0.01) + greatest(100 - a, 0.01)) - lgamma(greatest(a, 0.01)) - lgamma(greatest(100 - a, 0.01)) + lgamma(greatest(a, 0.01) + greatest(100 - a, 0.01))) AS ll FROM l GROUP BY ALL),
f AS (SELECT bin, e, arg_max(decay, ll) AS decay, arg_max(amplitude, ll) AS amplitude FROM s GROUP BY ALL),
w AS (SELECT bin, coalesce(max(decay) FILTER (e = 5), 0.35) AS decay5, coalesce(max(amplitude) FILTER (e = 5), 0) AS amplitude5, coalesce(max(decay) FILTER (e = 3), 0.35) AS decay3, coalesce(max(amplitude) FILTER (e = 3), 0) AS amplitude3 FROM (SELECT DISTINCT bin FROM c) LEFT JOIN f USING (bin) GROUP BY 1),
q AS (SELECT bin, position, sum(k)::DOUBLE AS k, sum(n)::DOUBLE AS n FROM c GROUP BY ALL), i AS (SELECT bin, CASE WHEN sum(n) FILTER (position >= 14) > 100 THEN sum(k) FILTER (position >= 14) / sum(n) FILTER (position >= 14) ELSE 0.01 END AS base, sum(n) FILTER (position < 10) AS seen FROM q GROUP BY 1),
r AS (SELECT bin, k, n, seen, greatest(0.001, least(0.999, base)) AS flat, greatest(0.001, least(0.999, (amplitude5 + amplitude3) / 2 * exp(-(decay5 + decay3) / 2 * position) + base)) AS curve FROM q JOIN i USING (bin) JOIN w USING (bin) WHERE position < 10 AND n >= 10),
t AS (SELECT bin, 2 * sum(CASE WHEN k > 0 THEN k * (ln(k / (n * flat)) - ln(k / (n * curve))) ELSE 0 END + CASE WHEN n > k THEN (n - k) * (ln((n - k) / (n * (1 - flat))) - ln((n - k) / (n * (1 - curve)))) ELSE 0 END) / sqrt(any_value(seen)) AS score FROM r GROUP BY 1),
m AS (SELECT bin, decay5, decay3, amplitude5, amplitude3, score, 1 / (1 + exp(-score / 2)) AS p FROM t JOIN w USING (bin))"""


@query(f"""WITH {MODEL} SELECT bin, round(decay5, 6) AS decay5, round(decay3, 6) AS decay3, round(amplitude5, 6) AS amplitude5, round(amplitude3, 6) AS amplitude3, round(score, 5) AS score, round(p, 6) AS p, CAST(CASE WHEN score < -1 THEN 0 WHEN score < 0.5 THEN 1 WHEN score < 1.5 THEN 2 WHEN score < 2.5 THEN 3 ELSE 4 END AS INT) AS evidence,
CASE WHEN p < 0.5 THEN 'modern' WHEN p >= 0.8 AND (amplitude5 + amplitude3) / 2 >= 0.01 AND ((amplitude5 + amplitude3) / 2 < 0.05 OR (decay5 + decay3) / 2 > 0.3) THEN 'ancient' ELSE 'uncertain' END AS class FROM m""")
def damage_models(spark, sf):
    names = ("decay5", "decay3", "amplitude5", "amplitude3")
    return dm.models(_counts(spark, sf), ["bin"]).select("bin", *(r6(F.col(c)).alias(c) for c in names), F.round("score", 5).alias("score"), r6(F.col("p")).alias("p"), "evidence", "class")


@query(f"""WITH {MODEL}, {POST}, a AS (SELECT user_id % 8 AS bin, sum(p) / count(*) AS p_ancient FROM p GROUP BY 1), d AS (SELECT bin, sum(k) FILTER (e = 5) / sum(n) FILTER (e = 5)::DOUBLE AS ct1, sum(k) FILTER (e = 3) / sum(n) FILTER (e = 3)::DOUBLE AS ga1 FROM c WHERE position = 0 GROUP BY 1)
SELECT bin, round(coalesce(p_ancient, 0.5), 6) AS p_ancient, round(decay5, 6) AS decay5, round(decay3, 6) AS decay3, round(amplitude5, 6) AS amplitude5, round(amplitude3, 6) AS amplitude3, round(coalesce(ct1, 0), 6) AS ct1, round(coalesce(ga1, 0), 6) AS ga1, CASE WHEN coalesce(p_ancient, 0.5) > 0.5 AND coalesce(ct1, 0) > 0.02 THEN 'ancient' WHEN coalesce(p_ancient, 0.5) < 0.2 THEN 'modern' ELSE 'mixed' END AS damage_class FROM m LEFT JOIN a USING (bin) LEFT JOIN d USING (bin)""")
def bin_damage(spark, sf):
    contigs = _posterior(spark, sf).groupBy("user_id").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n")).withColumn("bin", F.col("user_id") % 8)
    rows = dm.bin_report(_counts(spark, sf), contigs)
    return rows.withColumns({c: r6(F.col(c)) for c in rows.columns if c not in ("bin", "damage_class")})


@query(f"""WITH {COUNTS}, f AS (SELECT bin, position, k::DOUBLE / n AS rate, n FROM c WHERE e = 5), b AS (SELECT bin, avg(rate) AS base FROM f WHERE position >= 15 AND n > 100 GROUP BY 1), x AS (SELECT f.*, rate - coalesce(base, 0) AS excess FROM f LEFT JOIN b USING (bin)),
s AS (SELECT bin, coalesce(max(excess) FILTER (position = 0), 0) AS pos1, coalesce(max(excess) FILTER (position = 2), 0) AS pos3, coalesce(avg(greatest(0, excess)) FILTER (position BETWEEN 9 AND 14 AND n > 100), 0) AS late FROM x GROUP BY 1)
SELECT bin, round(pos1, 6) AS pos1, round(pos3, 6) AS pos3, round(late, 6) AS late, CASE WHEN pos1 > 0.05 AND late > 0.02 AND pos3 > 0.01 AND late > 0.3 * pos3 THEN 'ss' ELSE 'ds' END AS library FROM s""")
def library_type(spark, sf):
    rows = dm.library_types(_counts(spark, sf).where(F.col("end") == 5), ["bin"])
    return rows.withColumns({c: r6(F.col(c)) for c in ("pos1", "pos3", "late")})


@query(f"""WITH {COUNTS}, r AS (SELECT bin, e, position, k::DOUBLE / n AS rate FROM c), f AS (SELECT bin, e, regr_slope(ln(rate - 0.01), position) AS s, regr_intercept(ln(rate - 0.01), position) AS b FROM r WHERE position < 5 AND rate - 0.01 > 0.001 GROUP BY ALL)
SELECT bin, e AS "end", round(CASE WHEN s IS NOT NULL THEN greatest(0.1, least(2, -s)) ELSE 0.5 END, 6) AS decay, round(CASE WHEN s IS NOT NULL THEN greatest(0.01, least(0.5, exp(b))) ELSE 0.1 END, 6) AS amplitude FROM (SELECT DISTINCT bin, e FROM r) LEFT JOIN f USING (bin, e)""")
def decay_fit(spark, sf):
    rates = _counts(spark, sf).withColumn("rate", F.col("k") / F.col("n"))
    return dm.decay_line(rates, ["bin", "end"]).withColumns({c: r6(F.col(c)) for c in ("decay", "amplitude")})


@query(f"""WITH {COUNTS}, x AS (SELECT bin, e, position, k, n, (k + 0.5::DOUBLE) / (n + 1) AS mean, sqrt((k + 0.5::DOUBLE) * (n - k + 0.5::DOUBLE) / ((n + 1.0::DOUBLE) * (n + 1) * (n + 2))) AS sd FROM c), t AS (SELECT *, sqrt(-2 * ln(0.025::DOUBLE)) AS t FROM x), z AS (SELECT *, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS z FROM t)
SELECT bin, e AS "end", position, round(k::DOUBLE / n, 6) AS rate, round(greatest(0, mean - z * sd), 6) AS low, round(least(1, mean + z * sd), 6) AS high FROM z""")
def credible_intervals(spark, sf):
    z = fd.normal_quantile(F.lit(0.975))
    a, b = F.col("k") + 0.5, F.col("n") - F.col("k") + 0.5
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))
    return _counts(spark, sf).select("bin", "end", "position", r6(F.col("k") / F.col("n")).alias("rate"), r6(F.greatest(F.lit(0.0), mean - z * sd)).alias("low"), r6(F.least(F.lit(1.0), mean + z * sd)).alias("high"))


@query("""WITH p AS (SELECT least(19, CAST(floor(value / 500 * 20) AS INT)) AS i FROM events WHERE value >= 0 AND value <= 500), h AS (SELECT b.i, count(p.i) AS n FROM (SELECT CAST(unnest(generate_series(0, 19)) AS INT) AS i) b LEFT JOIN p ON p.i = b.i GROUP BY 1),
s AS (SELECT i, avg(n) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM h), v AS (SELECT * FROM (SELECT i, m, lag(m) OVER (ORDER BY i) AS l, lead(m) OVER (ORDER BY i) AS r FROM s) WHERE m < l AND m < r)
SELECT round(coalesce((SELECT greatest(0.05, least(0.45, (arg_min(i, (m, i)) + 0.5) * 0.05)) FROM v WHERE i < 10), 0.2), 6) AS modern, round(coalesce((SELECT greatest(0.55, least(0.95, (arg_min(i, (m, i)) + 0.5) * 0.05)) FROM v WHERE i >= 10), 0.8), 6) AS ancient""")
def dynamic_thresholds(spark, sf):
    from ..operators.signals import thresholds

    p = read(spark, sf, "events").where("value >= 0 AND value <= 500")
    return thresholds(p, F.col("value") / 500).withColumns({c: r6(F.col(c)) for c in ("modern", "ancient")})


@query(f"""WITH {HITS}, z AS (SELECT bin, count(DISTINCT contig) AS size FROM hits GROUP BY 1), c AS (SELECT bin, marker, count(*) AS copies FROM hits GROUP BY ALL), q AS (SELECT bin, count(*) / 600.0::DOUBLE AS c, (sum(copies) - count(*)) / 600.0::DOUBLE AS x FROM c JOIN z USING (bin) WHERE size >= 5 GROUP BY 1)
SELECT round(1e6 * count(*) FILTER (c >= 0.75 AND x <= 0.05) + 1e4 * count(*) FILTER (NOT (c >= 0.75 AND x <= 0.05) AND c >= 0.5 AND x <= 0.1) + 1e2 * count(*) FILTER (NOT (c >= 0.75 AND x <= 0.05) AND NOT (c >= 0.5 AND x <= 0.1) AND c >= 0.3 AND x <= 0.05) + sum(c - 5 * x) / 1e4, 6) AS score FROM q""")
def partition_score(spark, sf):
    return quality.partition_score(hits(spark, sf), 600).select(r6(F.col("score")).alias("score"))


@query(f"""WITH {HITS}, d AS (SELECT p_partkey AS marker, p_size % 2 AS domain FROM part), n AS (SELECT domain, count(*) AS total FROM d GROUP BY 1), c AS (SELECT bin, domain, marker, count(*) AS copies FROM hits JOIN d USING (marker) GROUP BY ALL),
q AS (SELECT bin, domain, 100.0::DOUBLE * count(*) / any_value(total) AS completeness, 100.0::DOUBLE * (sum(copies) - count(*)) / any_value(total) AS contamination FROM c JOIN n USING (domain) GROUP BY ALL)
SELECT bin, domain, round(completeness, 6) AS completeness, round(contamination, 6) AS contamination FROM q QUALIFY row_number() OVER (PARTITION BY bin ORDER BY completeness DESC, contamination, domain) = 1""")
def best_domain(spark, sf):
    domains = read(spark, sf, "part").select(F.col("p_partkey").alias("marker"), (F.col("p_size") % 2).alias("domain"))
    return quality.best_domain(hits(spark, sf), domains).withColumns({c: r6(F.col(c)) for c in ("completeness", "contamination")})


@query("""WITH r AS (SELECT l_suppkey AS contig, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e, CAST(round(l_discount * 100) AS BIGINT) AS x FROM lineitem), p AS (SELECT DISTINCT l_suppkey AS contig, l_partkey + 7 AS pos FROM lineitem)
SELECT contig, pos, count(*) AS depth, CAST(sum(x) AS BIGINT) AS cents FROM r JOIN p USING (contig) WHERE pos >= s AND pos < e GROUP BY ALL""")
def reads_at_positions(spark, sf):
    lines = read(spark, sf, "lineitem")
    reads_ = lines.select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.round(F.col("l_discount") * 100).cast("long").alias("x"))
    positions = lines.select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") + 7).alias("pos")).distinct()
    return rd.positions_in_reads(reads_, positions, ["contig"], 64).groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("depth"), F.sum("x").alias("cents"))


@query()
def damage_model_shifts(spark, sf):
    """Held against models of the pooled segments by brute force in the tests."""
    lines = read(spark, sf, "lineitem")
    top = lines.agg((F.max("l_partkey") + 1).alias("top"))  # one row
    hit = F.col("l_orderkey") % F.when(F.col("l_partkey") * 2 < F.col("top"), 3 + F.col("l_linenumber")).otherwise(40) == 0
    rows = lines.join(F.broadcast(top)).groupBy((F.col("l_suppkey") % 2).alias("contig"), F.expr("l_partkey * 20 DIV top").alias("window"), F.when(F.col("l_orderkey") % 2 == 0, 5).otherwise(3).alias("end"), (F.col("l_linenumber") - 1 + F.col("l_orderkey") % 3 * 7).alias("position")).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    return dm.model_shifts(rows, ["contig"]).select("contig", "window", *(r6(F.col(c)).alias(c) for c in ("p_before", "p_after", "amplitude_gap")))
