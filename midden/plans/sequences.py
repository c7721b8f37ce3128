"""Queries on sequences, each beside its SQL; a document's letters A, C, G, T stand for a contig."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fractal, kmers
from ..functions import sequence as sq
from ..operators import iterate, overlaps
from .slate import DNA, dna, query, r6


@query(f"WITH {DNA} SELECT doc_id, length(s) AS length, CASE WHEN length(s) > 0 THEN round((length(s) - length(translate(s, 'GC', '')))::DOUBLE / length(s), 6) END AS gc FROM d")
def gc_fraction(spark, sf):
    return dna(spark, sf).select("doc_id", F.length("s").cast("long").alias("length"), r6(sq.gc_fraction(F.col("s"))).alias("gc"))


@query(f"WITH {DNA} SELECT doc_id, length(s) AS length, sha256(reverse(translate(s, 'ACGT', 'TGCA'))) AS digest FROM d")
def reverse_complement(spark, sf):
    return dna(spark, sf).select("doc_id", F.length("s").cast("long").alias("length"), F.sha2(sq.revcomp(F.col("s")), 256).alias("digest"))


def _windows(k: int) -> str:
    return f"SELECT doc_id, s[i:i + {k - 1}] AS k, i FROM (SELECT doc_id, s, unnest(generate_series(1, length(s) - {k - 1})) AS i FROM d)"


KM = f"{DNA}, c AS (SELECT doc_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM ({_windows(4)}) GROUP BY ALL)"


def _tnf(spark, sf):
    return dna(spark, sf).select("doc_id", F.explode(kmers.named_counts(F.col("s"), 4)).alias("x")).select("doc_id", "x.kmer", "x.n")


@query(f"WITH {KM} SELECT doc_id, kmer, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS l2 FROM c")
def tetranucleotides(spark, sf):
    n = F.col("n")
    rows = dna(spark, sf).select("doc_id", kmers.of_counts(F.col("s"), 4).alias("n"))
    norm = F.sqrt(F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x))
    names = F.array(*map(F.lit, sq.canonical_kmers(4)))
    rows = rows.withColumn("norm", norm).select("doc_id", "norm", F.explode(F.arrays_zip(names.alias("kmer"), n.alias("n"))).alias("x")).where("x.n > 0")
    return rows.select("doc_id", "x.kmer", "x.n", r6(F.col("x.n") / F.col("norm")).alias("l2"))


@query(f"WITH {KM} SELECT kmer, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def canonical_kmers(spark, sf):
    return _tnf(spark, sf).groupBy("kmer").agg(F.sum("n").alias("n"))


@query(f"WITH {KM}, t AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM t GROUP BY 1")
def kmer_entropy(spark, sf):
    rows = dna(spark, sf).select("doc_id", kmers.of_counts(F.col("s"), 4).alias("n")).withColumn("total", F.aggregate("n", F.lit(0.0), lambda a, x: a + x)).where("total > 0")
    p = lambda x: x / F.col("total")
    return rows.select("doc_id", r6(F.aggregate(F.filter("n", lambda x: x > 0), F.lit(0.0), lambda a, x: a - p(x) * F.log2(p(x)))).alias("entropy"))


ALL = f"{KM}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), a AS (SELECT DISTINCT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT w.x || x.x || y.x || z.x AS k FROM b w, b x, b y, b z)), f AS (SELECT doc_id, a.kmer, coalesce(n, 0) AS n FROM d CROSS JOIN a LEFT JOIN c USING (doc_id, kmer))"


def _all(spark, sf, values):
    names = F.array(*map(F.lit, sq.canonical_kmers(4)))
    rows = dna(spark, sf).select("doc_id", kmers.of_counts(F.coalesce("s", F.lit("")), 4).alias("n"))
    return rows.select("doc_id", F.explode(F.arrays_zip(names.alias("kmer"), values(F.col("n")).alias("v"))).alias("x")).select("doc_id", "x.kmer", F.round("x.v", 6).alias("value"))


@query(f"WITH {ALL} SELECT doc_id, kmer, round((n + 1)::DOUBLE / sum(n + 1) OVER (PARTITION BY doc_id), 6) AS value FROM f")
def tnf_pseudo_shares(spark, sf):
    return _all(spark, sf, kmers.pseudo_shares)


@query(f"WITH {ALL}, g AS (SELECT *, ln(CASE WHEN sum(n) OVER w > 0 THEN n::DOUBLE / sum(n) OVER w ELSE 0 END + 1e-6) AS l FROM f WINDOW w AS (PARTITION BY doc_id)) SELECT doc_id, kmer, round(l - avg(l) OVER (PARTITION BY doc_id), 6) AS value FROM g")
def tnf_centred_logs(spark, sf):
    return _all(spark, sf, kmers.clr)


def _entropy(k: int) -> str:
    return f"""SELECT doc_id, {k} AS k, CASE WHEN total < {2 * 4**k} THEN -sum((n + 1) / (total + {4**k}.0::DOUBLE) * log2((n + 1) / (total + {4**k}.0::DOUBLE))) - ({4**k} - count(*)) / (total + {4**k}.0::DOUBLE) * log2(1 / (total + {4**k}.0::DOUBLE))
ELSE -sum(n / total::DOUBLE * log2(n / total::DOUBLE)) + CASE WHEN count(*) > 1 THEN (count(*) - 1) / (2.0::DOUBLE * total) ELSE 0 END END AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, k, count(*) AS n FROM ({_windows(k)}) GROUP BY doc_id, k)) WHERE doc_id IN (SELECT doc_id FROM d WHERE length(s) >= 20) GROUP BY doc_id, total"""


@query(f"WITH {DNA}, e AS ({' UNION ALL '.join(map(_entropy, range(2, 7)))}) SELECT d.doc_id, CAST(z.k AS INT) AS k, round(coalesce(entropy, 0), 6) AS entropy FROM d CROSS JOIN (SELECT unnest(generate_series(2, 6)) AS k) z LEFT JOIN e ON e.doc_id = d.doc_id AND e.k = z.k")
def entropy_scaling(spark, sf):
    rows = dna(spark, sf).select("doc_id", F.posexplode(kmers.entropy_scaling("s")).alias("k", "entropy"))
    return rows.select("doc_id", (F.col("k") + 2).alias("k"), r6(F.col("entropy")).alias("entropy"))


@query(f"""WITH {DNA}, w AS (SELECT doc_id, a, s[1 + a:500 + a] AS part FROM (SELECT doc_id, s, unnest(generate_series(0, length(s) - 500, 250)) AS a FROM d WHERE length(s) >= 500)),
c AS (SELECT doc_id, a, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM (SELECT doc_id, a, part[i:i + 3] AS k FROM w, (SELECT unnest(generate_series(1, 497)) AS i)) GROUP BY ALL)
SELECT doc_id, CAST(a // 250 AS INT) AS place, round(sum(pow(n / 497.0::DOUBLE, 2)) / 136 - pow(1 / 136.0::DOUBLE, 2), 9) AS variance FROM c GROUP BY ALL""")
def kmer_variances(spark, sf):
    """Every whole window; a text without one has no row."""
    rows = dna(spark, sf).select("doc_id", F.posexplode(kmers.local_variances("s")).alias("place", "variance"))
    return rows.withColumn("variance", F.round("variance", 9))


def _codes(k: int) -> str:
    return f"list_transform(generate_series(1, length(s) - {k - 1}), lambda i: least(s[i:i + {k - 1}], reverse(translate(s[i:i + {k - 1}], 'ACGT', 'TGCA'))))"


SYN = f"{DNA}, z AS (SELECT doc_id, s, {_codes(11)} AS small, {_codes(21)} AS own FROM d WHERE length(s) >= 21), y AS (SELECT DISTINCT doc_id, own[i] AS k FROM (SELECT *, unnest(generate_series(1, len(own))) AS i FROM z) WHERE list_position(small[i:i + 10], list_min(small[i:i + 10])) IN (1, 11))"


@query(f"WITH {SYN} SELECT doc_id, k AS syncmer FROM y")
def open_syncmers(spark, sf):
    return dna(spark, sf).select("doc_id", F.explode(kmers.syncmers("s")).alias("code")).select("doc_id", kmers.letters(F.col("code"), 21).alias("syncmer"))


M64 = "18446744073709551616::UHUGEINT"


def _mixed(h: str) -> str:
    """The finaliser in 128-bit integers, cut to 64 bits after each product."""
    once = lambda x, c: f"CAST((xor({x}, {x} >> 33)::UHUGEINT * {c}::UHUGEINT) % {M64} AS UBIGINT)"
    return f"list_transform([{h}], lambda a: list_transform([{once('a', 18397679294719823053)}], lambda b: list_transform([{once('b', 14181476777654086739)}], lambda c: xor(c, c >> 33))[1])[1])[1]"


@query(f"""WITH {SYN}, h AS (SELECT doc_id, CAST(list_reduce(list_transform(string_split(translate(k, 'ACGT', '0123'), ''), lambda x: x::UBIGINT), lambda a, x: (a * 4 + x)::UBIGINT) AS UBIGINT) AS h FROM y),
s AS (SELECT i, CAST((11400714819323198485::UHUGEINT * (i + 1)::UHUGEINT) % {M64} AS UBIGINT) AS seed FROM (SELECT unnest(generate_series(0, 127)) AS i)), v AS (SELECT doc_id, i, min({_mixed('xor(h, seed)')}) AS v FROM h, s GROUP BY ALL)
SELECT doc_id, CAST(i AS INT) AS place, CASE WHEN v >= 9223372036854775808 THEN CAST(v::HUGEINT - 18446744073709551616 AS BIGINT) ELSE v::BIGINT END AS value FROM v""")
def minhash_signatures(spark, sf):
    rows = dna(spark, sf).select("doc_id", kmers.syncmers("s").alias("codes")).where(F.size("codes") > 0)
    return rows.select("doc_id", F.posexplode(kmers.minhash("codes")).alias("place", "value"))


@query(f"""WITH {DNA}, z AS (SELECT doc_id, {_codes(25)} AS own FROM d WHERE length(s) >= 34) SELECT DISTINCT doc_id, list_min(own[i:i + 9]) AS minimizer FROM (SELECT *, unnest(generate_series(1, len(own) - 9)) AS i FROM z)""")
def minimizers(spark, sf):
    return dna(spark, sf).select("doc_id", F.explode(kmers.minimizers(F.col("s"), 25)).alias("code")).select("doc_id", kmers.letters(F.col("code"), 25).alias("minimizer"))


DI = f"{DNA}, x AS (SELECT doc_id, k AS xy, count(*) AS n FROM ({_windows(2)}) GROUP BY ALL)"


PAIRS = [a + b for a in "ACGT" for b in "ACGT"]


def odds_of_each(spark, sf):
    """(doc_id, n, rho): counts and odds of PAIRS, rho null where n is 0; a text's odds come from its own counts, so nothing is shuffled."""
    n = {xy: F.col("n")[i] for i, xy in enumerate(PAIRS)}
    sums = {f"x{a}": sum((n[a + b] for b in "CGT"), n[a + "A"]) for a in "ACGT"} | {f"y{b}": sum((n[a + b] for a in "CGT"), n["A" + b]) for b in "ACGT"}
    rows = dna(spark, sf).select("doc_id", kmers.of_counts(F.col("s"), 2, canonical=False).alias("n")).withColumns(sums)
    total = F.col("xA") + F.col("xC") + F.col("xG") + F.col("xT")
    return rows.select("doc_id", "n", F.array(*(F.when(n[xy] > 0, n[xy] * total / (F.col(f"x{xy[0]}") * F.col(f"y{xy[1]}"))) for xy in PAIRS)).alias("rho"))


def odds(spark, sf):
    """(doc_id, xy, n, rho) of the dinucleotides that a text has."""
    each = F.array(*(F.when(F.col("n")[i] > 0, F.struct(F.lit(xy).alias("xy"), F.col("n")[i].alias("n"), F.col("rho")[i].alias("rho"))) for i, xy in enumerate(PAIRS)))
    return odds_of_each(spark, sf).select("doc_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.xy", "x.n", "x.rho")


@query(f"""WITH {DI} SELECT doc_id, xy, n, round(n::DOUBLE * sum(n) OVER (PARTITION BY doc_id) / (sum(n) OVER (PARTITION BY doc_id, xy[1]) * sum(n) OVER (PARTITION BY doc_id, xy[2])), 6) AS rho FROM x""")
def dinucleotide_odds(spark, sf):
    return odds(spark, sf).withColumn("rho", r6(F.col("rho")))


@query(f"""WITH {DI}, r AS (SELECT doc_id, xy, n::DOUBLE * sum(n) OVER (PARTITION BY doc_id) / (sum(n) OVER (PARTITION BY doc_id, xy[1]) * sum(n) OVER (PARTITION BY doc_id, xy[2])) AS rho FROM x),
m AS (SELECT xy, avg(rho) AS mean FROM r GROUP BY 1) SELECT doc_id, round(sum(abs(rho - mean)) / 16, 6) AS distance FROM r JOIN m USING (xy) GROUP BY 1""")
def karlin_distance(spark, sf):
    r = odds(spark, sf)
    mean = r.groupBy("xy").agg(F.avg("rho").alias("mean"))
    return r.join(F.broadcast(mean), "xy").groupBy("doc_id").agg(r6(F.sum(F.abs(F.col("rho") - F.col("mean"))) / 16).alias("distance"))  # 16 rows are broadcast


@query(f"""WITH {DNA}, k AS (SELECT DISTINCT doc_id, k FROM ({_windows(12)})), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
x AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM k a JOIN k b ON a.k = b.k AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY ALL) SELECT i, j, c AS shared, round(c::DOUBLE / (x1.n + x2.n - c), 6) AS jaccard FROM x JOIN n x1 ON i = x1.doc_id JOIN n x2 ON j = x2.doc_id""")
def kmer_jaccard(spark, sf):
    """Queries are the rows whose id is divisible by 100, against all rows."""
    k = dna(spark, sf).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), kmers.of_set(F.col("s"), 12).cast("array<int>").alias("codes"))
    both = overlaps.with_asks(iterate.cut(k.where(F.size("codes") > 0)), F.col("id") % 100 == 0)
    return both.select("i", "j", "shared", r6(F.col("shared") / (F.col("ni") + F.col("nj") - F.col("shared"))).alias("jaccard"))


def _grid(m: int) -> str:
    """Cells of a grid of 2^m: the last m letters, behind a start in the middle, which is G and before it A."""
    return f"SELECT doc_id, count(*) AS used, sum(n) AS total, sum(n * n) AS squares, -sum(n / t * log2(n / t + 1e-12)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, p[i + {7 - m}:i + 6] AS cell, count(*)::DOUBLE AS n FROM (SELECT doc_id, 'AAAAAG' || s AS p, unnest(generate_series(1, length(s))) AS i FROM d WHERE length(s) >= 500) GROUP BY ALL)) GROUP BY doc_id"


def _stat(m: int) -> str:
    c = f"{4**m}.0::DOUBLE"
    return f"g{m} AS (SELECT doc_id, h / greatest(1, log2(used)) AS h, used / {c} AS o, (squares / {c} - pow(total / {c}, 2)) / pow(total / {c}, 2) AS l FROM ({_grid(m)}))"


@query(f"""WITH {DNA}, {_stat(4)}, {_stat(5)}, {_stat(6)} SELECT doc_id, {', '.join(f'round(coalesce({x}, 0), 6) AS {c}' for c, x in (('h1', 'b.h - a.h'), ('h2', 'c.h - b.h'), ('o1', 'b.o - a.o'), ('o2', 'c.o - b.o'), ('l1', 'b.l - a.l'), ('l2', 'c.l - b.l'), ('h', 'b.h'), ('o', 'b.o'), ('l', 'b.l')))},
CASE WHEN length(s) > 0 THEN round(1 / (1 + exp(-4 * (log10(length(s)) - log10(4000)))), 6) ELSE 0 END AS weight FROM d LEFT JOIN g4 a USING (doc_id) LEFT JOIN g5 b USING (doc_id) LEFT JOIN g6 c USING (doc_id)""")
def chaos_game(spark, sf):
    """Every text; under 500 letters all nine are zero."""
    rows = dna(spark, sf).select("doc_id", "s", fractal.cgr9("s").alias("v"))
    weight = F.when(F.length("s") > 0, 1 / (1 + F.exp(-4 * (F.log10(F.length("s")) - F.log10(F.lit(4000.0)))))).otherwise(0.0)
    return rows.select("doc_id", *(r6(F.col("v")[i]).alias(c) for i, c in enumerate(("h1", "h2", "o1", "o2", "l1", "l2", "h", "o", "l"))), r6(weight).alias("weight"))


WALK = f"""{DNA}, e AS (SELECT doc_id, s, length(s) AS n FROM d WHERE length(s) >= 100), p AS (SELECT doc_id, n, i, substr(s, greatest(1, i - 59), least(i, 60)) AS tail FROM (SELECT doc_id, s, n, unnest(generate_series(1, n)) AS i FROM e)),
t AS (SELECT doc_id, n, i, list_transform(string_split(reverse(tail), ''), lambda x: CASE WHEN x IN ('C', 'G') THEN 1 ELSE 0 END) AS a, list_transform(string_split(reverse(tail), ''), lambda x: CASE WHEN x IN ('G', 'T') THEN 1 ELSE 0 END) AS b FROM p),
w AS (SELECT doc_id, n, list_sum(list_transform(a, lambda v, j: v * pow(0.5::DOUBLE, j))) + pow(0.5::DOUBLE, i + 1) AS x, list_sum(list_transform(b, lambda v, j: v * pow(0.5::DOUBLE, j))) + pow(0.5::DOUBLE, i + 1) AS y FROM t)"""


@query(f"""WITH {WALK}, m AS (SELECT doc_id, avg(x) AS mx, avg(y) AS my FROM w GROUP BY 1), c AS (SELECT w.*, x - mx AS dx, y - my AS dy FROM w JOIN m USING (doc_id)),
h AS (SELECT doc_id, sum(dx * dx) / pow(n, 2) AS m20, sum(dy * dy) / pow(n, 2) AS m02, sum(dx * dy) / pow(n, 2) AS m11, sum(pow(dx, 3)) / pow(n, 2.5) AS m30, sum(pow(dy, 3)) / pow(n, 2.5) AS m03, sum(dx * dx * dy) / pow(n, 2.5) AS m21, sum(dx * dy * dy) / pow(n, 2.5) AS m12 FROM c GROUP BY doc_id, n),
q AS (SELECT doc_id, count(*) FILTER (x < 0.5 AND y < 0.5) / count(*)::DOUBLE AS q0, count(*) FILTER (x >= 0.5 AND y < 0.5) / count(*)::DOUBLE AS q1, count(*) FILTER (x < 0.5 AND y >= 0.5) / count(*)::DOUBLE AS q2 FROM w GROUP BY 1),
g AS (SELECT doc_id, -sum(v * log2(v)) AS entropy, sum(v * v) AS uniformity, max(v) AS densest FROM (SELECT doc_id, count(*) / any_value(n)::DOUBLE AS v FROM w GROUP BY doc_id, least(15, floor(x * 16 + 1e-9)), least(15, floor(y * 16 + 1e-9))) GROUP BY 1),
r AS (SELECT doc_id, count(*) FILTER (sqrt(pow(x - 0.5, 2) + pow(y - 0.5, 2)) / sqrt(0.5::DOUBLE) < 0.5) / count(*)::DOUBLE AS inner_ FROM w GROUP BY 1)
SELECT d.doc_id, round(coalesce(1e6 * (m20 + m02), 0), 4) AS hu1, round(coalesce(1e12 * (pow(m20 - m02, 2) + 4 * m11 * m11), 0), 2) AS hu2, {', '.join(f'round(coalesce({c}, 0), 6) AS {c.strip("_")}' for c in ('q0', 'q1', 'q2', 'inner_', 'entropy', 'uniformity', 'densest'))} FROM d LEFT JOIN (h JOIN q USING (doc_id) JOIN g USING (doc_id) JOIN r USING (doc_id)) USING (doc_id)""")
def cgr_shape(spark, sf):
    v = F.col("v")
    rows = dna(spark, sf).select("doc_id", fractal.cgr26("s").alias("v"))
    inner = sum((v[9 + i] for i in range(1, 5)), v[9])
    return rows.select("doc_id", F.round(1e6 * v[2], 4).alias("hu1"), F.round(1e12 * v[3], 2).alias("hu2"), r6(v[19]).alias("q0"), r6(v[20]).alias("q1"), r6(v[21]).alias("q2"), r6(inner).alias("inner"), r6(v[23]).alias("entropy"), r6(v[24]).alias("uniformity"), r6(v[25]).alias("densest"))


SCALES = ", ".join(f"({0.5 / 1.5**i!r}::DOUBLE)" for i in range(10))


@query(f"""WITH {WALK}, z AS (SELECT * FROM (VALUES {SCALES}) AS z(size)), c AS (SELECT doc_id, n, size, count(*)::DOUBLE AS boxes FROM (SELECT doc_id, n, size, floor(x / size + 1e-9) AS a, floor(y / size + 1e-9) AS b FROM w, z GROUP BY ALL) GROUP BY ALL),
u AS (SELECT doc_id, n, ln(1 / size) AS x, ln(boxes) AS y, greatest(0, n / boxes - 2) AS k FROM c WHERE n / boxes >= 2 AND n / boxes <= 0.8 * n), v AS (SELECT doc_id, n, count(*) AS scales, sum(k) * sum(k * x * x) - pow(sum(k * x), 2) AS down, sum(k) * sum(k * x * y) - sum(k * x) * sum(k * y) AS up FROM u GROUP BY ALL)
SELECT d.doc_id, round(CASE WHEN e.n IS NULL THEN 0 WHEN coalesce(scales, 0) < 2 THEN least(2, 1 + ln(e.n) / 10) ELSE CASE WHEN down > 1e-10 THEN up / down ELSE 1.5 END - CASE WHEN e.n < 500 THEN 1 ELSE 0.7 END / ln(e.n + 1) END, 5) AS dimension FROM d LEFT JOIN e USING (doc_id) LEFT JOIN v USING (doc_id)""")
def box_dimension(spark, sf):
    return dna(spark, sf).select("doc_id", F.round(fractal.cgr26("s")[0], 5).alias("dimension"))


@query(f"""WITH {WALK}, z AS (SELECT unnest([15.0, 25.0, 40.0]::DOUBLE[]) AS target), c AS (SELECT doc_id, target, count(*)::DOUBLE AS n FROM (SELECT doc_id, target, floor(x / greatest(0.02, least(0.5, sqrt(target / n))) + 1e-9) AS a, floor(y / greatest(0.02, least(0.5, sqrt(target / n))) + 1e-9) AS b FROM w, z) GROUP BY doc_id, target, a, b),
s AS (SELECT doc_id, target, avg(n) AS mean, avg(n * n) AS square FROM c GROUP BY ALL), f AS (SELECT doc_id, var_pop(n) / pow(avg(n), 2) AS v FROM (SELECT doc_id, count(*)::DOUBLE AS n FROM w GROUP BY doc_id, floor(x / 0.2 + 1e-9), floor(y / 0.2 + 1e-9)) GROUP BY 1),
o AS (SELECT doc_id, round(CASE WHEN coalesce(sum(mean - 3) FILTER (mean >= 3), 0) >= 1e-10 THEN sum(greatest(0, square - mean * mean - mean) / (mean * mean) * (mean - 3)) FILTER (mean >= 3) / sum(mean - 3) FILTER (mean >= 3) ELSE any_value(v) END, 5) AS lacunarity FROM s JOIN f USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(lacunarity, 0) AS lacunarity FROM d LEFT JOIN o USING (doc_id)""")
def cgr_lacunarity(spark, sf):
    return dna(spark, sf).select("doc_id", F.round(fractal.cgr26("s")[1], 5).alias("lacunarity"))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to several tasks a core: a file of one row group is one task, however long its rows take."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism)


@query()
def complexity_bundle(spark, sf):
    v = F.col("v")
    rows = spread(dna(spark, sf)).select("doc_id", fractal.complexity14("s").alias("v"), fractal.walk5("s").alias("w"))
    names = ("lz100", "lz500", "lz2000", "lz", "hurst_gc", "hurst_2mers", "hurst_3mers", "dfa")
    return rows.select("doc_id", *(r6(v[i]).alias(c) for i, c in enumerate(names)), r6(v[13]).alias("slope"), *(r6(F.col("w")[i]).alias(c) for i, c in enumerate(("walk_x", "walk_y", "anisotropy", "ratio", "spread"))))


@query()
def strobemer_lacunarity(spark, sf):
    return dna(spark, sf).select("doc_id", kmers.strobemer_features("s").alias("features"))


#: Shorter sequences have no breaks by their composition's complexity.
BREAKABLE = 3000


@query(f"""WITH {DNA}, w AS (SELECT doc_id, a // 500 AS i, s[1 + a:1000 + a] AS part FROM (SELECT doc_id, s, unnest(generate_series(0, length(s) - 1000, 500)) AS a FROM d WHERE length(s) >= {BREAKABLE})),
c AS (SELECT doc_id, i, k, count(*) AS n FROM (SELECT doc_id, i, part[j:j + 3] AS k FROM w, (SELECT unnest(generate_series(1, 997)) AS j)) GROUP BY ALL),
e AS (SELECT doc_id, i, -sum(n / 997.0::DOUBLE * log2(n / 997.0::DOUBLE)) + (count(*) - 1) / (2 * 997.0::DOUBLE) AS e FROM c GROUP BY ALL), x AS (SELECT doc_id, i, lag(e) OVER v AS before, lead(e) OVER v AS after FROM e WINDOW v AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(i * 500 AS BIGINT) AS pos, round(before, 6) AS before, round(after, 6) AS after FROM x WHERE abs(after - before) >= 0.15""")
def entropy_breaks(spark, sf):
    """Windows of 1,000 letters, every 500, whose neighbours' 4-mer entropies differ by 0.15."""
    rows = dna(spark, sf).where(f"length(s) >= {BREAKABLE}").select("doc_id", kmers.window_entropies("s").alias("e"))
    around = F.transform(F.sequence(F.lit(1), F.size("e") - 2), lambda i: F.struct((i * 500).cast("long").alias("pos"), F.col("e")[i - 1].alias("before"), F.col("e")[i + 1].alias("after")))
    found = rows.select("doc_id", F.explode(F.filter(around, lambda x: F.abs(x.after - x.before) >= 0.15)).alias("x"))
    return found.select("doc_id", "x.pos", r6(F.col("x.before")).alias("before"), r6(F.col("x.after")).alias("after"))


@query()
def composition_breaks(spark, sf):
    """Windows whose neighbours differ in walk exponent, LZ or 4-mer entropy, by the kinds of evidence; sequences of 3,000 letters or more have breaks."""
    rows = dna(spark, sf).where(f"length(s) >= {BREAKABLE}").select("doc_id", fractal.windowed("s").alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - 2)
    kinds = (("hurst", 0, 0.15), ("lz", 1, 0.1), ("entropy", 2, 0.15))
    names = lambda i: F.filter(F.array(*(F.when(F.abs(F.col("w")[i + 1][k] - F.col("w")[i - 1][k]) >= least, name) for name, k, least in kinds)), lambda x: x.isNotNull())
    found = rows.where(F.size("w") >= 3).select("doc_id", F.explode(F.transform(at, lambda i: F.struct((i * 500).cast("long").alias("pos"), names(i).alias("evidence")))).alias("x"))
    return found.select("doc_id", "x.pos", F.array_join("x.evidence", ",").alias("evidence")).where("evidence <> ''")
