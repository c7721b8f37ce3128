"""Queries on centres of embeddings, each beside its SQL with the rounds written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import centres
from .slate import query, r6, vectors

E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def _d(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"


def _far(k: int) -> str:
    """k farthest-first choices: c0 to c(k - 1)."""
    out = ["c0 AS (SELECT * FROM e ORDER BY id LIMIT 1)", f"n0 AS (SELECT e.id, e.v, {_d('e.v', 'c0.v')} AS d FROM e, c0)"]
    for i in range(1, k):
        out += [f"c{i} AS (SELECT id, v FROM n{i - 1} ORDER BY d DESC, id LIMIT 1)", f"n{i} AS (SELECT n.id, n.v, least(n.d, {_d('n.v', f'c{i}.v')}) AS d FROM n{i - 1} n, c{i})"]
    return ", ".join(out)


CHOSEN = f"{E}, {_far(5)}, k AS ({' UNION ALL '.join(f'SELECT {i} AS centre, id, v AS c FROM c{i}' for i in range(5))})"


def _points(spark, sf):
    return vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH {CHOSEN} SELECT CAST(centre AS INT) AS centre, id FROM k")
def farthest_first(spark, sf):
    return centres.farthest_first(_points(spark, sf), 5).select("centre", "id")


def _assigned(name: str, source: str) -> str:
    return f"{name} AS (SELECT id, v, centre FROM (SELECT e.id, e.v, centre, row_number() OVER (PARTITION BY e.id ORDER BY {_d('e.v', 'c')}, centre) AS r FROM e, {source}) WHERE r = 1)"


def _means(name: str, source: str) -> str:
    return f"{name} AS (SELECT centre, list(m ORDER BY j) AS c, any_value(n) AS n FROM (SELECT centre, j, avg(x) AS m, count(*) AS n FROM (SELECT centre, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM {source}) GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {CHOSEN}, {_assigned('a1', 'k')}, {_means('m1', 'a1')}, {_assigned('a2', 'm1')}, {_means('m2', 'a2')} SELECT CAST(centre AS INT) AS centre, n, round(c[1], 6) AS first, round(list_sum(c), 6) AS total FROM m2")
def mean_centres(spark, sf):
    points = _points(spark, sf)
    rows = centres.means(points, centres.farthest_first(points, 5), 2, -1.0)
    return rows.select("centre", "n", r6(F.col("c")[0]).alias("first"), r6(F.aggregate("c", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {CHOSEN}, {_assigned('a1', 'k')}, {_means('m1', 'a1')}, z AS (SELECT a.centre, a.id, {_d('a.v', 'm.c')} AS d FROM a1 a JOIN m1 m ON m.centre = a.centre) SELECT CAST(centre AS INT) AS centre, arg_min(id, (d, id)) AS id, round(min(d), 6) AS d FROM z GROUP BY 1")
def medoid_centres(spark, sf):
    points = _points(spark, sf)
    return centres.medoids(points, centres.farthest_first(points, 5)).withColumn("d", r6(F.col("d")))
