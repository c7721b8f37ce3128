"""The operators applied to the standard tables, by query name."""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, binary_packing, bpe, cotrain, filter_audit, hard_negatives, html_blocks, jaccard, orc_tokens, packing, pii, rules, toxicity
from .common import table

ORACLE_SQL: dict[str, str] = {
    # Every pair of documents that share a shingle is counted, and labels spread along the links.
    "op10_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')] ELSE list_distinct([x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] for i in generate_series(1, len(x) - 2)]) END AS own FROM w),
n AS (SELECT doc_id, CAST(len(own) AS BIGINT) AS n FROM s), g AS (SELECT doc_id, unnest(own) AS shingle FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 90 * (x.n + y.n - common)),
r(doc_id, label) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.doc_id)
SELECT doc_id, any_value(n.n) AS n_shingles, min(label) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
    # All rows are scored against every anchor.
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS "rank"
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 5""",
    # Documents are counted by the set of filters that they fail; an order's step removes those that fail its filter and none before.
    "op13_filter_interactions": r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(x) < 200 AS INTEGER) AS a, CAST(100 * len(list_distinct(x)) < 50 * len(x) AS INTEGER) AS b, CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INTEGER) AS c,
  CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d, CAST(w.doc_id > least AS INTEGER) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o(name) AS (SELECT CAST('' AS VARCHAR) UNION ALL SELECT name || z FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z) WHERE strpos(name, z) = 0),
s AS (SELECT name AS filter_order, CAST(k AS INTEGER) AS step, 1 << (ascii(name[k]) - 65) AS own, list_sum([1 << (ascii(name[j]) - 65) for j in range(1, k)]) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE length(name) = 5),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (coalesce(before, 0) | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(table(spark, sf_dir, "documents"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), 1, 4096)


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op7_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.stored(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op12_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packing.pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), 2, 4096)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_toxicity, op3_quality_cotraining, op4_audio_features, op5_pattern_packing, op6_html_blocks, op7_orc_token_ids, op8_quality_rules, op9_personal_data, op10_ngram_jaccard, op11_hard_negatives, op12_power_of_two_packing, op13_filter_interactions)
}
