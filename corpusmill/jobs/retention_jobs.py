"""Features of conversations' turns for the first user turn, and forests on the retention
label, learned from four of five conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.plans import written
from corpusmill.jobs.search_jobs import _HASH, CASE_BM25
from corpusmill.operators import retention
from corpusmill.operators import selection as S

#: Trees of the registered query's forests.
QUERY_TREES = 20


def _features(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = rows.select(F.col("conv_id").alias("group"), F.col("turn").alias("id"), "text")
    first = rows.where("role = 'user'").groupBy(F.col("conv_id").alias("group")).agg(F.min_by("text", "turn").alias("question"))
    return turns, retention.block_features(turns, first.withColumn("entity", F.regexp_extract(F.lower("question"), "[a-z]+", 0)))


def block_feature_matrix(spark, sf_dir):
    return _features(spark, sf_dir)[1].withColumnsRenamed({"group": "conv_id", "id": "turn"})


def retention_forest(spark, sf_dir):
    turns, features = _features(spark, sf_dir)
    score = written(features.select("group", "id", F.round(F.col("bm25") + F.col("semantic"), 6).alias("score")), "scores")
    label = S.retained(turns.join(score, ["group", "id"]), 2, 2, "active").select("group", "id", "keep")
    return retention.forests(features.join(label, ["group", "id"]).withColumn("is_test", F.pmod(F.xxhash64("group"), F.lit(5)) == 0), trees=QUERY_TREES)


QUERIES = {f.__name__: f for f in (block_feature_matrix, retention_forest)}

_BLOCKS = _HASH.format(units="(SELECT c * 1000000 + id AS id, text FROM al)")
_ASKED = _HASH.format(units="(SELECT c AS id, coalesce(text, '') AS text FROM q0)").replace("hb", "gb").replace("hc", "gc").replace("hn", "gn").replace("hv", "gv")
ORACLES = {
    "block_feature_matrix": f"""
        WITH {CASE_BM25}, al AS (SELECT conv_id AS c, turn AS id, coalesce(text, '') AS text FROM conversations), {_BLOCKS}, {_ASKED},
        cs AS (SELECT hv.id, sum(hv.w * gv.w) AS near FROM hv JOIN gv ON gv.id = hv.id // 1000000 AND gv.bucket = hv.bucket GROUP BY hv.id),
        mx AS (SELECT c, max(score) AS best FROM r GROUP BY c),
        x AS (SELECT al.c, al.id, al.text, coalesce(q0.text, '') AS q, regexp_extract(lower(q0.text), '[a-z]+') AS e, score, best, near, row_number() OVER (PARTITION BY al.c ORDER BY al.id) - 1 AS place, count(*) OVER (PARTITION BY al.c) AS n
          FROM al JOIN q0 USING (c) LEFT JOIN mx USING (c) LEFT JOIN r ON r.c = al.c AND r.id = al.id LEFT JOIN cs ON cs.id = al.c * 1000000 + al.id),
        nm AS (SELECT *, list_distinct(regexp_extract_all(q, '\\d+')) AS asked FROM x)
        SELECT c AS conv_id, id AS turn, round(CASE WHEN best > 0 THEN coalesce(score, 0) / best ELSE 0 END, 6) AS bm25, round(coalesce(near, 0), 6) AS semantic, round(place::DOUBLE / n, 6) AS position, round((n - 1 - place)::DOUBLE / n, 6) AS recency,
          CASE WHEN e <> '' AND regexp_matches(lower(text), '(^|[^a-zA-Z0-9_\\-])' || e || '($|[^a-zA-Z0-9_\\-])') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS entity,
          round(len(list_intersect(asked, regexp_extract_all(text, '\\d+')))::DOUBLE / greatest(1, len(asked)), 6) AS number, contains(lower(text), 'active')::INT::DOUBLE AS active FROM nm""",
}
