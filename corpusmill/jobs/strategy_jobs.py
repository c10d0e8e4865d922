"""Searches of marked evidence by several strategies. A nation stands for a question: about
a marker, a project, two projects, a month, or a project that doesn't exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import top_k, written
from corpusmill.jobs.fact_jobs import _EV
from corpusmill.jobs.indexes import index_of
from corpusmill.jobs.search_jobs import _HASH
from corpusmill.jobs.sql import quoted
from corpusmill.operators import lexical_index as L
from corpusmill.operators import resolve, strategies

CAP = 40
_LIMITS = {"ann_k": 60, "lexical_k": 80, "rerank_k": 50, "input_k": 40, "output_k": 20}
CELLS = [strategies.Cell(s, cap, k, scan_blocks=scan, **_LIMITS) for s in strategies.STRATEGIES for cap, k, scan in ((20, 5, 10), (40, 10, 2_000_000_000))]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text, entities, marker, fields, intent)."""
    key = F.col("n_nationkey")
    name = lambda letter, n: F.concat(F.lit(f"Project {letter}"), (key + n).cast("string"))
    kind, nobody = key % 5, F.array().cast("array<string>")
    mark = F.concat(F.lit("ref_"), F.substring(F.sha2((key + 1).cast("string"), 256), 1, 10))
    month = F.date_format(F.make_date(1992 + key % 7, key % 12 + 1, F.lit(1)), "MMMM yyyy")
    text = (
        F.when(kind == 0, F.concat(F.lit("What is the budget in "), mark, F.lit("?"))).when(kind == 1, F.concat(F.lit("Who is the manager of "), name("C", 1), F.lit("?")))
        .when(kind == 2, F.concat(F.lit("Compare the budget of "), name("C", 1), F.lit(" vs "), name("C", 2))).when(kind == 3, F.concat(F.lit("List all projects of "), month, F.lit(" with evidence")))
        .otherwise(F.concat(F.lit("List all amounts of "), name("Z", 0)))
    )
    entities = F.when(kind == 1, F.array(name("C", 1))).when(kind == 2, F.array(name("C", 1), name("C", 2))).when(kind == 4, F.array(name("Z", 0))).otherwise(nobody)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(key.cast("long").alias("qid"), text.alias("text"), entities.alias("entities"))
    rows = rows.withColumns({"marker": T.reference_marker(F.col("text")), "fields": T.required_fields(F.col("text"))})
    return rows.withColumn("intent", T.intent(F.col("text"), F.col("fields"), F.size("entities")))


def pruned_topk(spark, sf_dir):
    """The ten best of each question's first tier that hits: its marker, its entities, any
    term."""
    index = index_of(spark, sf_dir, "evidence")
    found = L.pruned(index, L.role_terms(questions(spark, sf_dir)), CAP)
    return top_k(found, ["qid"], [F.col("score").desc(), F.col("id")], 10).select("qid", "tier", "rank", F.col("id").alias("block_id"), "score")


def pruned_enough(spark, sf_dir):
    """How many candidates pruning leaves, and whether they do without a vector search."""
    asked = questions(spark, sf_dir)
    counts = L.pruned(index_of(spark, sf_dir, "evidence"), L.role_terms(asked), CAP).groupBy("qid").agg(F.count("*").alias("n"), F.first("tier").alias("tier"))
    rows = asked.join(counts, "qid", "left").select("qid", "tier", F.coalesce("n", F.lit(0)).alias("n"), "marker")
    return rows.select("qid", "tier", "n", L.sufficient(F.col("n"), F.col("marker").isNotNull(), 10, CAP).alias("enough"))


def role_topk(spark, sf_dir):
    """The ten best blocks by strong terms (names first) and by field terms."""
    index, terms = index_of(spark, sf_dir, "evidence"), L.role_terms(questions(spark, sf_dir))
    strong = L.first_hitting(index, terms, ["name", "strong"]).select("qid", F.lit("strong").alias("role"), "term")
    rows = L.best_tf(index, strong.unionByName(terms.where("role = 'field'")), 10, ("role", "qid"))
    return rows.select("role", "qid", "rank", F.col("id").alias("block_id"), "score")


def strategy_topk(spark, sf_dir):
    return strategies.searched(index_of(spark, sf_dir, "evidence_vectors"), questions(spark, sf_dir), CELLS).select("cell", "strategy", "qid", "rank", F.col("id").alias("block_id"), "score")


def strategy_sweep(spark, sf_dir):
    """Per cell: questions answered, candidates, and the share of the full scan's five best
    that are among its own."""
    rows = written(strategies.searched(index_of(spark, sf_dir, "evidence_vectors"), questions(spark, sf_dir), CELLS), "sweep")
    full = F.broadcast(rows.where("cell = 0").select("qid", "id", F.lit(1).alias("hit")))  # five rows a question
    per = rows.where("rank <= 5").join(full, ["qid", "id"], "left").groupBy("cell", "strategy", "qid").agg(F.count("hit").alias("hits"), F.first("n_candidates").alias("n_candidates"))
    return per.groupBy("cell", "strategy").agg(F.count("*").alias("n_questions"), F.sum("n_candidates").alias("n_candidates"), F.round(F.sum("hits") / F.count("*") / 5 * 100, 6).alias("overlap_pct"))


QUERIES = {f.__name__: f for f in (pruned_topk, pruned_enough, role_topk, strategy_topk, strategy_sweep)}

_RX = "'[a-z0-9_]+'"


def _own(entity: str) -> str:
    return f"list_concat(regexp_extract_all(lower({entity}), {_RX}), regexp_extract_all(lower(replace({entity}, 'Project ', '')), {_RX}))"


_Q = f"""
{_EV},
bk AS (SELECT block_id AS id, source_file, text || chr(10) || 'Reference ref_' || substr(sha256(block_id::VARCHAR), 1, 10) || '.' AS text FROM ev),
qk AS (SELECT n_nationkey::BIGINT AS qid, n_nationkey % 5 AS kind, 'ref_' || substr(sha256((n_nationkey + 1)::VARCHAR), 1, 10) AS mark, 'Project C' || (n_nationkey + 1) AS c1, 'Project C' || (n_nationkey + 2) AS c2, 'Project Z' || n_nationkey AS z,
         strftime(make_date(1992 + n_nationkey % 7, n_nationkey % 12 + 1, 1), '%B %Y') AS month FROM nation),
q AS (SELECT qid, CASE kind WHEN 0 THEN 'What is the budget in ' || mark || '?' WHEN 1 THEN 'Who is the manager of ' || c1 || '?' WHEN 2 THEN 'Compare the budget of ' || c1 || ' vs ' || c2
           WHEN 3 THEN 'List all projects of ' || month || ' with evidence' ELSE 'List all amounts of ' || z END AS text,
         CASE kind WHEN 1 THEN [c1] WHEN 2 THEN [c1, c2] WHEN 4 THEN [z] ELSE []::VARCHAR[] END AS entities, CASE WHEN kind = 0 THEN mark END AS marker,
         CASE WHEN kind = 1 THEN ['owner', 'manager', 'managed'] WHEN kind = 3 THEN []::VARCHAR[] ELSE ['budget', 'amount', 'cost'] END AS fw,
         CASE kind WHEN 2 THEN ['budget', 'amount', 'cost', 'higher', 'lower'] WHEN 4 THEN ['managed', 'manager', 'owner', 'responsible'] ELSE []::VARCHAR[] END AS iw FROM qk),
qw AS (SELECT *, regexp_extract_all(lower(text), {_RX}) AS t, flatten(list_transform(entities, lambda e: {_own('e')})) AS own, CASE WHEN marker IS NULL THEN []::VARCHAR[] ELSE [marker] END AS m FROM q),
rl AS (
  SELECT qid, role, unnest(list_distinct(terms)) AS term FROM (
    SELECT qid, 'marker' AS role, m AS terms FROM qw
    UNION ALL SELECT qid, 'entity', list_filter(own, lambda x: x NOT IN ('project', 'projects')) FROM qw
    UNION ALL SELECT qid, 'name', list_filter(own, lambda x: x NOT IN ({quoted(T.WEAK_TERMS)})) FROM qw
    UNION ALL SELECT qid, 'all', list_concat(t, m, own) FROM qw
    UNION ALL SELECT qid, 'strong', list_filter(list_concat(own, fw, m, list_filter(t, lambda x: length(x) >= 5)), lambda x: x NOT IN ({quoted(T.WEAK_TERMS)})) FROM qw
    UNION ALL SELECT qid, 'field', list_filter(list_concat(fw, iw, list_filter(t, lambda x: x IN ({quoted(L.ASKED_TERMS)}))), lambda x: x NOT IN ({quoted(L.UNFIELD_TERMS)})) FROM qw
  )
),
tk AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), {_RX})) AS term FROM bk) GROUP BY ALL),
rh AS (SELECT qid, role, id, sum(tf)::BIGINT AS tf FROM tk JOIN rl USING (term) GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid, role ORDER BY tf DESC, id) AS r FROM rh)
"""
_PRUNED = f"""
{_Q},
ti AS (SELECT qid, min(CASE role WHEN 'marker' THEN 1 WHEN 'entity' THEN 2 ELSE 3 END) AS tier FROM rh WHERE role IN ('marker', 'entity', 'all') GROUP BY qid),
pr AS (SELECT qid, tier::INT AS tier, id, tf, r FROM rr JOIN ti USING (qid) WHERE role = CASE tier WHEN 1 THEN 'marker' WHEN 2 THEN 'entity' ELSE 'all' END AND (tier = 1 OR r <= {CAP}))
"""


def _pool_sql() -> str:
    hashed = _HASH.format(units="bk") + "," + _HASH.format(units="(SELECT qid AS id, text FROM q)").replace("hb", "gb").replace("hc", "gc").replace("hn", "gn").replace("hv", "gv")
    cells = ", ".join(f"({n}, '{c.strategy}', {c.cap}, {c.k}, {c.ann_k}, {c.lexical_k}, {c.rerank_k}, {c.input_k}, {c.output_k}, {c.scan_blocks})" for n, c in enumerate(CELLS))
    roles = ", ".join(f"max(tf) FILTER (role = '{r}') AS {x}, max(r) FILTER (role = '{r}') AS {x}_r" for r, x in ((r, f"x_{r}") for r in strategies.ROLES))
    counts = ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in strategies.ROLES)
    terms = lambda f: "[" + quoted(sorted(resolve.FIELD_TERMS[f])) + "]"
    has = lambda words: f"len(list_filter([{quoted(words)}], lambda w: list_contains(t, w)))"
    return f"""
WITH {_Q}, {hashed},
dn AS (SELECT q.qid, bk.id, round(coalesce(s, 0) / (1.0::DOUBLE + 1e-8), 6) AS cos FROM q CROSS JOIN bk LEFT JOIN (SELECT gv.id AS qid, hv.id, sum(gv.w * hv.w) AS s FROM gv JOIN hv USING (bucket) GROUP BY ALL) d ON d.qid = q.qid AND d.id = bk.id),
da AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS ann_r FROM dn),
pv AS (SELECT qid, id, {roles} FROM rr GROUP BY ALL), nv AS (SELECT qid, {counts} FROM rh GROUP BY ALL),
cells(cell, strategy, cap, k, ann_k, lexical_k, rerank_k, input_k, output_k, scan_blocks) AS (VALUES {cells}),
a AS (
  SELECT cells.*, da.*, pv.* EXCLUDE (qid, id), coalesce(n_marker, 0) AS n_marker, coalesce(n_entity, 0) AS n_entity, coalesce(n_name, 0) AS n_name, coalesce(n_all, 0) AS n_all, coalesce(n_strong, 0) AS n_strong, coalesce(n_field, 0) AS n_field,
    marker IS NOT NULL AS marked, greatest(cap, k) AS lim, replace(strategy, 'ooc_', '') AS st
  FROM da LEFT JOIN pv USING (qid, id) LEFT JOIN nv USING (qid) JOIN q USING (qid) CROSS JOIN cells
  WHERE ann_r <= 60 OR x_marker IS NOT NULL OR x_entity_r <= 60 OR x_all_r <= 60 OR x_name_r <= 80 OR x_strong_r <= 80 OR x_field_r <= 80
), b AS (
  SELECT *, CASE WHEN n_marker > 0 THEN x_marker WHEN n_entity > 0 THEN CASE WHEN x_entity_r <= lim THEN x_entity END WHEN x_all_r <= lim THEN x_all END AS tiered,
    CASE WHEN n_marker > 0 THEN n_marker WHEN n_entity > 0 THEN least(lim, n_entity) ELSE least(lim, n_all) END AS n_tiered,
    CASE WHEN n_name > 0 THEN CASE WHEN x_name_r <= 80 THEN x_name END WHEN x_strong_r <= 80 THEN x_strong END AS strong, CASE WHEN n_name > 0 THEN n_name ELSE n_strong END AS n_strong2, CASE WHEN x_field_r <= 80 THEN x_field END AS field,
    st IN ('semantic_field_rescue', 'semantic_cross_encoder_rescue') AS wf, st IN ('semantic_lexical_rescue', 'semantic_field_rescue', 'semantic_rerank_rescue', 'semantic_cross_encoder_rescue') AS rescued
  FROM a
), c AS (SELECT *, (marked AND n_tiered > 0) OR n_tiered >= least(k, cap) AS enough FROM b),
d AS (
  SELECT *, CASE WHEN st IN ('ann_flat', 'ann_hnsw', 'ann_ivf_flat') OR (st = 'ann_pruned_hybrid' AND NOT enough) THEN ann_r <= lim WHEN st LIKE 'semantic%' THEN ann_r <= greatest(ann_k, k) ELSE FALSE END AS in_ann,
    CASE WHEN st IN ('marker_entity_pruned', 'ann_pruned_hybrid') THEN tiered WHEN st = 'semantic_rescue_hybrid' THEN CASE WHEN x_all_r <= greatest(rerank_k, k) THEN x_all END WHEN wf THEN greatest(strong, field) WHEN rescued THEN strong END AS pruned,
    CASE WHEN st IN ('marker_entity_pruned', 'ann_pruned_hybrid') THEN n_tiered WHEN wf THEN n_strong2 + n_field WHEN rescued THEN n_strong2 ELSE 0 END AS n_pruned
  FROM c
), e AS (
  SELECT *, CASE WHEN n_pruned > 0 THEN pruned WHEN st IN ('ann_flat', 'ann_hnsw', 'ann_ivf_flat') THEN NULL WHEN x_all_r <= lim THEN x_all END AS lexical,
    round(CASE WHEN in_ann THEN cos ELSE 0 END + 0.05::DOUBLE * least(coalesce(strong, 0), 20) + CASE WHEN wf THEN 0.03::DOUBLE * least(coalesce(field, 0), 20) ELSE 0 END, 6) AS combined,
    in_ann OR strong IS NOT NULL OR (wf AND field IS NOT NULL) AS merged
  FROM d
), f AS (
  SELECT *, CASE WHEN rescued AND merged THEN row_number() OVER (PARTITION BY cell, qid, rescued AND merged ORDER BY combined DESC, id) END AS comb_r,
    CASE WHEN st = 'semantic_rescue_hybrid' AND (in_ann OR pruned IS NOT NULL) THEN row_number() OVER (PARTITION BY cell, qid, st = 'semantic_rescue_hybrid' AND (in_ann OR pruned IS NOT NULL) ORDER BY id) END AS merged_r
  FROM e
), fs AS (
  SELECT qid, id, CASE WHEN contains(x, lower(ent)) THEN 8.0 ELSE 0.0 END + 3.0 * len(list_filter(own, lambda w: list_contains(t, w)))
      + CASE WHEN len(list_filter(generate_series(1, len(t)), lambda i: list_contains(own, t[i]) AND len(list_filter(t[greatest(1, i - 10):i + 10], lambda w: list_contains(wanted, w))) > 0)) > 0 THEN 2.0 ELSE 0.0 END
      + 1.5 * len(list_filter(wanted, lambda w: list_contains(t, w))) + 0.8 * {has(resolve.EVIDENCE_TERMS)} - 3.0 * {has(resolve.NOISE_TERMS)} AS again
  FROM (
    SELECT p.qid, p.id, lower(bk.text || ' ' || source_file) AS x, regexp_extract_all(lower(bk.text || ' ' || source_file), {_RX}) AS t, coalesce(entities[1], '') AS ent,
      list_filter(regexp_extract_all(replace(lower(coalesce(entities[1], '')), 'project ', ''), {_RX}), lambda w: w NOT IN ('project', 'projects')) AS own,
      CASE WHEN fw[1] = 'owner' THEN {terms('owner')} WHEN fw[1] = 'budget' THEN {terms('budget')} ELSE []::VARCHAR[] END AS wanted
    FROM (SELECT DISTINCT qid, id FROM f WHERE st IN ('semantic_rerank_rescue', 'semantic_cross_encoder_rescue') AND comb_r <= 50) p JOIN bk USING (id) JOIN q USING (qid)
  )
), g AS (
  SELECT f.*, CASE WHEN (st = 'semantic_rerank_rescue' AND comb_r <= greatest(rerank_k, k)) OR (st = 'semantic_cross_encoder_rescue' AND comb_r <= greatest(input_k, k)) THEN round(fs.again, 6) END AS again0 FROM f LEFT JOIN fs USING (qid, id)
), h AS (SELECT *, CASE WHEN again0 IS NOT NULL AND row_number() OVER (PARTITION BY cell, qid, again0 IS NOT NULL ORDER BY again0 DESC, id) <= CASE WHEN st = 'semantic_rerank_rescue' THEN greatest(rerank_k, k) ELSE greatest(output_k, k) END THEN again0 END AS again FROM g),
i AS (
  SELECT *, st = 'full_scan' OR (st = 'semantic_rescue_hybrid' AND (SELECT count(*) FROM bk) <= scan_blocks) AS scan,
    CASE WHEN st = 'marker_entity_pruned' OR (st = 'ann_pruned_hybrid' AND enough) THEN tiered IS NOT NULL WHEN st = 'semantic_rescue_hybrid' THEN coalesce(merged_r <= greatest(rerank_k, k), FALSE)
      WHEN st IN ('semantic_rerank_rescue', 'semantic_cross_encoder_rescue') THEN again IS NOT NULL WHEN rescued THEN coalesce(comb_r <= greatest(rerank_k, k), FALSE) ELSE in_ann END AS cand
  FROM h
), j AS (SELECT *, CASE WHEN scan THEN ann_r <= cap ELSE cand AND row_number() OVER (PARTITION BY cell, qid, cand AND NOT scan ORDER BY cos DESC, id) <= cap END AS dense FROM i),
z AS (
  SELECT cell, strategy, qid, id, k, round(CASE WHEN dense OR in_ann THEN cos ELSE 0 END + 0.05::DOUBLE * least(coalesce(lexical, 0), 20) + 0.05::DOUBLE * least(coalesce(pruned, 0), 20) + 0.02::DOUBLE * coalesce(again, 0) + CASE WHEN x_marker IS NOT NULL THEN 10.0 ELSE 0.0 END, 6) AS score,
    count(*) OVER (PARTITION BY cell, qid) AS n_candidates
  FROM j WHERE dense OR in_ann OR lexical IS NOT NULL OR pruned IS NOT NULL OR again IS NOT NULL OR x_marker IS NOT NULL
), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, qid ORDER BY score DESC, id)::INT AS rank FROM z) WHERE rank <= k)
"""


ORACLES = {
    "pruned_topk": f"WITH {_PRUNED} SELECT qid, tier, rank, id AS block_id, tf AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tf DESC, id)::INT AS rank FROM pr) WHERE rank <= 10",
    "pruned_enough": f"""WITH {_PRUNED}, n AS (SELECT qid, tier, count(*) AS n FROM pr GROUP BY ALL)
        SELECT qid, tier, coalesce(n, 0) AS n, (marker IS NOT NULL AND coalesce(n, 0) > 0) OR coalesce(n, 0) >= 10 AS enough FROM q LEFT JOIN n USING (qid)""",
    "role_topk": f"""WITH {_Q}, nm AS (SELECT DISTINCT qid FROM rh WHERE role = 'name'),
        s AS (SELECT 'strong' AS role, qid, id, tf FROM rh WHERE role = 'name' UNION ALL SELECT 'strong', qid, id, tf FROM rh ANTI JOIN nm USING (qid) WHERE role = 'strong' UNION ALL SELECT 'field', qid, id, tf FROM rh WHERE role = 'field')
        SELECT role, qid, rank, id AS block_id, tf AS score FROM (SELECT *, row_number() OVER (PARTITION BY role, qid ORDER BY tf DESC, id)::INT AS rank FROM s) WHERE rank <= 10""",
    "strategy_topk": f"{_pool_sql()} SELECT cell, strategy, qid, rank, id AS block_id, score FROM top",
    "strategy_sweep": f"""{_pool_sql()}, p AS (SELECT t.cell, t.strategy, t.qid, count(u.id) AS hits, any_value(t.n_candidates) AS n_candidates FROM top t LEFT JOIN top u ON u.cell = 0 AND u.qid = t.qid AND u.id = t.id WHERE t.rank <= 5 GROUP BY ALL)
        SELECT cell, strategy, count(*) AS n_questions, sum(n_candidates)::BIGINT AS n_candidates, round(sum(hits) / count(*) / 5 * 100, 6) AS overlap_pct FROM p GROUP BY ALL""",
}
