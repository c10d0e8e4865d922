"""Queries over evidence written from the order tables: a text per order that states a
customer's budget, date and manager, in files of different kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import ranked
from corpusmill.operators import contracts, facts, resolve


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, source_file, text)."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = F.broadcast(read("nation").select("n_nationkey", "n_name"))  # 25 rows by its definition
    customer = read("customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    name, amount = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), T.money(F.floor("o_totalprice"))
    budget = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Previously the budget of Project "), name, F.lit(" was "), amount, F.lit(".")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("The new budget of Project "), name, F.lit(" was increased to "), amount, F.lit(".")))
        .otherwise(F.concat(F.lit("Project "), name, F.lit(" budget is "), amount, F.lit(".")))
    )
    text = F.concat_ws("\n", budget, F.concat(F.lit("Completion Date: "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(".")), F.concat(F.lit("Project "), name, F.lit(" is managed by "), F.col("n_name"), F.lit(".")))
    key = F.col("o_orderkey").cast("string")
    path = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("contracts/amendment_"), key)).when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("contracts/contract_base_"), key))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("noise/note_"), key)).otherwise(F.concat(F.lit("reports/report_"), key))
    )
    return rows.select(F.col("o_orderkey").alias("block_id"), F.concat(path, F.lit(".txt")).alias("source_file"), text.alias("text"))


def fact_table(spark, sf_dir):
    rows = facts.extract(evidence(spark, sf_dir))
    return rows.select("entity", "field", "value", F.coalesce("amount", F.lit(-1)).alias("amount"), "status", "block_id", F.col("date.y").alias("y"), F.col("date.m").alias("m"), F.col("date.d").alias("d"), "is_amendment", "is_base", "is_noise")


def temporal_field_resolver(spark, sf_dir):
    return facts.resolved(facts.extract(evidence(spark, sf_dir)), ["entity", "field"]).select("entity", "field", "value", "block_id")


def temporal_supersession(spark, sf_dir):
    rows = evidence(spark, sf_dir).select("block_id", "source_file", F.regexp_extract("text", facts.NAME, 1).alias("entity"), T.date_parts(F.col("text")).alias("date"))
    return facts.superseded(rows).select("block_id", "entity", "reason")


def supersession_counts(spark, sf_dir):
    rows = temporal_supersession(spark, sf_dir)
    return rows.groupBy(F.coalesce("reason", F.lit("holds")).alias("reason")).agg(F.count("*").alias("n_blocks"), F.countDistinct("entity").alias("n_entities"))


def kernel_list(spark, sf_dir):
    """The projects of each manager, a row per project with its place in the list."""
    rows = facts.current_owners(facts.extract(evidence(spark, sf_dir)))
    return ranked(rows, ["owner"], [F.col("entity")], "position")


def kernel_compare(spark, sf_dir):
    """The higher budget of each customer and the next by key."""
    values = facts.known_amounts(facts.extract(evidence(spark, sf_dir)), "budget")
    key = F.col("c_custkey")
    pairs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("pair_id"), F.concat(F.lit("C"), key.cast("string")).alias("a"), F.concat(F.lit("C"), (key + 1).cast("string")).alias("b"))
    return facts.compared(pairs, values).withColumn("amount", F.coalesce("amount", F.lit(-1)))


def portfolio(spark, sf_dir):
    """Sum of current budgets per manager, and the project with the largest."""
    owned = facts.owned_amounts(facts.extract(evidence(spark, sf_dir)), "budget")
    return owned.groupBy("owner").agg(F.count("*").alias("n_projects"), F.sum("amount").alias("total"), F.max(F.struct("amount", F.col("entity"))).alias("top")).select("owner", "n_projects", "total", F.col("top.entity").alias("top_project"), F.col("top.amount").alias("top_amount"))


def multi_fact_lookup(spark, sf_dir):
    """Budget and deadline of every customer, one of them as a joined answer."""
    rows = facts.extract(evidence(spark, sf_dir))
    answers = facts.resolved(rows.where("field IN ('budget', 'deadline')"), ["entity", "field"])
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity"), F.explode(F.array(F.struct(F.lit(1).alias("position"), F.lit("budget").alias("field")), F.struct(F.lit(2).alias("position"), F.lit("deadline").alias("field")))).alias("x"))
    return facts.looked_up(asked.select("qid", "entity", "x.*"), answers, facts.mentioned_entities(rows))


def budget_normalise(spark, sf_dir):
    text = T.budget_string(F.col("text"))
    return evidence(spark, sf_dir).select("block_id", text.alias("budget"), T.normalized_budget(text).alias("amount"))


def date_extract(spark, sf_dir):
    d = T.date_parts(F.col("text"))
    return evidence(spark, sf_dir).select("block_id", d["y"].alias("y"), d["m"].alias("m"), d["d"].alias("d"))


def field_coverage(spark, sf_dir):
    rows = evidence(spark, sf_dir).select(T.file_name(F.col("source_file")).alias("name"), *[facts.field_coverage(F.col("text"), f).alias(f) for f in ("budget", "deadline", "owner", "location")])
    kind = F.regexp_extract("name", "^[a-z_]+", 0)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f).cast("double")) * 100, 6).alias(f"{f}_pct") for f in ("budget", "deadline", "owner", "location")])


def _asked(spark, sf_dir):
    """A question per customer, with the blocks of that customer and of those whose key
    has one digit more: names that begin alike."""
    key = F.col("c_custkey")
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("qid"), F.concat(F.lit("What is the budget of Project C"), key.cast("string"), F.lit("?")).alias("question"), F.array(F.concat(F.lit("Project C"), key.cast("string"))).alias("entities"),
        F.lit("single_fact_lookup").alias("intent"), F.lit(None).cast("string").alias("marker"),
    )
    rows = evidence(spark, sf_dir).withColumn("of", F.regexp_extract("text", r"Project C(\d+)", 1).cast("long"))
    keyed = rows.select("*", F.explode(F.array_distinct(F.array("of", F.floor(F.col("of") / 10)))).alias("qid")).drop("of")
    return keyed.join(asked, "qid")


def resolver(spark, sf_dir):
    return resolve.resolved(_asked(spark, sf_dir))


def field_rerank(spark, sf_dir):
    score = resolve.field_score(F.col("text"), F.col("source_file"), F.get("entities", F.lit(0)), ("owner", "budget"))
    return ranked(_asked(spark, sf_dir).select("qid", "block_id", score.alias("score")), ["qid"], [F.col("score").desc(), F.col("block_id")])


def claim_states(spark, sf_dir):
    """Every order's amount as a claim about its customer's budget, against all facts
    but noise."""
    rows = facts.extract(evidence(spark, sf_dir)).where(~F.col("is_noise"))
    claims = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity"), F.lit("budget").alias("field"), T.money(F.floor("o_totalprice")).alias("value"))
    return contracts.verified_claims(claims, rows).select("claim_id", "entity", "value", "state")


QUERIES = {f.__name__: f for f in (
    fact_table, temporal_field_resolver, temporal_supersession, supersession_counts, kernel_list, kernel_compare, portfolio, multi_fact_lookup, budget_normalise, date_extract, field_coverage, resolver, field_rerank, claim_states,
)}

_EV = """
ev AS (
  SELECT o_orderkey AS block_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'contracts/amendment_' WHEN '2-HIGH' THEN 'contracts/contract_base_' WHEN '5-LOW' THEN 'noise/note_' ELSE 'reports/report_' END || o_orderkey || '.txt' AS source_file,
    CASE o_orderstatus
      WHEN 'F' THEN 'Previously the budget of Project C' || o_custkey || ' was $' || format('{:,}', floor(o_totalprice)::BIGINT) || '.'
      WHEN 'P' THEN 'The new budget of Project C' || o_custkey || ' was increased to $' || format('{:,}', floor(o_totalprice)::BIGINT) || '.'
      ELSE 'Project C' || o_custkey || ' budget is $' || format('{:,}', floor(o_totalprice)::BIGINT) || '.' END
    || chr(10) || 'Completion Date: ' || strftime(o_orderdate, '%-d %B %Y') || '.' || chr(10) || 'Project C' || o_custkey || ' is managed by ' || n_name || '.' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS)
_DATES = f"""
dt AS (
  SELECT *, regexp_extract(text, '\\b(\\d{{1,2}})\\s+([a-zA-Z]+)\\s+(\\d{{4}})\\b', 3)::INT AS y,
    coalesce(list_position([{_MONTHS}], lower(regexp_extract(text, '\\b(\\d{{1,2}})\\s+([a-zA-Z]+)\\s+(\\d{{4}})\\b', 2))), 0)::INT - 1 AS m,
    regexp_extract(text, '\\b(\\d{{1,2}})\\s+([a-zA-Z]+)\\s+(\\d{{4}})\\b', 1)::INT AS d,
    regexp_extract(text, 'Project\\s+([A-Z][A-Z0-9_-]*)', 1) AS entity,
    source_file LIKE '%/amendment%' AS is_amendment, source_file LIKE '%contract_base%' AS is_base, source_file LIKE 'noise%' AS is_noise
  FROM ev
)"""
_FACTS = f"""
{_EV}, {_DATES},
ln AS (SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM dt),
lx AS (
  SELECT *, CASE WHEN regexp_matches(line, 'Project ') THEN entity WHEN NOT is_noise THEN entity END AS e,
    CASE WHEN regexp_matches(lower(line), 'previously|former|deprecated|was \\$') AND NOT regexp_matches(lower(line), 'new budget|increased to') THEN 'obsolete' ELSE 'active' END AS status,
    nullif(regexp_extract(line, 'managed by ([A-Za-z0-9_ ]+)', 1), '') AS owner,
    nullif(regexp_extract(line, '(\\$\\d{{1,3}}(?:[,\\s]\\d{{3}})*(?:\\.\\d+)?)', 1), '') AS budget,
    nullif(regexp_extract(line, '\\b\\d{{1,2}}\\s+[a-zA-Z]+\\s+\\d{{4}}\\b'), '') AS deadline
  FROM ln
),
facts AS (
  SELECT e AS entity, 'owner' AS field, owner AS value, NULL::BIGINT AS amount, status, block_id, y, m, d, is_amendment, is_base, is_noise, i * 4 AS seq FROM lx WHERE e IS NOT NULL AND owner IS NOT NULL
  UNION ALL SELECT e, 'budget', budget, replace(replace(budget, '$', ''), ',', '')::DOUBLE::BIGINT, status, block_id, y, m, d, is_amendment, is_base, is_noise, i * 4 + 2 FROM lx WHERE e IS NOT NULL AND budget IS NOT NULL
  UNION ALL SELECT e, 'deadline', deadline, NULL, status, block_id, y, m, d, is_amendment, is_base, is_noise, i * 4 + 3 FROM lx WHERE e IS NOT NULL AND deadline IS NOT NULL
)"""
_RESOLVED = f"""
{_FACTS},
cl AS (SELECT *, bool_or(NOT is_noise) OVER (PARTITION BY entity, field) AS clean FROM facts),
res AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY y DESC, m DESC, d DESC, is_amendment DESC, block_id, seq) AS k FROM cl WHERE (NOT clean OR NOT is_noise) AND status = 'active'
  ) WHERE k = 1
)"""
_OWNED = """
ow AS (SELECT entity, value AS owner, y, m, d FROM facts WHERE field = 'owner' AND status = 'active'),
cur AS (SELECT DISTINCT owner, entity FROM ow o WHERE NOT EXISTS (SELECT 1 FROM ow l WHERE l.entity = o.entity AND l.owner <> o.owner AND o.y <> -1 AND l.y <> -1 AND (l.y, l.m, l.d) > (o.y, o.m, o.d)))"""
_SUPER = f"""
{_EV}, {_DATES},
sw AS (
  SELECT *, count(*) OVER w AS n, bool_or(is_amendment) OVER w AS amended, max(y * 10000 + m * 100 + d) OVER w AS latest, max(CASE WHEN is_amendment THEN y * 10000 + m * 100 + d END) OVER w AS last_amendment
  FROM dt WINDOW w AS (PARTITION BY entity)
),
su AS (
  SELECT block_id, entity, CASE WHEN n > 1 AND is_base AND amended THEN 'amended' WHEN n > 1 AND is_amendment AND last_amendment > y * 10000 + m * 100 + d THEN 'later amendment'
    WHEN n > 1 AND NOT is_amendment AND latest > y * 10000 + m * 100 + d THEN 'later date' END AS reason FROM sw
)"""

_ASKED = f"""
{_SUPER},
ca AS (SELECT x.* FROM (SELECT *, unnest(list_distinct([substr(entity, 2)::BIGINT, substr(entity, 2)::BIGINT // 10])) AS qid FROM su JOIN ev USING (block_id)) x JOIN customer ON c_custkey = x.qid)"""

ORACLES = {
    "resolver": f"WITH {_ASKED} SELECT qid, block_id, CASE WHEN entity <> 'C' || qid AND starts_with(entity, 'C' || qid) THEN 'suffix_distractor' WHEN entity <> 'C' || qid THEN 'unrelated_entity' WHEN reason IS NOT NULL THEN 'obsolete' ELSE 'active' END AS state FROM ca",
    "field_rerank": f"""WITH {_ASKED}, tk AS (SELECT *, regexp_extract_all(lower(text || ' ' || source_file), '[a-z0-9_]+') AS t FROM ca),
        sc AS (SELECT qid, block_id, round(CASE WHEN starts_with(entity, 'C' || qid) THEN 8.0::DOUBLE ELSE 0.0 END + CASE WHEN list_contains(t, 'c' || qid) THEN 5.0 ELSE 0.0 END + (len(list_filter(['owner', 'manager', 'managed', 'responsible', 'budget', 'amount', 'cost'], lambda x: list_contains(t, x)))) * 1.5::DOUBLE
          + len(list_filter(['evidence', 'proof', 'source', 'budget', 'owns', 'managed'], lambda x: list_contains(t, x))) * 0.8::DOUBLE - len(list_filter(['background', 'generic', 'lure', 'noise', 'ordinary', 'unrelated'], lambda x: list_contains(t, x))) * 3.0::DOUBLE, 6) AS score FROM tk)
        SELECT qid, block_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_id)::INT AS rank FROM sc""",
    "claim_states": f"""WITH {_FACTS}, f AS (SELECT * FROM facts WHERE NOT is_noise), k AS (SELECT entity, bool_or(status = 'active') AS alive FROM f GROUP BY ALL),
        h AS (SELECT entity, value, bool_or(status = 'active') AS active FROM f WHERE field = 'budget' GROUP BY ALL),
        c AS (SELECT o_orderkey AS claim_id, 'C' || o_custkey AS entity, '$' || format('{{:,}}', floor(o_totalprice)::BIGINT) AS value FROM orders)
        SELECT claim_id, c.entity, c.value, CASE WHEN NOT coalesce(alive, false) THEN 'unknown_entity' WHEN active THEN 'active' WHEN active IS NOT NULL THEN 'obsolete' ELSE 'wrong_value' END AS state
        FROM c LEFT JOIN h ON h.entity = c.entity AND h.value = c.value LEFT JOIN k ON k.entity = c.entity""",
    "fact_table": f"WITH {_FACTS} SELECT entity, field, value, coalesce(amount, -1) AS amount, status, block_id, y, m, d, is_amendment, is_base, is_noise FROM facts",
    "temporal_field_resolver": f"WITH {_RESOLVED} SELECT entity, field, value, block_id FROM res",
    "temporal_supersession": f"WITH {_SUPER} SELECT block_id, entity, reason FROM su",
    "supersession_counts": f"WITH {_SUPER} SELECT coalesce(reason, 'holds') AS reason, count(*) AS n_blocks, count(DISTINCT entity) AS n_entities FROM su GROUP BY ALL",
    "kernel_list": f"WITH {_FACTS}, {_OWNED} SELECT owner, entity, row_number() OVER (PARTITION BY owner ORDER BY entity)::INT AS position FROM cur",
    "kernel_compare": f"""WITH {_RESOLVED}, b AS (SELECT entity, amount FROM res WHERE field = 'budget'), k AS (SELECT DISTINCT entity FROM facts),
        p AS (SELECT c_custkey AS pair_id, 'C' || c_custkey AS a, 'C' || (c_custkey + 1) AS b FROM customer),
        x AS (SELECT p.*, va.amount AS aa, vb.amount AS bb, ka.entity AS ke, kb.entity AS kf FROM p LEFT JOIN b va ON va.entity = p.a LEFT JOIN b vb ON vb.entity = p.b LEFT JOIN k ka ON ka.entity = p.a LEFT JOIN k kb ON kb.entity = p.b),
        s AS (SELECT *, CASE WHEN ke IS NULL OR kf IS NULL THEN 'NOT_FOUND' WHEN aa IS NULL OR bb IS NULL THEN 'KERNEL_MISSING_FIELD' WHEN aa = bb THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END AS status FROM x)
        SELECT pair_id, a, b, status, CASE WHEN status = 'PASS' THEN 'Project ' || CASE WHEN aa > bb THEN a ELSE b END || ' (budget of $' || format('{{:,}}', greatest(aa, bb)) || ')' ELSE status END AS answer,
          CASE WHEN status = 'PASS' THEN greatest(aa, bb) ELSE -1 END AS amount FROM s""",
    "portfolio": f"""WITH {_RESOLVED}, {_OWNED}, o AS (SELECT owner, entity, amount FROM cur JOIN (SELECT entity, amount FROM res WHERE field = 'budget') USING (entity))
        SELECT owner, count(*) AS n_projects, sum(amount)::BIGINT AS total, (max(row(amount, entity))).entity AS top_project, max(amount) AS top_amount
        FROM o GROUP BY owner""".replace("(max(row(amount, entity))).entity", "max({'amount': amount, 'entity': entity}).entity"),
    "multi_fact_lookup": f"""WITH {_RESOLVED}, k AS (SELECT DISTINCT entity FROM facts),
        x AS (SELECT c_custkey AS qid, k.entity AS known, b.value AS b, t.value AS t FROM customer LEFT JOIN k ON k.entity = 'C' || c_custkey
          LEFT JOIN res b ON b.entity = 'C' || c_custkey AND b.field = 'budget' LEFT JOIN res t ON t.entity = 'C' || c_custkey AND t.field = 'deadline')
        SELECT qid, CASE WHEN b IS NOT NULL AND t IS NOT NULL THEN b || ' and ' || t WHEN known IS NOT NULL THEN 'KERNEL_MISSING_FIELD' ELSE 'NOT_FOUND' END AS answer FROM x""",
    "budget_normalise": f"WITH {_EV} SELECT block_id, regexp_extract(text, '(\\$\\d{{1,3}}(?:[,\\s]\\d{{3}})*(?:\\.\\d+)?)', 1) AS budget, replace(replace(regexp_extract(text, '(\\$\\d{{1,3}}(?:[,\\s]\\d{{3}})*(?:\\.\\d+)?)', 1), '$', ''), ',', '')::DOUBLE::BIGINT AS amount FROM ev",
    "date_extract": f"WITH {_EV}, {_DATES} SELECT block_id, y, m, d FROM dt",
    "field_coverage": f"""WITH {_EV}, l AS (SELECT regexp_extract(split_part(source_file, '/', 2), '^[a-z_]+') AS kind, lower(text) AS t FROM ev)
        SELECT kind, count(*) AS n, round(avg((contains(t, 'budget') OR contains(t, '$'))::INT::DOUBLE) * 100, 6) AS budget_pct, round(avg((contains(t, 'deadline') OR contains(t, 'date'))::INT::DOUBLE) * 100, 6) AS deadline_pct,
          round(avg((contains(t, 'owner') OR contains(t, 'author') OR contains(t, 'manager'))::INT::DOUBLE) * 100, 6) AS owner_pct, round(avg((contains(t, 'location') OR contains(t, 'based in'))::INT::DOUBLE) * 100, 6) AS location_pct FROM l GROUP BY ALL""",
}
