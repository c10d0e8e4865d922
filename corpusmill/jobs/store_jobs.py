"""The fact store over orders' evidence and a memo per customer: renames, reassignments,
departments, aliases, headers and noise; packs of customers and the claims about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import written
from corpusmill.jobs.fact_jobs import _FACTS, evidence
from corpusmill.operators import fact_store, facts
from corpusmill.operators.fields import DEPARTMENTS

LOCATIONS = ("Lyon", "Paris", "Berlin", "Madrid", "Rome")
MEMO = 10_000_000_000  # block ids of memos lie above those of orders


def _nations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows by its definition
    return [r.n_name for r in rows]


def _people(spark, sf_dir):
    """Nations as people, the last number first; each with a desk as an alias."""
    return [(name, [f"desk-{n}."]) for n, name in enumerate(_nations(spark, sf_dir))][::-1]


def memos(spark, sf_dir):
    names = _nations(spark, sf_dir)
    key, kind, of = F.col("c_custkey"), F.col("c_custkey") % 6, F.col("c_nationkey")
    nation = lambda n: F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int"))
    pick = lambda options: F.get(F.array(*map(F.lit, options)), (key % len(options)).cast("int"))
    name = lambda letter: F.concat(F.lit(f"Project {letter}"), key.cast("string"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    first = (
        F.when(kind == 0, say(name("C"), " was renamed to ", name("D"), ".")).when(kind == 1, say("From: ", nation(of), "\nDate: 5 May 1999\nSubject: $7,500 asked\n", name("C"), " note."))
        .when(kind == 2, say(name("C"), " was reassigned from ", nation(of), " to ", nation(of + 1), ".")).when(kind == 3, say(name("C"), " sits in the ", pick(DEPARTMENTS), " unit at ", pick(LOCATIONS), "."))
        .when(kind == 4, say(name("C"), " went to desk-", of.cast("string"), ".")).otherwise(say("Budget is $9,000.\n", name("C"), " note."))
    )
    second = F.when(kind == 0, say(name("D"), " was renamed to ", name("E"), "."))
    texts = F.explode(F.filter(F.array(F.struct(F.lit(1).alias("n"), first.alias("text")), F.struct(F.lit(2).alias("n"), second.alias("text"))), lambda x: x["text"].isNotNull()))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", texts.alias("t"))
    folder = F.when(kind == 5, "noise/memo_").otherwise("memos/memo_")
    return rows.select((F.col("t.n") * MEMO + key).alias("block_id"), F.concat(folder, key.cast("string"), F.lit("_"), F.col("t.n").cast("string"), F.lit(".txt")).alias("source_file"), F.col("t.text").alias("text"))


def _store(spark, sf_dir, ordered=True):
    """Facts under last names, the names, and every project that a text names."""
    rows = written(evidence(spark, sf_dir).unionByName(memos(spark, sf_dir)), "evidence")
    names = fact_store.final_names(facts.renames(rows))
    found = written(fact_store.renamed(fact_store.extract(rows, _people(spark, sf_dir), DEPARTMENTS, LOCATIONS, ordered), names), "facts")
    return found, names, rows.select(F.explode(T.matches(F.col("text"), facts.NAME, 1)).alias("entity")).distinct()


def store_facts(spark, sf_dir):
    return _store(spark, sf_dir)[0].select("entity", "field", "value", F.coalesce("amount", F.lit(-1)).alias("amount"), "status", "block_id")


def last_names(spark, sf_dir):
    rows = facts.renames(memos(spark, sf_dir))
    return fact_store.final_names(rows)


def renamed_lookup(spark, sf_dir):
    """Department, budget and deadline of every customer's project by its first name."""
    found, names, mentioned = _store(spark, sf_dir)
    fields = F.explode(F.array(*[F.struct(F.lit(1).alias("position"), F.lit(f).alias("field")) for f in ("department", "budget", "deadline")]))
    key = F.col("c_custkey")
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("key"), F.concat(F.lit("C"), key.cast("string")).alias("entity"), fields.alias("x")).select(F.concat_ws("/", F.col("key").cast("string"), "x.field").alias("qid"), "entity", "x.*")
    return fact_store.looked_up(asked, found, mentioned, names)


def _claims(spark, sf_dir):
    """A claim per order about its customer's project: by the order's key it is as the
    order says, or has another amount, project, date or manager."""
    names = _nations(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    key, wrong = F.col("o_orderkey"), F.col("o_orderkey") % 7
    other = lambda n: (wrong == n).cast("int")
    money = T.money(F.floor("o_totalprice") + other(1))
    project = F.concat(F.lit("Project C"), (F.col("o_custkey") + other(2)).cast("string"))
    date = F.date_format(F.date_add("o_orderdate", other(3)), "d MMMM yyyy")
    manager = F.get(F.array(*map(F.lit, names)), ((F.col("c_nationkey") + other(4)) % len(names)).cast("int"))
    text = F.when(wrong == 5, F.concat(F.lit("The manager is "), manager, F.lit("."))).otherwise(F.concat(project, F.lit(" has a budget of "), money, F.lit(" until "), date, F.lit(" under "), manager, F.lit(".")))
    return rows.select(F.col("o_custkey").alias("pack_id"), key.alias("claim_id"), text.alias("text"))


def claim_scores(spark, sf_dir):
    """Answers about customers, checked claim by claim."""
    found, names, _ = _store(spark, sf_dir, ordered=False)
    key = F.col("c_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("pack_id"), F.concat(F.lit("Project C"), key.cast("string")).alias("target"), F.when(key % 9 == 0, "It is late").otherwise("It is funded well").alias("conclusion"))
    packs = written(fact_store.pack(found, customers, names), "packs")
    conclusions = customers.select("pack_id", "conclusion", F.array(F.lit("is funded")).alias("allowed"))
    return fact_store.verified(_claims(spark, sf_dir), packs, conclusions, names, _people(spark, sf_dir), DEPARTMENTS).withColumnRenamed("pack_id", "c_custkey")


def evidence_packs(spark, sf_dir):
    """How many active and suppressed facts the pack of each manager holds, by field."""
    found, names, _ = _store(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("pack_id"), F.col("n_name").alias("target"))
    rows = fact_store.pack(found, asked, names)
    return rows.groupBy(F.col("pack_id").alias("n_nationkey"), "field").agg(F.count_if("active").alias("n_active"), F.count_if(~F.col("active")).alias("n_suppressed"), F.count_distinct("key").alias("n_projects"))


QUERIES = {f.__name__: f for f in (store_facts, last_names, renamed_lookup, claim_scores, evidence_packs)}

_DEPTS = "[" + ", ".join(f"'{d}'" for d in DEPARTMENTS) + "]"
_LOCS = "[" + ", ".join(f"'{x}'" for x in LOCATIONS) + "]"
_STORE = f"""
{_FACTS},
nm AS (SELECT list(n_name ORDER BY n_nationkey) AS names, count(*) AS n FROM nation),
cu AS (SELECT c_custkey AS k, c_nationkey AS na, c_custkey % 6 AS kind, names[c_nationkey % n + 1] AS a, names[(c_nationkey + 1) % n + 1] AS b, names[greatest(c_nationkey % n, (c_nationkey + 1) % n) + 1] AS lo FROM customer CROSS JOIN nm),
mm AS (
  SELECT 'C' || k AS entity, 'owner' AS field, a AS value, NULL::BIGINT AS amount, 'active' AS status, {MEMO} + k AS block_id, 1999 AS y, 4 AS m, 5 AS d, FALSE AS is_amendment, FALSE AS is_noise, 6000000000 AS seq FROM cu WHERE kind = 1
  UNION ALL SELECT 'C' || k, 'budget', '$7,500', 7500, 'active', {MEMO} + k, 1999, 4, 5, FALSE, FALSE, 6000000002 FROM cu WHERE kind = 1
  UNION ALL SELECT 'C' || k, 'deadline', '5 May 1999', NULL, 'active', {MEMO} + k, 1999, 4, 5, FALSE, FALSE, 6000000003 FROM cu WHERE kind = 1
  UNION ALL SELECT 'C' || k, 'owner', lo, NULL, 'obsolete', {MEMO} + k, -1, -1, -1, FALSE, FALSE, 0 FROM cu WHERE kind = 2
  UNION ALL SELECT 'C' || k, 'owner', b, NULL, 'active', {MEMO} + k, -1, -1, -1, FALSE, FALSE, 1 FROM cu WHERE kind = 2
  UNION ALL SELECT 'C' || k, 'department', {_DEPTS}[k % 7 + 1], NULL, 'active', {MEMO} + k, -1, -1, -1, FALSE, FALSE, 4 FROM cu WHERE kind = 3
  UNION ALL SELECT 'C' || k, 'location', {_LOCS}[k % 5 + 1], NULL, 'active', {MEMO} + k, -1, -1, -1, FALSE, FALSE, 5 FROM cu WHERE kind = 3
  UNION ALL SELECT 'C' || k, 'owner', names[na + 1], NULL, 'active', {MEMO} + k, -1, -1, -1, FALSE, FALSE, 0 FROM cu CROSS JOIN nm WHERE kind = 4
),
st AS (
  SELECT CASE WHEN substr(entity, 2)::BIGINT % 6 = 0 AND substr(entity, 2)::BIGINT IN (SELECT k FROM cu) THEN 'E' || substr(entity, 2) ELSE entity END AS entity, * EXCLUDE (entity)
  FROM (SELECT entity, field, value, amount, status, block_id, y, m, d, is_amendment, is_noise, seq FROM facts UNION ALL SELECT * FROM mm)
)"""
_PACK = f"""
{_STORE},
pk AS (SELECT DISTINCT c_custkey AS pack_id, entity AS key, field, value, amount, status = 'active' AS active FROM st JOIN customer ON entity = CASE WHEN c_custkey % 6 = 0 THEN 'E' ELSE 'C' END || c_custkey),
cl AS (
  SELECT o_custkey AS pack_id, o_orderkey AS claim_id, o_orderkey % 7 AS w, CASE WHEN (o_custkey + (o_orderkey % 7 = 2)::INT) % 6 = 0 AND o_custkey + (o_orderkey % 7 = 2)::INT IN (SELECT k FROM cu) THEN 'E' ELSE 'C' END || (o_custkey + (o_orderkey % 7 = 2)::INT) AS key,
    floor(o_totalprice)::BIGINT + (o_orderkey % 7 = 1)::INT AS amount, strftime(o_orderdate::DATE + (o_orderkey % 7 = 3)::INT, '%-d %B %Y') AS day, upper(names[(c_nationkey + (o_orderkey % 7 = 4)::INT) % n + 1]) AS owner
  FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN nm
),
va AS (SELECT pack_id, claim_id, key, 'budget' AS field, amount::VARCHAR AS value FROM cl WHERE w <> 5 AND amount >= 1000 UNION ALL SELECT pack_id, claim_id, key, 'deadline', day FROM cl WHERE w <> 5 UNION ALL SELECT pack_id, claim_id, key, 'owner', owner FROM cl WHERE w <> 5),
kn AS (SELECT pack_id, key, field, CASE field WHEN 'budget' THEN amount::VARCHAR WHEN 'deadline' THEN value ELSE upper(value) END AS value, bool_or(active) AS active FROM pk GROUP BY ALL),
er AS (SELECT pack_id, count(*) FILTER (NOT active) AS obsolete, count(*) FILTER (active IS NULL AND field IN ('budget', 'deadline')) AS numeric, count(*) FILTER (active IS NULL AND field = 'owner') AS evidence FROM va LEFT JOIN kn USING (pack_id, key, field, value) GROUP BY pack_id),
fo AS (SELECT pack_id, count(*) AS n FROM cl WHERE w <> 5 AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.pack_id = cl.pack_id AND pk.key = cl.key AND active) GROUP BY pack_id),
id AS (SELECT pack_id, count(*) AS n FROM cl WHERE w = 5 AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.pack_id = cl.pack_id AND field = 'owner' AND active AND upper(value) = owner) GROUP BY pack_id),
nc AS (SELECT pack_id, count(*) AS n FROM cl GROUP BY pack_id),
tt AS (
  SELECT c_custkey, coalesce(nc.n, 0) AS n_claims, coalesce(obsolete, 0) AS obsolete, coalesce(numeric, 0) AS numeric, coalesce(evidence, 0) AS evidence, coalesce(fo.n, 0) + coalesce(id.n, 0) AS entity, c_custkey % 9 <> 0 AS conclusion_ok
  FROM customer LEFT JOIN nc ON nc.pack_id = c_custkey LEFT JOIN er ON er.pack_id = c_custkey LEFT JOIN fo ON fo.pack_id = c_custkey LEFT JOIN id ON id.pack_id = c_custkey
)"""

ORACLES = {
    "store_facts": f"WITH {_STORE} SELECT entity, field, value, coalesce(amount, -1) AS amount, status, block_id FROM st",
    "last_names": "SELECT x || c_custkey AS old, 'E' || c_custkey AS new FROM customer CROSS JOIN (VALUES ('C'), ('D')) v(x) WHERE c_custkey % 6 = 0",
    "renamed_lookup": f"""WITH {_STORE}, c2 AS (SELECT *, bool_or(NOT is_noise) OVER (PARTITION BY entity, field) AS clean FROM st),
        rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY y DESC, m DESC, d DESC, is_amendment DESC, block_id, seq) AS r FROM c2 WHERE (NOT clean OR NOT is_noise) AND status = 'active') WHERE r = 1),
        q AS (SELECT k || '/' || f AS qid, CASE WHEN kind = 0 THEN 'E' ELSE 'C' END || k AS entity, f AS field FROM cu CROSS JOIN (VALUES ('department'), ('budget'), ('deadline')) v(f))
        SELECT qid, coalesce(value, 'KERNEL_MISSING_FIELD') AS answer FROM q LEFT JOIN rs USING (entity, field)""",
    "claim_scores": f"""WITH {_PACK}, x AS (SELECT *, obsolete + numeric + evidence + entity AS n_errors FROM tt)
        SELECT c_custkey, n_claims, n_errors, obsolete, numeric, evidence, entity, conclusion_ok, conclusion_ok AND n_errors = 0 AS passed, CASE WHEN conclusion_ok AND n_errors = 0 THEN 1.0::DOUBLE ELSE round(1.0::DOUBLE - n_errors / greatest(1, n_claims), 6) END AS groundedness,
          greatest(1, 5 - (obsolete > 0)::INT - (numeric > 0)::INT - (evidence > 0)::INT - (entity > 0)::INT - (NOT conclusion_ok)::INT) AS score FROM x""",
    "evidence_packs": f"""WITH {_STORE}, ow AS (SELECT DISTINCT n_nationkey, entity FROM st JOIN nation ON field = 'owner' AND upper(value) = upper(n_name)), p AS (SELECT DISTINCT n_nationkey, entity, field, value, amount, status FROM st JOIN ow USING (entity))
        SELECT n_nationkey, field, count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (status <> 'active') AS n_suppressed, count(DISTINCT entity) AS n_projects FROM p GROUP BY ALL""",
}
