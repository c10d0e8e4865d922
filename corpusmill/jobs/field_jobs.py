"""Fields, names, sinks and cells over the driver's tables: orders' evidence with a line on
who runs it, nations as a dimension of people, conversations through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import shared_path
from corpusmill.jobs.fact_jobs import _EV, evidence
from corpusmill.jobs.search_jobs import TOP, _exemplars
from corpusmill.operators import fields, vectors
from corpusmill.sources import tables

TURNS = "conv_id long, turn long, role string, text string"


def _nations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


def field_values(spark, sf_dir):
    """The five fields of every order's text, a line on its department added by key."""
    names = tuple(r.n_name for r in _nations(spark, sf_dir).orderBy("n_nationkey").collect())  # 25 rows by its definition
    k = F.col("block_id") % 4
    line = F.when(k == 0, "Lead Unit: Finance").when(k == 1, "It is overseen by the sales unit").when(k == 2, "The finance committee heard LEGAL").otherwise("")
    rows = evidence(spark, sf_dir).withColumn("text", F.concat_ws("\n", "text", line))
    lists = {"budget": (), "deadline": (), "owner": names, "department": fields.DEPARTMENTS, "location": names}
    return rows.select("block_id", *[fields.field_value(F.col("text"), f, of).alias(f) for f, of in lists.items()])


def exact_projects(spark, sf_dir):
    """Texts that name a customer without a suffix: every third name has one, every sixth
    a harmless one."""
    k = F.col("block_id")
    entity = F.concat(F.lit("Project C"), F.regexp_extract("text", r"Project C(\d+)", 1))
    suffix = F.when(k % 6 == 0, " -x").when(k % 3 == 0, "-legacy").otherwise("")
    return evidence(spark, sf_dir).select("block_id", fields.exact_project(F.concat(F.lit("Of "), entity, suffix, F.lit(".")), entity).alias("exact"))


def canonical_managers(spark, sf_dir):
    """Customers' nations, spelled in four ways, as canonical names: in lower case, as an
    alias, by initial, and by what a name holds."""
    nation = _nations(spark, sf_dir)
    name, second = F.col("n_name"), F.element_at(F.split("n_name", " "), -1)
    people = nation.select(F.col("n_nationkey").alias("place"), name.alias("name"), F.array(F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"))).alias("aliases"))
    k = F.col("c_custkey") % 4
    spelled = (
        F.when(k == 0, F.concat(F.lit(" "), F.lower(name))).when(k == 1, F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")))
        .when((k == 2) & F.contains(name, F.lit(" ")), F.concat(F.split(name, " ")[0], F.lit(" "), F.substring(second, 1, 1), F.lit("."))).otherwise(F.substring(name, 1, 4))
    )
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.select("c_custkey", spelled.alias("raw"))
    return rows.join(fields.canonical_names(rows, people), "raw", "left").select("c_custkey", "raw", "name")


def verifier_amounts(spark, sf_dir):
    """Amounts as a verifier reads them: a bare year is a number too."""
    year = F.date_format("o_orderdate", "yyyy")
    text = F.when(F.col("o_orderkey") % 2 == 0, year).otherwise(T.money(F.floor("o_totalprice")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", T.normalized_budget(text).alias("amount"), T.normalized_budget(text, years=True).alias("number"))


def json_lists(spark, sf_dir):
    """Fields that hold a JSON list, a plain text or nothing, as lists."""
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, F.to_json(F.array("c_name", "c_mktsegment"))).when(k % 3 == 1, F.col("c_mktsegment")).otherwise("")
    listed = fields.json_list(value)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.size(listed).alias("n"), F.array_join(listed, "|").alias("items"))


def _turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def csv_round_trip(spark, sf_dir):
    path = shared_path(spark, "turns-csv")
    tables.write_csv(_turns(spark, sf_dir), path)
    return tables.read_csv(spark, path, TURNS).withColumn("text", F.md5(F.col("text").cast("binary")))


def json_lines_round_trip(spark, sf_dir):
    path = shared_path(spark, "turns-json")
    tables.write_json_lines(_turns(spark, sf_dir), path)
    return tables.read_json_lines(spark, path, TURNS).withColumn("text", F.md5(F.col("text").cast("binary")))


def ivf_topk(spark, sf_dir):
    """Nearest vectors by probed cells; approximate, so without SQL. 96 cells: with eight,
    about half of the nearest vectors of these tables are found."""
    rows, queries = _exemplars(spark, sf_dir)
    return vectors.ivf_top_k(rows, queries, TOP, nprobe=96).select("qid", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {f.__name__: f for f in (field_values, exact_projects, canonical_managers, verifier_amounts, json_lists, csv_round_trip, json_lines_round_trip, ivf_topk)}

_TRIP = "SELECT conv_id, turn, role, md5(text) AS text FROM conversations"

ORACLES = {
    "field_values": f"""WITH {_EV}, e AS (SELECT block_id, text, regexp_extract(text, 'managed by ([A-Z0-9_ ]+)', 1) AS nation FROM ev), o AS (SELECT nation, arg_min(n_name, n_nationkey) AS owner FROM (SELECT DISTINCT nation FROM e) JOIN nation ON contains(nation, n_name) GROUP BY ALL)
        SELECT block_id, regexp_extract(text, '(\\$\\d{{1,3}}(?:,\\d{{3}})*)', 1) AS budget, regexp_extract(text, '(\\d{{1,2}}\\s+[A-Za-z]+\\s+\\d{{4}})', 1) AS deadline, owner,
          CASE block_id % 4 WHEN 0 THEN 'Finance' WHEN 1 THEN 'Sales' WHEN 2 THEN 'Legal' END AS department, nation AS location FROM e JOIN o USING (nation)""",
    "exact_projects": f"WITH {_EV} SELECT block_id, block_id % 6 = 0 OR block_id % 3 <> 0 AS exact FROM ev",
    "canonical_managers": """WITH n AS (SELECT c_custkey, n_nationkey, n_name, c_custkey % 4 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
        r AS (SELECT *, CASE WHEN k = 0 THEN ' ' || lower(n_name) WHEN k = 1 THEN 'nation ' || n_nationkey WHEN k = 2 AND contains(n_name, ' ') THEN split_part(n_name, ' ', 1) || ' ' || substr(split_part(n_name, ' ', 2), 1, 1) || '.' ELSE substr(n_name, 1, 4) END AS raw FROM n)
        SELECT c_custkey, raw, CASE WHEN k < 2 THEN n_name WHEN k = 2 AND contains(n_name, ' ') THEN (SELECT arg_min(m.n_name, m.n_nationkey) FROM nation m WHERE split_part(m.n_name, ' ', 1) = split_part(r.n_name, ' ', 1) AND substr(split_part(m.n_name, ' ', 2), 1, 1) = substr(split_part(r.n_name, ' ', 2), 1, 1))
          ELSE (SELECT arg_min(m.n_name, m.n_nationkey) FROM nation m WHERE contains(m.n_name, trim(raw))) END AS name FROM r""",
    "verifier_amounts": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN floor(o_totalprice)::BIGINT END AS amount, CASE WHEN o_orderkey % 2 <> 0 THEN floor(o_totalprice)::BIGINT ELSE year(o_orderdate) END AS number FROM orders""",
    "json_lists": "SELECT c_custkey, (CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::INT AS n, CASE c_custkey % 3 WHEN 0 THEN c_name || '|' || c_mktsegment WHEN 1 THEN c_mktsegment ELSE '' END AS items FROM customer",
    "csv_round_trip": _TRIP,
    "json_lines_round_trip": _TRIP,
}
