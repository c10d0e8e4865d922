"""Code context of generated patches: an order is an issue, its lines are hunks of a patch,
parts are symbols of files, and suppliers name files in several ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import code


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(key):
    return F.concat(F.lit("pkg"), (key % 5).cast("string"), F.lit("/mod_"), (key % 400).cast("string"), F.lit(".py"))


def _hunks(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    start = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 11) % 900 + 1
    return rows.withColumns({"file": _file(F.col("l_partkey")), "start": start.cast("int"), "added": 1 + F.col("q") % 3})


def _patches(spark, sf_dir):
    """(id, patch): a hunk per line of the order, each a context line and added ones."""
    at = F.col("start").cast("string")
    head = F.concat(F.lit("--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n@@ -"), at, F.lit(",1 +"), at, F.lit(","), (F.col("added") + 1).cast("string"), F.lit(" @@\n context"))
    hunk = F.concat(head, F.repeat(F.lit("\n+added"), F.col("added")))
    rows = _hunks(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", hunk.alias("hunk")).alias("h"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["hunk"]), "\n").alias("patch"))


def _symbols(spark, sf_dir):
    key = F.col("p_partkey")
    first = (key * 29 % 800 + 1).cast("int")
    return _read(spark, sf_dir, "part").select(_file(key).alias("path"), F.concat(F.lit("f"), key.cast("string")).alias("symbol"), first.alias("first"), (first + F.col("p_size") * 4).cast("int").alias("last"))


def patch_symbols(spark, sf_dir):
    """The smallest symbol around every added line of every patch."""
    return code.changed_symbols(code.changed_lines(_patches(spark, sf_dir)), _symbols(spark, sf_dir)).withColumnRenamed("id", "o_orderkey")


def context_recall(spark, sf_dir):
    """What snippets hold of each patch: one per line of the order, every second in the next
    part's file."""
    gold = code.changed_symbols(code.changed_lines(_patches(spark, sf_dir)), _symbols(spark, sf_dir), repeated=False)  # the metrics count a line once
    odd = F.col("l_linenumber") % 2
    chosen = _hunks(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rank"), _file(F.col("l_partkey") + odd).alias("file"), F.col("start").alias("first"), (F.col("start") + F.col("l_linenumber") % 4).cast("int").alias("last"), F.col("q").alias("n_tokens"))
    return code.context_metrics(chosen, gold).withColumnRenamed("id", "o_orderkey")


def path_matches(spark, sf_dir):
    """The files that each supplier's name of a path means: the file's name, its folder and
    name in capitals, or a longer path around the whole of it."""
    key, k = F.col("p_partkey"), F.col("s_suppkey")
    files = _read(spark, sf_dir, "part").select(F.concat(F.lit("src/pkg"), (key % 5).cast("string"), F.lit("/sub"), (key % 7).cast("string"), F.lit("/mod_"), (key % 400).cast("string"), F.lit(".py")).alias("path")).distinct()
    tail = F.concat(F.lit("sub"), (k % 7).cast("string"), F.lit("/mod_"), (k % 400).cast("string"), F.lit(".py"))
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("mod_"), (k % 400).cast("string"), F.lit(".py"))).when(k % 4 == 1, F.upper(tail))
        .when(k % 4 == 2, F.concat(F.lit("C:\\work\\src/pkg"), (k % 5).cast("string"), F.lit("/"), tail)).otherwise(F.concat(F.lit("d_"), (k % 400).cast("string"), F.lit(".py")))
    )
    return code.matching_paths(files, _read(spark, sf_dir, "supplier").select(k.alias("id"), name.alias("suffix"))).select(F.col("id").alias("s_suppkey"), "path")


QUERIES = {f.__name__: f for f in (patch_symbols, context_recall, path_matches)}


def _sql_file(key: str) -> str:
    return f"'pkg' || ({key} % 5) || '/mod_' || ({key} % 400) || '.py'"


_GOLD = f"""
hk AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey, {_sql_file('l_partkey')} AS file, (l_partkey * 7 + l_linenumber * 11) % 900 + 1 AS start, l_quantity::INT AS q FROM lineitem),
ln AS (SELECT DISTINCT id, file, unnest(range(start + 1, start + 2 + q % 3))::INT AS line FROM hk),
sy AS (SELECT {_sql_file('p_partkey')} AS file, 'f' || p_partkey AS symbol, p_partkey * 29 % 800 + 1 AS first, p_partkey * 29 % 800 + 1 + p_size * 4 AS last FROM part),
gd AS (
  SELECT id, ln.file, line, coalesce(min_by(symbol, {{'s': last - first, 'f': first, 'n': symbol}}), any_value(ln.file || ':' || line || '-' || line)) AS symbol
  FROM ln LEFT JOIN sy ON sy.file = ln.file AND line BETWEEN first AND last GROUP BY ALL
)"""

ORACLES = {
    "patch_symbols": f"WITH {_GOLD} SELECT id AS o_orderkey, file, line, symbol FROM gd",
    "context_recall": f"""
        WITH {_GOLD}, ch AS (SELECT id, n AS rank, {_sql_file('(l_partkey + n % 2)')} AS file, start AS first, start + n % 4 AS last, q FROM hk),
        cv AS (SELECT id, count(*) AS covered FROM (SELECT DISTINCT ln.id, ln.file, line FROM ln JOIN ch ON ch.id = ln.id AND ch.file = ln.file AND line BETWEEN first AND last) GROUP BY id),
        sm AS (SELECT id, count(*) AS n_symbols, count(*) FILTER (r <= 1) AS h1, count(*) FILTER (r <= 3) AS h3, count(*) FILTER (r <= 5) AS h5
               FROM (SELECT DISTINCT id, file, symbol FROM gd) g LEFT JOIN (SELECT id, file, min(rank) AS r FROM ch GROUP BY ALL) f USING (id, file) GROUP BY id),
        sz AS (SELECT id, sum(greatest(0, last - first + 1)) AS n_lines, sum(q) AS n_tokens FROM ch GROUP BY id), gn AS (SELECT id, count(*) AS n_gold FROM ln GROUP BY id)
        SELECT id AS o_orderkey, round(100.0::DOUBLE * h1 / n_symbols, 6) AS symbol_recall_1, round(100.0::DOUBLE * h3 / n_symbols, 6) AS symbol_recall_3, round(100.0::DOUBLE * h5 / n_symbols, 6) AS symbol_recall_5,
          round(100.0::DOUBLE * coalesce(covered, 0) / n_gold, 6) AS line_coverage, round(100.0::DOUBLE * greatest(0, n_lines - coalesce(covered, 0)) / greatest(1, n_lines), 6) AS irrelevant_lines, round(n_tokens::DOUBLE / greatest(1, n_gold), 6) AS tokens_per_line
        FROM sz JOIN gn USING (id) LEFT JOIN cv USING (id) JOIN sm USING (id)""",
    "path_matches": """
        WITH f AS (SELECT DISTINCT 'src/pkg' || (p_partkey % 5) || '/sub' || (p_partkey % 7) || '/mod_' || (p_partkey % 400) || '.py' AS path FROM part),
        t AS (SELECT s_suppkey, s_suppkey % 4 AS k, 'sub' || (s_suppkey % 7) || '/mod_' || (s_suppkey % 400) || '.py' AS tail, s_suppkey % 400 AS m, s_suppkey % 5 AS p FROM supplier),
        c AS (SELECT s_suppkey, lower(CASE k WHEN 0 THEN 'mod_' || m || '.py' WHEN 1 THEN tail WHEN 2 THEN 'c:/work/src/pkg' || p || '/' || tail ELSE 'd_' || m || '.py' END) AS name FROM t)
        SELECT s_suppkey, path FROM f JOIN c ON path = name OR ends_with(path, '/' || name) OR ends_with(name, '/' || path)""",
}
