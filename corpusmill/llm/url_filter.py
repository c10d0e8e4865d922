"""URL filters: host rules, and pattern rules found by their rarest literal token.

Everything is DataFrame expressions: no Python on the executors, no shuffle. Both
rule sets are literals in the plan, as hash tables: an array of buckets, where a key
hashes to one bucket. A URL's tokens (or the suffixes of its host) fetch rules from
there, and only fetched pattern rules run their regular expression.

Cases: a null url, or one without ``://``, has empty host and path, no host rule fits
it, and its tokens (none for null) still fetch pattern rules. Repeated rows are judged
alike. Extra columns of the input are left out by the query and kept by ``judge``,
which replaces columns of the names it adds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``literals``: lower-case alphanumeric tokens that every URL which ``regex``
    (Java, on the lower-cased URL) matches has between non-alphanumerics."""

    name: str
    verdict: str
    literals: tuple[str, ...]
    regex: str


#: The host rules of the query's contract.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

PATTERN_RULES = (
    PatternRule("gambling", "block", ("casino",), r"://([^/?#]*[.-])?casino[.-]"),
    PatternRule("betting", "block", ("free", "bets"), r"://([^/?#]*\.)?free-bets\."),
    PatternRule("adult", "block", ("adult",), r"://([^/?#]*[.-])?adult[.-]"),
    PatternRule("link-farm", "block", ("spam", "farm"), r"://([^/?#]*\.)?spam-farm\."),
    PatternRule("ad-tracker", "block", ("ads", "track"), r"://([^/?#]*\.)?ads-track\."),
    PatternRule("pills", "block", ("pills",), r"[./-](buy|cheap|best)-pills[./-]"),
    PatternRule("login", "block", ("login",), r"/login([/?#.]|$)"),
    PatternRule("cart", "block", ("add", "to", "cart"), r"[?&/]add-to-cart([=/&]|$)"),
    PatternRule("help-pages", "allow", ("responsible", "gambling"), r"/responsible-gambling([/?#.]|$)"),
)

BUCKETS = 1024


def _index(spark: SparkSession, entries: list[tuple[str, dict]], fields: str) -> Column:
    """A constant array<array<struct<key, ...fields>>>: entries by the hash of their key."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    if entries:
        keys = spark.createDataFrame([(k,) for k in sorted({k for k, _ in entries})], "key string")
        place = {r.key: r.b for r in keys.select("key", _bucket(F.col("key")).alias("b")).collect()}
        for key, fields_of in entries:
            buckets[place[key] - 1].append({"key": key, **fields_of})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<key:string,{fields}>>>")


def _bucket(key: Column) -> Column:
    return (F.pmod(F.xxhash64(key), F.lit(BUCKETS)) + 1).cast("int")


def _fetch(index: Column, keys: Column) -> Column:
    """The entries of all ``keys``."""
    return F.flatten(F.transform(keys, lambda k: F.filter(F.element_at(index, _bucket(k)), lambda e: e["key"] == k)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def rarest_literals(urls: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, str]:
    """For each rule the literal that the fewest of ``urls`` (column url) have, ties
    to the longer, then the alphabetically first. Counted over all rows; what reaches
    the driver is a row per literal of the rule list."""
    literals = sorted({x for r in rules for x in r.literals})
    if not literals:
        return {}
    seen = urls.select(F.explode(F.array_intersect(url_tokens(F.col("url")), F.array(*map(F.lit, literals)))).alias("token"))
    count = {r.token: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r.name: min(r.literals, key=lambda x: (count.get(x, 0), -len(x), x)) for r in rules}


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """``pages`` (column url) with host, path, rule, verdict, pattern and n_candidates.

    The longest host rule that fits decides. Where none fits, a matching allow pattern
    clears the URL, else a matching block pattern blocks it (``pattern``: the first of
    those in rule order), else it is allowed.
    """
    spark = pages.sparkSession
    rarest = rarest_literals(pages, pattern_rules)
    hosts = _index(spark, [(r.host, {"path": r.path, "text": r.text, "verdict": r.verdict}) for r in host_rules], "path:string,text:string,verdict:string")
    patterns = _index(spark, [(rarest[r.name], {"rank": k, "name": r.name, "verdict": r.verdict, "regex": r.regex}) for k, r in enumerate(pattern_rules)], "rank:int,name:string,verdict:string,regex:string")

    url = F.col("url")
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(_fetch(hosts, suffixes), lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["text"]).alias("len"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    candidates = _fetch(patterns, url_tokens(url))
    lowered = F.lower(F.coalesce(url, F.lit("")))
    hit = F.array_sort(F.transform(F.filter(F.col("_candidates"), lambda r: F.regexp_like(lowered, r["regex"])), lambda r: F.struct((r["verdict"] != "allow").alias("blocks"), r["rank"].alias("rank"), r["name"].alias("name"))))
    first = F.when(F.size("_hits") > 0, F.element_at("_hits", 1))
    return (
        pages.withColumns({"host": host_of(url), "path": path_of(url)})
        .withColumns({"_rule": longest, "_candidates": candidates})
        .withColumn("_hits", F.when(F.col("_rule").isNull(), hit).otherwise(F.array().cast("array<struct<blocks:boolean,rank:int,name:string>>")))
        .withColumns({
            "rule": F.col("_rule.text"),
            "verdict": F.coalesce(F.col("_rule.verdict"), F.when(first["blocks"], "block"), F.lit("allow")),
            "pattern": first["name"],
            "n_candidates": F.when(F.col("_rule").isNull(), F.size("_candidates")).otherwise(0),
        })
        .drop("_rule", "_candidates", "_hits")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


_PATTERN_SQL = "".join(f"WHEN regexp_matches(u, '{r.regex}') THEN '{r.name}' " for r in sorted(PATTERN_RULES, key=lambda r: r.verdict != "allow"))
_RULE_SQL = "".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}' " for r in sorted(HOST_RULES, key=lambda r: -len(r.text)))
_BLOCKS = ", ".join(f"'{r.text}'" for r in HOST_RULES if r.verdict == "block")
_ALLOWS = ", ".join(f"'{r.name}'" for r in PATTERN_RULES if r.verdict == "allow")

OP4_SQL = f"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), ruled AS (
  SELECT page_id, host, path, u, CASE {_RULE_SQL} ELSE NULL END AS rule FROM parts
), matched AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN NULL {_PATTERN_SQL} ELSE NULL END AS pattern FROM ruled
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern IS NULL OR pattern IN ({_ALLOWS}) THEN 'allow' ELSE 'block' END AS verdict,
       pattern
FROM matched
"""
