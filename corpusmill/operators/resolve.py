"""Which candidates hold for a question: markers, look-alike names, superseded files,
unrelated blocks; and reranking by fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T
from corpusmill.operators import facts

# Terms of the field reranker.
FIELD_TERMS = {
    "owner": ("owner", "manager", "managed", "responsible"), "manager": ("owner", "manager", "managed", "responsible"),
    "budget": ("budget", "amount", "cost"), "project": ("project", "name"), "project_name": ("project", "name"),
}
NOISE_TERMS = ("background", "generic", "lure", "noise", "ordinary", "unrelated")
EVIDENCE_TERMS = ("evidence", "proof", "source", "budget", "owns", "managed")


def resolved(rows: DataFrame) -> DataFrame:
    """``rows`` of candidates with their question (qid, question, entities, intent, marker,
    block_id, text, source_file) as (qid, block_id, state): active, or why not. Rows that
    lack the question's marker are left out; a block is listed once per question.

    Entities are judged each against the same candidates: a block is obsolete if any
    entity that it names has a later one.
    """
    asked, said = F.lower("question"), F.lower("text")
    fits = (
        F.when(F.contains(asked, F.lit("budget")), T.contains_any(said, ("budget", "$")))
        .when(T.contains_any(asked, ("deadline", "date")), T.contains_any(said, ("deadline", "date", "completion"))).otherwise(F.lit(True))
    )
    names = F.array_distinct(F.concat("entities", F.transform("entities", T.base_name)))
    rows = rows.where(F.col("marker").isNull() | F.contains(said, F.lower("marker"))).withColumn("names", names)
    rows = rows.withColumn("near", F.filter("names", lambda e: F.contains(said, F.lower(e))))  # a pattern runs for names in the text alone
    rows = rows.withColumn("exact", F.filter("near", lambda e: T.mentions(F.col("text"), e)))
    alike = F.exists("near", lambda e: ~F.array_contains("exact", e) & (F.size(T.suffixes(F.col("text"), e)) > 0))
    aggregation = F.col("intent") == "aggregation"
    needs_name = (F.size("names") > 0) & ~(aggregation & F.col("marker").isNotNull())
    # from here on a candidate is what its text says of it: no shuffle carries texts
    rows = rows.select(
        "qid", "block_id", "source_file", "exact", alike.alias("alike"), aggregation.alias("aggregation"), (F.col("intent") == "comparison").alias("comparison"), needs_name.alias("needs_name"),
        fits.alias("fits"), T.date_parts(F.col("text")).alias("date"),
    ).dropDuplicates(["qid", "block_id"])
    named = rows.where(~F.col("alike") & ~F.col("aggregation")).select("qid", "block_id", "source_file", "date", F.explode("exact").alias("name"))
    judged = facts.superseded(named.withColumn("entity", F.struct("qid", "name")))
    obsolete = judged.where(F.col("reason").isNotNull()).select("qid", "block_id", F.lit(True).alias("obsolete")).distinct()
    rows = rows.join(obsolete, ["qid", "block_id"], "left")
    state = (
        F.when(F.col("alike"), "suffix_distractor").when(F.col("obsolete"), "obsolete")
        .when(F.col("needs_name") & (F.size("exact") == 0), "unrelated_entity").otherwise("active")
    )
    rows = rows.select("qid", "block_id", state.alias("state"), "comparison", "fits")
    active, fits = F.col("state") == "active", F.col("fits")
    any_fits = F.max(active & fits).over(Window.partitionBy("qid"))
    off_topic = active & F.col("comparison") & any_fits & ~fits
    return rows.select("qid", "block_id", F.when(off_topic, "off_topic").otherwise(F.col("state")).alias("state"))


def field_score(text: Column, path: Column, entity: Column, fields: tuple[str, ...]) -> Column:
    """A candidate's score for a question about ``fields`` of ``entity``: 8 if the text has
    the name, 3 for each token of it and 2 if one is within ten tokens of a field term,
    1.5 per field term, 0.8 per evidence term, less 3 per noise term."""
    lowered = F.lower(F.concat_ws(" ", text, path))
    tokens = T.index_tokens(lowered)
    terms = sorted({t for f in fields for t in FIELD_TERMS.get(f, (f,))})
    own = F.filter(T.index_tokens(F.regexp_replace(F.lower(entity), "project ", "")), lambda t: ~t.isin("project", "projects"))
    places = lambda wanted: F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(wanted, t), i)), lambda i: i.isNotNull())
    has = lambda words: sum((F.array_contains(tokens, w).cast("int") for w in words), F.lit(0))
    hits = F.size(F.filter(own, lambda t: F.array_contains(tokens, t)))
    wanted = F.array(*map(F.lit, terms))
    near = F.exists(places(own), lambda i: F.exists(places(wanted), lambda j: F.abs(i - j) <= 10))
    score = F.when(F.contains(lowered, F.lower(entity)), 8.0).otherwise(0.0) + hits * 3.0 + F.when((hits > 0) & near, 2.0).otherwise(0.0)
    return F.round(score + has(terms) * 1.5 + has(EVIDENCE_TERMS) * 0.8 - has(NOISE_TERMS) * 3.0, 6)
