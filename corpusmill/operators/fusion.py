"""Fusion of ranked lists: (qid, id, rank, score) rows from several retrievers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.global_order import ranked_globally

MISSING = 100_000
RRF_K = 60.0


def reciprocal_ranks(one: DataFrame, other: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: float = RRF_K, missing: int = MISSING) -> DataFrame:
    """(qid, id, score) over the union of two lists: the weighted sum of 1 / (k + rank); a
    list that doesn't have a row counts with rank ``missing``."""
    a = one.select("qid", "id", F.col("rank").alias("rank_a"))
    b = other.select("qid", "id", F.col("rank").alias("rank_b"))
    part = lambda w, r: F.lit(w) / (k + F.coalesce(F.col(r), F.lit(missing)))
    return a.join(b, ["qid", "id"], "outer").select("qid", "id", F.round(part(weights[0], "rank_a") + part(weights[1], "rank_b"), 9).alias("score"))


def full_reciprocal_ranks(dense: DataFrame, lexical: DataFrame, k: float = RRF_K) -> DataFrame:
    """(qid, id, dense_rank, lexical_rank, score) over all rows of ``dense`` (qid, id, score:
    every block for every query); ``lexical`` (qid, id, score) has the blocks that score
    there, the others follow by id. Ranks are global and start from 0."""
    both = dense.select("qid", "id", F.col("score").alias("_dense")).join(lexical.select("qid", "id", F.col("score").alias("_lexical")), ["qid", "id"], "left")
    rows = ranked_globally(both.na.fill(0.0, ["_lexical"]), ["qid"], [F.col("_dense").desc(), F.col("id")], "dense_rank", 0)
    rows = ranked_globally(rows.drop("_dense"), ["qid"], [F.col("_lexical").desc(), F.col("id")], "lexical_rank", 0)
    score = F.round(1.0 / (k + F.col("lexical_rank")) + 1.0 / (k + F.col("dense_rank")), 9)
    return rows.select("qid", "id", "dense_rank", "lexical_rank", score.alias("score"))


def entity_boost(score: Column, text: Column, entities: list[str], each: float = 0.3) -> Column:
    """``score`` plus a boost per entity that the text has between word boundaries or
    underscores."""
    for e in entities:
        score = score + F.when(F.regexp_like(F.lower(text), F.lit(rf"(?:\b|(?<=_))\Q{e.lower()}\E(?:\b|(?=_))")), each).otherwise(0.0)
    return score


def fused(dense: DataFrame, lexical: DataFrame, pruned: DataFrame, reranked: DataFrame, marked: DataFrame) -> DataFrame:
    """(qid, id, score): the best dense score, 0.05 per lexical and per pruned hit (20 at
    most each), 0.02 of the rerank score, and 10 for blocks with the marker."""
    named = [("dense", dense), ("lexical", lexical), ("pruned", pruned), ("rerank", reranked), ("marker", marked)]
    rows = None
    for source, df in named:
        some = df.select("qid", "id", F.lit(source).alias("source"), F.col("score").cast("double").alias("s"))
        rows = some if rows is None else rows.unionByName(some)
    of = lambda source, f=F.max: F.coalesce(f(F.when(F.col("source") == source, F.col("s"))), F.lit(0.0))
    score = of("dense") + 0.05 * F.least(of("lexical"), F.lit(20.0)) + 0.05 * F.least(of("pruned"), F.lit(20.0)) + 0.02 * of("rerank") + F.when(of("marker") > 0, 10.0).otherwise(0.0)
    return rows.groupBy("qid", "id").agg(F.round(score, 6).alias("score"))


def candidate_union(ann: DataFrame, strong: DataFrame, field: DataFrame) -> DataFrame:
    """(qid, id, score): the best ANN score plus 0.05 per strong and 0.03 per field hit, 20
    at most each."""
    rows = (
        ann.select("qid", "id", F.col("score").cast("double").alias("ann"), F.lit(0.0).alias("strong"), F.lit(0.0).alias("field"))
        .unionByName(strong.select("qid", "id", F.lit(0.0).alias("ann"), F.least(F.col("score").cast("double"), F.lit(20.0)).alias("strong"), F.lit(0.0).alias("field")))
        .unionByName(field.select("qid", "id", F.lit(0.0).alias("ann"), F.lit(0.0).alias("strong"), F.least(F.col("score").cast("double"), F.lit(20.0)).alias("field")))
    )
    return rows.groupBy("qid", "id").agg(F.round(F.max("ann") + 0.05 * F.sum("strong") + 0.03 * F.sum("field"), 6).alias("score"))


def document_scores(rows: DataFrame) -> DataFrame:
    """(qid, doc, sum, max, top3) of scored sentences (qid, doc, score, doc_rank), in one
    aggregate; scores are six-digit numbers, and so are these."""
    whole = rows.withColumn("s", F.round(F.col("score") * 1_000_000).cast("long"))  # sums in any order are equal
    n, top = F.count_if(F.col("doc_rank") <= 3), F.sum(F.when(F.col("doc_rank") <= 3, F.col("s")))
    ways = {"sum": F.sum("s"), "max": F.max("s"), "top3": F.floor((2 * top + n) / (2 * n))}
    return whole.groupBy("qid", "doc").agg(*[(x / F.lit(1e6)).alias(how) for how, x in ways.items()])


def min_max(df: DataFrame, column: str, by: str = "qid") -> Column:
    """A column scaled to 0..1 within ``by``; 1 where all are equal."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low + 1e-9)).otherwise(1.0)
