"""Lexical retrieval: postings, term-frequency lookup, BM25, tiers of candidates.

Blocks are rows of (id, text), queries rows of (qid, text). Query terms are the small
side: they are broadcast if counted small, so that of the corpus only occurrences of
query terms are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import BROADCAST_ROWS, broadcast_if_small, top_k

K1, B = 1.5, 0.75
Tokens = Callable[[Column], Column]


def postings(blocks: DataFrame, tokens: Tokens = T.index_tokens) -> DataFrame:
    """(term, id, tf) of all blocks."""
    return blocks.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def term_stats(blocks: DataFrame, tokens: Tokens = T.index_tokens) -> DataFrame:
    """(term, df, cf)."""
    return postings(blocks, tokens).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, tokens: Tokens = T.index_tokens) -> DataFrame:
    """(qid, term, qtf)."""
    return queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def strong_terms(terms: DataFrame) -> DataFrame:
    """Without weak and short terms."""
    return terms.where((F.length("term") >= 5) & ~F.col("term").isin(*T.WEAK_TERMS))


def matching_postings(blocks: DataFrame, terms: DataFrame, tokens: Tokens) -> DataFrame:
    """Postings of the query terms alone: (term, id, tf)."""
    wanted = broadcast_if_small(terms.select("term").distinct())
    hits = blocks.select("id", F.explode(tokens(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    return hits.groupBy("term", "id").agg(F.count("*").alias("tf"))


def tf_scores(blocks: DataFrame, terms: DataFrame, tokens: Tokens = T.index_tokens) -> DataFrame:
    """(qid, id, score): the sum of term frequencies of a query's distinct terms."""
    found = matching_postings(blocks, terms, tokens)
    return found.join(broadcast_if_small(terms.select("qid", "term").distinct()), "term").groupBy("qid", "id").agg(F.sum("tf").alias("score"))


def _weighed(blocks: DataFrame, queries: DataFrame, tokens: Tokens) -> tuple[DataFrame, DataFrame, DataFrame, Callable]:
    """Query terms (qid, term, qtf), their occurrences (id, dl, term, tf), the corpus (n, avgdl),
    and a broadcast hint if the query terms are counted small. The corpus is tokenised for
    its lengths and once for the occurrences, which plans read from one exchange."""
    terms = query_terms(queries, tokens)
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)
    sized = blocks.select("id", tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    corpus = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    each = sized.select("id", "dl", F.explode("w").alias("term")).join(hint(terms.select("term").distinct()), "term", "left_semi")
    return terms, each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")), corpus, hint


def summed(hits: DataFrame) -> DataFrame:
    """BM25 of a query's terms in blocks (qid, id, qtf, idf, tf, dl, avgdl)."""
    norm = F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl"))
    score = F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1.0) / norm)
    return hits.groupBy("qid", "id").agg(F.round(score, 6).alias("score"))


def bm25_scores(blocks: DataFrame, queries: DataFrame, tokens: Tokens = T.lower_words) -> DataFrame:
    """(qid, id, score) by BM25; a term repeated in the query counts repeatedly. Scores
    are rounded to six digits, so that sums in any order rank alike."""
    terms, hits, corpus, hint = _weighed(blocks, queries, tokens)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(corpus)).select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    return summed(hits.join(hint(terms.join(hint(idf), "term")), "term"))  # a row per query term at most


def bm25_okapi_scores(blocks: DataFrame, queries: DataFrame, tokens: Tokens = T.lower_words, epsilon: float = 0.25) -> DataFrame:
    """As ``bm25_scores`` with the older inverse document frequency, which is negative for
    terms of more than half of the blocks: these get ``epsilon`` times the mean over all
    terms of the corpus."""
    terms, hits, corpus, hint = _weighed(blocks, queries, tokens)
    df = blocks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(corpus)).select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    used = idf.join(hint(terms.select("term").distinct()), "term", "left_semi").join(F.broadcast(mean))
    idf = used.select("term", "avgdl", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    return summed(hits.join(hint(terms.join(hint(idf), "term")), "term"))


def bm25_case_scores(units: DataFrame, questions: DataFrame, tokens: Tokens = T.lower_words) -> DataFrame:
    """(case, id, score): BM25 of units (case, id, text) for the question of their case
    (case, text) against the case's own units: numbers, lengths and document frequencies
    are aggregates by case and by case and term, so that no case is gathered in a task."""
    sized = units.select("case", "id", tokens(F.col("text")).alias("w")).withColumn("dl", F.coalesce(F.size("w"), F.lit(0)))
    of_case = sized.groupBy("case").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = questions.select("case", F.explode(tokens(F.col("text"))).alias("term")).groupBy("case", "term").agg(F.count("*").alias("qtf"))
    words = sized.select("case", "id", "dl", F.explode("w").alias("term")).join(asked, ["case", "term"])
    hits = words.groupBy("case", "term", "id", "dl", "qtf").agg(F.count("*").alias("tf"))
    df = hits.groupBy("case", "term").agg(F.count("*").alias("df"))
    rows = hits.join(df, ["case", "term"]).join(of_case, "case")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return summed(rows.withColumn("idf", idf).withColumn("qid", F.col("case"))).withColumnRenamed("qid", "case")


def best(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, ["qid"], [F.col("score").desc(), F.col("id")], k)


def tiered_candidates(tiers: list[DataFrame], limits: list[int | None]) -> DataFrame:
    """(qid, id, score, tier): each query's rows of the first tier that has any, the best
    ``limits`` of them."""
    rows = None
    for n, (scores, limit) in enumerate(zip(tiers, limits), 1):
        some = best(scores, limit).drop("rank") if limit else scores
        some = some.select("qid", "id", F.col("score").cast("double").alias("score"), F.lit(n).alias("tier"))
        rows = some if rows is None else rows.unionByName(some)
    first = rows.groupBy("qid").agg(F.min("tier").alias("tier"))
    return rows.join(first, ["qid", "tier"]).select("qid", "id", "score", "tier")
