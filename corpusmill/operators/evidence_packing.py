"""Sentences packed under a token budget: scoring, greedy filling, rescue, neighbours.

Every question's candidates are a bounded list (what retrieval returns for it), folded
in one ``aggregate`` per question: sentences that don't fit are skipped, not the end, so
a running sum would not do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T
from corpusmill.functions.plans import broadcast_if_small, written

BUDGET, SENTENCES, PER_DOC, RRF_K = 512, 10, 4, 60.0
POINTING = ("this", "these", "they", "it", "such")
CONNECTING = ("however", "therefore", "additionally", "furthermore")
#: Features of a question that packed text should hold, with their weight in a rescue.
RESCUE = {"numbers": 3.0, "acronyms": 2.5, "names": 2.0, "dates": 2.0, "quoted": 1.5, "hyphenated": 1.5, "content": 1.0}


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def scored(rows: DataFrame) -> DataFrame:
    """Candidates (qid, question, id, doc, text, bm25_rank, dense_rank, block_rank: ranks
    from 0) with score, n_tokens and whether the distractor filter keeps them."""
    q, s = T.feature_sets(F.col("question")), T.feature_sets(F.col("text"))
    n = F.size(T.words(F.col("text")))
    bonus = _shared(q["tokens"], s["tokens"]) / F.greatest(F.size(q["tokens"]), F.lit(1)) * 0.005
    for name, worth in (("numbers", 0.005), ("acronyms", 0.003), ("names", 0.002)):
        bonus = bonus + F.when(_shared(q[name], s[name]) > 0, worth).otherwise(0.0)
    ranks = 1.0 / (RRF_K + F.col("bm25_rank")) + 1.0 / (RRF_K + F.col("dense_rank")) + 0.5 / (RRF_K + F.col("block_rank"))
    score = F.round(ranks + bonus - F.greatest(F.lit(0.0), (n - 60) * 0.0001), 9)
    overlap = sum((_shared(q[k], s[k]) for k in ("names", "numbers", "acronyms", "dates")), _shared(q["tokens"], s["tokens"]))
    return rows.withColumns({"score": score, "n_tokens": F.greatest(F.lit(1), n)}).withColumn("kept", (overlap > 0) | (F.col("score") >= 0.015))


def _fold(items: Column, start: Column, budget: int, most: int, per_doc: int | None) -> Column:
    """Takes items (key, id, doc, n_tokens, text, ...) in order while they fit."""

    def step(state: Column, x: Column) -> Column:
        fits = (state["total"] + x["n_tokens"] <= budget) & (F.size(state["taken"]) < most)
        if per_doc is not None:
            fits = fits & (F.size(F.filter(state["taken"], lambda t: t["doc"] == x["doc"])) < per_doc)
        taken = F.struct(x["id"].alias("id"), x["doc"].alias("doc"), x["text"].alias("text"), x["n_tokens"].alias("n_tokens"), x["how"].alias("how"))
        return F.when(fits, F.struct((state["total"] + x["n_tokens"]).alias("total"), F.concat(state["taken"], F.array(taken)).alias("taken"))).otherwise(state)

    return F.aggregate(items, start, step)


_TAKEN = "array<struct<id:bigint,doc:bigint,text:string,n_tokens:int,how:string>>"


def packed(rows: DataFrame, budget: int = BUDGET, most: int = SENTENCES, per_doc: int = PER_DOC) -> DataFrame:
    """(qid, question, total, taken, items) of scored candidates, best score first, ties
    to the smaller id; ``items`` are all candidates in order of id."""
    item = F.struct((-F.col("score")).alias("key"), F.col("id").cast("long").alias("id"), F.col("doc").cast("long").alias("doc"), F.col("n_tokens").cast("int").alias("n_tokens"), "text", F.lit("packed").alias("how"), "kept", "block_rank")
    lists = rows.groupBy("qid", "question").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("total"), F.array().cast(_TAKEN).alias("taken"))
    state = _fold(F.filter("items", lambda x: x["kept"]), start, budget, most, per_doc)
    return lists.withColumn("state", state).select("qid", "question", F.col("state.total").alias("total"), F.col("state.taken").alias("taken"), "items")


def rescued(rows: DataFrame, budget: int = BUDGET, most: int = SENTENCES) -> DataFrame:
    """``packed`` rows, with candidates added that hold features of the question which the
    packed text lacks; neither the filter nor the cap per document applies to them."""
    text = F.array_join(F.transform("taken", lambda t: t["text"]), " ")
    q, have = T.feature_sets(F.col("question")), T.feature_sets(text)
    have["content"] = have["tokens"]
    rows = rows.withColumns({f"_{k}": F.array_except(q[k], have[k]) for k in RESCUE})
    lacking = F.lit(False)
    for k in RESCUE:
        lacking = lacking | (F.size(f"_{k}") > (F.size(q["content"]) * 0.3 if k == "content" else F.lit(0)))

    def worth(x: Column) -> Column:
        s = T.feature_sets(x["text"])
        s["content"] = s["tokens"]
        total = 0.5 / (1.0 + x["block_rank"]) - F.greatest(F.lit(0.0), (x["n_tokens"] - 60) * 0.0001)
        for k, w in RESCUE.items():
            total = total + w * _shared(s[k], F.col(f"_{k}"))
        return F.round(total, 9)

    ids = F.transform("taken", lambda t: t["id"])
    free = F.filter("items", lambda x: ~F.array_contains(ids, x["id"]))
    priced = F.transform(free, lambda x: F.struct((-worth(x)).alias("key"), x["id"].alias("id"), x["doc"].alias("doc"), x["n_tokens"].alias("n_tokens"), x["text"].alias("text"), F.lit("rescued").alias("how")))
    more = F.array_sort(F.filter(priced, lambda x: x["key"] < 0))
    state = _fold(more, F.struct("total", "taken"), budget, most, None)
    rows = rows.withColumn("state", F.when(lacking & (F.col("total") < budget), state).otherwise(F.struct("total", "taken")))
    return rows.select("qid", "question", F.col("state.total").alias("total"), F.col("state.taken").alias("taken"))


def neighbours(sentences: DataFrame) -> DataFrame:
    """Sentences (doc, sent, id, text) with the ids and texts before and after."""
    w = Window.partitionBy("doc").orderBy("sent")
    return sentences.select(
        "id", "text", F.lag("id").over(w).alias("before_id"), F.lag("text").over(w).alias("before"), F.lead("id").over(w).alias("after_id"), F.lead("text").over(w).alias("after"),
    )


def needs_context(text: Column) -> Column:
    """Short, pointing or connecting sentences."""
    tokens = T.lower_words(text)
    starts = F.lit(False)
    for c in CONNECTING:
        starts = starts | F.startswith(F.lower(text), F.lit(c))
    return (F.size(tokens) < 10) | F.arrays_overlap(tokens, F.array(*map(F.lit, POINTING))) | starts


def expanded(rows: DataFrame, sentences: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, total, ids): packed ids with neighbours of sentences that need context, added
    in packed order while they fit."""
    rows = written(rows, "packed")  # a row a question, read twice
    taken = rows.select("qid", "total", F.posexplode("taken").alias("at", "t")).select("qid", "total", "at", F.col("t.id").alias("id"), F.col("t.text").alias("text"))
    packed_docs = rows.select(F.explode("taken.doc").alias("doc")).distinct()
    own = sentences.join(broadcast_if_small(packed_docs), "doc", "left_semi")
    beside = taken.join(neighbours(own).drop("text"), "id", "left")
    near = lambda i, t: F.struct(F.col(i).alias("id"), F.greatest(F.lit(1), F.size(T.words(F.col(t)))).alias("n"))
    found = F.filter(F.array(near("before_id", "before"), near("after_id", "after")), lambda x: x["id"].isNotNull())
    one = F.struct("at", "id", F.when(needs_context(F.col("text")), found).otherwise(F.array().cast("array<struct<id:bigint,n:int>>")).alias("near"))
    lists = beside.groupBy("qid", "total").agg(F.array_sort(F.collect_list(one)).alias("items"))
    ids = F.transform("items", lambda x: x["id"])

    def add(state: Column, n: Column) -> Column:
        fits = (state["total"] + n["n"] <= budget) & ~F.array_contains(state["ids"], n["id"])
        return F.when(fits, F.struct((state["total"] + n["n"]).alias("total"), F.concat(state["ids"], F.array(n["id"])).alias("ids"))).otherwise(state)

    start = F.struct("total", ids.alias("ids"))
    state = F.aggregate(F.flatten(F.transform("items", lambda x: x["near"])), start, add)
    return lists.withColumn("state", state).select("qid", F.col("state.total").alias("total"), F.col("state.ids").alias("ids"))
