"""Features of a context's blocks for its question, and forests that learn from them which
blocks to keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import written
from corpusmill.operators import retrieval, vectors
from corpusmill.operators.global_order import ranked_globally

# Features, those of each ablation, and the forest's size.
FEATURES = ("bm25", "semantic", "position", "recency", "entity", "number", "active")
ABLATIONS = {"full": FEATURES, "no_position": ("bm25", "semantic", "entity", "number", "active"), "semantic_only": ("semantic", "entity")}
TREES, DEPTH = 100, 8


def block_features(blocks: DataFrame, samples: DataFrame) -> DataFrame:
    """(group, id, the seven FEATURES) of blocks (group, id, text; unique by group and id)
    for ``samples`` (group, question, entity).

    Scores by terms count in shares of the context's best; places and numbers of blocks
    come from ranges and counts, so that no context is gathered in a task. Null texts and
    questions are empty, a null or empty entity is never matched.
    """
    scores = retrieval.bm25_case_scores(blocks.select(F.col("group").alias("case"), "id", "text"), samples.select(F.col("group").alias("case"), F.col("question").alias("text")))
    scores = written(scores.select(F.col("case").alias("group"), "id", "score"), "scores")
    best = scores.groupBy("group").agg(F.max("score").alias("best"))
    sizes = blocks.groupBy("group").agg(F.count("*").alias("n"))
    rows = ranked_globally(blocks.select("group", "id", "text"), ["group"], [F.col("id")], "place", start=0)
    rows = rows.join(samples.select("group", "question", "entity"), "group").join(sizes, "group").join(best, "group", "left").join(scores, ["group", "id"], "left")
    text, question = F.coalesce("text", F.lit("")), F.coalesce("question", F.lit(""))
    asked = F.array_distinct(T.matches(question, r"\d+"))
    both = F.size(F.array_intersect(asked, T.matches(text, r"\d+")))
    values = {
        "bm25": F.when(F.col("best") > 0, F.coalesce("score", F.lit(0.0)) / F.col("best")).otherwise(0.0), "semantic": vectors.hashed_cosine(text, question),
        "position": F.col("place") / F.col("n"), "recency": (F.col("n") - 1 - F.col("place")) / F.col("n"),
        "entity": F.coalesce((F.col("entity") != "") & T.mentions(text, F.col("entity")), F.lit(False)).cast("double"), "number": both / F.greatest(F.lit(1), F.size(asked)),
        "active": F.contains(F.lower(text), F.lit("active")).cast("double"),
    }
    return rows.select("group", "id", *[F.round(values[f], 6).alias(f) for f in FEATURES])


def forests(rows: DataFrame, ablations: dict[str, tuple[str, ...]] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> DataFrame:
    """(ablation, n_train, n_test, accuracy, precision, recall, f1) of forests that learn
    ``keep`` from ``rows`` (features, keep, is_test): a row per ablation, over the rows
    with is_test. Classes weigh the same; labels of one class only are an error."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = written(rows.select(*FEATURES, F.col("keep").cast("double").alias("label"), "is_test"), "features")
    counts = {(r.label, r.is_test): r["count"] for r in rows.groupBy("label", "is_test").count().collect()}  # four rows at most
    train = {y: counts.get((y, False), 0) for y in (0.0, 1.0)}
    if not all(train.values()):
        raise ValueError("a forest needs kept and dropped blocks to learn from")
    weight = reduce(lambda c, y: c.when(F.col("label") == y, sum(train.values()) / (2 * train[y])), (0.0, 1.0), F)
    n_test, out = sum(n for (_, test), n in counts.items() if test), None
    for name, features in (ablations or ABLATIONS).items():
        made = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.withColumn("weight", weight))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed).fit(made.where(~F.col("is_test")))
        told = forest.transform(made.where("is_test"))
        n = {k: F.count_if(c) for k, c in {"hit": (F.col("label") == 1) & (F.col("prediction") == 1), "said": F.col("prediction") == 1, "true": F.col("label") == 1, "right": F.col("label") == F.col("prediction")}.items()}
        share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
        line = told.agg(share(n["right"], F.count("*")).alias("accuracy"), share(n["hit"], n["said"]).alias("precision"), share(n["hit"], n["true"]).alias("recall"), share(2 * n["hit"], n["said"] + n["true"]).alias("f1"))
        line = line.select(F.lit(name).alias("ablation"), F.lit(sum(train.values())).cast("long").alias("n_train"), F.lit(n_test).cast("long").alias("n_test"), "*")
        out = line if out is None else out.unionByName(line)
    return out
