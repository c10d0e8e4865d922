"""Search strategies over one pool of candidates, and sweeps over their parameters.

A question's lists (nearest vectors; blocks by marker, entity tokens, strong terms, field
terms, any terms) are made once, from one lookup of all its terms and one pass over the
vectors, as long as the longest cell of the sweep needs. A strategy is which of those lists
it takes, how it cuts them and what it adds up: columns over the pool, so a table of
parameters crossed with the pool (bounded rows a question) evaluates all cells together.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.plans import broadcast_if_small, written
from corpusmill.operators import lexical_index as L
from corpusmill.operators import resolve, vectors

#: The names of the strategies. The three searches of nearest vectors are one here, exact.
ANN = ("ooc_ann_flat", "ooc_ann_hnsw", "ooc_ann_ivf_flat")
RERANKED = ("ooc_semantic_rerank_rescue", "ooc_semantic_cross_encoder_rescue")
STRATEGIES = (
    "ooc_full_scan", "ooc_marker_entity_pruned", *ANN, "ooc_ann_pruned_hybrid", "ooc_semantic_rescue_hybrid", "ooc_semantic_lexical_rescue",
    "ooc_semantic_rerank_rescue", "ooc_semantic_field_rescue", "ooc_semantic_cross_encoder_rescue",
)
ROLES = ("marker", "entity", "name", "all", "strong", "field")


@dataclass(frozen=True)
class Cell:
    """A strategy and its limits: candidates, results, nearest vectors, strong and field
    hits, what is scored again, and the blocks up to which the rescue scans all."""

    strategy: str
    cap: int = 200
    k: int = 10
    ann_k: int = 2000
    lexical_k: int = 5000
    rerank_k: int = 2000
    input_k: int = 1000
    output_k: int = 500
    scan_blocks: int = 10_000

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no strategy {self.strategy}")


def pool(index: L.Index, questions: DataFrame, cells: list[Cell]) -> DataFrame:
    """(qid, id, cos, ann_rank, and for each role its hits and rank, the numbers n_role of
    the question's rows in each list, marked) of all rows that any cell could use."""
    longest = max(max(c.cap, c.k, c.ann_k, c.rerank_k) for c in cells)
    limits = {"entity": longest, "all": longest} | dict.fromkeys(("name", "strong", "field"), max(max(c.lexical_k, c.k) for c in cells))
    terms = L.role_terms(questions)
    marked = L.tf_scores(index, terms.where("role = 'marker'")).select(F.lit("marker").alias("role"), "qid", "id", "score", F.lit(1).alias("rank"))
    best = L.best_tf(index, terms.where("role <> 'marker'"), max(limits.values()), ("role", "qid"))
    within = F.lit(False)
    for role, limit in limits.items():
        within = within | ((F.col("role") == role) & (F.col("rank") <= limit))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)

    asked = vectors.hashed_vectors(questions.select(F.col("qid").alias("id"), "text")).withColumnRenamed("id", "qid")
    rows = vectors.cosine_top_k(index.vectors(), asked, longest).select("qid", "id", F.col("rank").alias("ann_rank"), *[none(f"{r}{x}", "long") for r in ROLES for x in ("", "_rank")])
    for some in (marked, best.where(within)):
        of = lambda r, c: F.when(F.col("role") == r, F.col(c).cast("long"))
        rows = rows.unionByName(some.select("qid", "id", none("ann_rank", "int"), *[of(r, "score").alias(r) for r in ROLES], *[of(r, "rank").alias(f"{r}_rank") for r in ROLES]))
    one = rows.groupBy("qid", "id").agg(F.max("ann_rank").alias("ann_rank"), *[F.max(f"{r}{x}").alias(f"{r}{x}") for r in ROLES for x in ("", "_rank")])
    one = written(one, "pool-rows")
    counts = one.groupBy("qid").agg(*[F.count(f"{r}_rank").alias(f"n_{r}") for r in ROLES])
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = index.vectors().join(broadcast_if_small(one), "id").join(broadcast_if_small(asked.withColumnRenamed("v", "q")), "qid").withColumn("cos", F.round(dot / (1.0 + vectors.EPSILON), 6)).drop("v", "q")
    return scored.join(broadcast_if_small(counts.join(questions.select("qid", F.col("marker").isNotNull().alias("marked")), "qid")), "qid")


def _ranked(rows: DataFrame, flag: Column, by: Column, name: str) -> DataFrame:
    """A rank among the rows of a cell and question that have ``flag``."""
    order = Window.partitionBy("cell", "qid", "_flag").orderBy(F.col("_by").desc(), "id")
    return rows.withColumns({"_flag": F.coalesce(flag, F.lit(False)), "_by": by}).withColumn(name, F.when(F.col("_flag"), F.row_number().over(order))).drop("_flag", "_by")


def searched(index: L.Index, questions: DataFrame, cells: list[Cell]) -> DataFrame:
    """(cell, strategy, qid, rank, id, score, n_candidates): the k best of every cell (by
    place in ``cells``) and question (qid, text, entities, marker, fields, intent)."""
    spark = index.spark
    kinds = ", ".join(f"{f.name} {'string' if f.name == 'strategy' else 'int'}" for f in fields(Cell))
    table = spark.createDataFrame([(n, *asdict(c).values()) for n, c in enumerate(cells)], f"cell int, {kinds}")
    rows = written(pool(index, questions, cells), "pool").crossJoin(F.broadcast(table))  # a row per cell of the sweep
    is_ = lambda *names: F.col("strategy").isin(*[f"ooc_{n}" for n in names])
    within = lambda rank, n: F.coalesce(F.col(rank) <= n, F.lit(False))
    at_least_k = lambda name: F.greatest(name, "k")
    limit = F.greatest("cap", "k")
    listed = lambda role, n: F.when(within(f"{role}_rank", n), F.col(role))

    tiered = F.when(F.col("n_marker") > 0, F.col("marker")).when(F.col("n_entity") > 0, listed("entity", limit)).otherwise(listed("all", limit))
    n_tiered = F.when(F.col("n_marker") > 0, F.col("n_marker")).otherwise(F.least(limit, F.when(F.col("n_entity") > 0, F.col("n_entity")).otherwise(F.col("n_all"))))
    strong = F.when(F.col("n_name") > 0, listed("name", at_least_k("lexical_k"))).otherwise(listed("strong", at_least_k("lexical_k")))
    n_strong = F.when(F.col("n_name") > 0, F.col("n_name")).otherwise(F.col("n_strong"))
    enough = (F.col("marked") & (F.col("n_tiered") > 0)) | (F.col("n_tiered") >= F.least("k", "cap"))
    rows = rows.withColumns({"tiered": tiered, "n_tiered": n_tiered, "strong_tf": strong, "n_strong_tf": n_strong, "field_tf": listed("field", at_least_k("lexical_k"))}).withColumn("enough", enough)

    in_ann = (
        F.when(F.col("strategy").isin(*ANN) | (is_("ann_pruned_hybrid") & ~F.col("enough")), within("ann_rank", limit))
        .when(F.contains("strategy", F.lit("semantic")), within("ann_rank", at_least_k("ann_k"))).otherwise(False)
    )
    with_field = is_("semantic_field_rescue", "semantic_cross_encoder_rescue")
    rescued = is_("semantic_lexical_rescue", "semantic_field_rescue", "semantic_rerank_rescue", "semantic_cross_encoder_rescue")
    pruned = (
        F.when(is_("marker_entity_pruned", "ann_pruned_hybrid"), F.col("tiered")).when(is_("semantic_rescue_hybrid"), listed("all", at_least_k("rerank_k")))
        .when(with_field, F.greatest("strong_tf", "field_tf")).when(rescued, F.col("strong_tf"))
    )
    n_pruned = F.when(is_("marker_entity_pruned", "ann_pruned_hybrid"), F.col("n_tiered")).when(with_field, F.col("n_strong_tf") + F.col("n_field")).when(rescued, F.col("n_strong_tf")).otherwise(0)
    capped = lambda x: F.least(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(20.0))
    lexical = F.when(n_pruned > 0, pruned).when(F.col("strategy").isin(*ANN), None).otherwise(listed("all", limit))
    combined = F.round(F.when(F.col("in_ann"), F.col("cos")).otherwise(0.0) + 0.05 * capped(F.col("strong_tf")) + F.when(with_field, 0.03 * capped(F.col("field_tf"))).otherwise(0.0), 6)
    rows = rows.withColumn("in_ann", in_ann).withColumns({"pruned": pruned, "lexical": lexical, "combined": combined})

    merged = F.col("in_ann") | F.col("strong_tf").isNotNull() | (with_field & F.col("field_tf").isNotNull())
    rows = _ranked(rows, rescued & merged, F.col("combined"), "combined_rank")
    rows = _ranked(rows, is_("semantic_rescue_hybrid") & (F.col("in_ann") | F.col("pruned").isNotNull()), -F.col("id").cast("double"), "merged_rank")
    rows = rows.withColumn("score_again", F.when(F.col("strategy").isin(*RERANKED), within("combined_rank", F.when(is_("semantic_rerank_rescue"), at_least_k("rerank_k")).otherwise(at_least_k("input_k")))).otherwise(False))
    rows = _reranked(index, questions, rows) if any(c.strategy in RERANKED for c in cells) else rows.withColumn("again", F.lit(None).cast("double"))
    rows = _ranked(rows, F.col("again").isNotNull(), F.col("again"), "again_rank")
    again_limit = F.when(is_("semantic_rerank_rescue"), at_least_k("rerank_k")).otherwise(at_least_k("output_k"))
    rows = rows.withColumn("again", F.when(within("again_rank", again_limit), F.col("again")))

    scan = is_("full_scan") | (is_("semantic_rescue_hybrid") & (F.lit(index.n_blocks) <= F.col("scan_blocks")))
    candidate = (
        F.when(is_("marker_entity_pruned") | (is_("ann_pruned_hybrid") & F.col("enough")), F.col("tiered").isNotNull()).when(is_("semantic_rescue_hybrid"), within("merged_rank", at_least_k("rerank_k")))
        .when(F.col("strategy").isin(*RERANKED), F.col("again").isNotNull()).when(rescued, within("combined_rank", at_least_k("rerank_k"))).otherwise(F.col("in_ann"))
    )
    rows = _ranked(rows, candidate & ~scan, F.col("cos"), "dense_rank")
    dense = F.when(scan, within("ann_rank", F.col("cap"))).otherwise(within("dense_rank", F.col("cap")))
    marker_hit = F.col("marker").isNotNull()
    score = F.when(dense | F.col("in_ann"), F.col("cos")).otherwise(0.0) + 0.05 * capped(F.col("lexical")) + 0.05 * capped(F.col("pruned")) + 0.02 * F.coalesce("again", F.lit(0.0)) + F.when(marker_hit, 10.0).otherwise(0.0)
    found = rows.where(dense | F.col("in_ann") | F.col("lexical").isNotNull() | F.col("pruned").isNotNull() | F.col("again").isNotNull() | marker_hit)
    found = found.select("cell", "strategy", "qid", "id", "k", F.round(score, 6).alias("score")).withColumn("n_candidates", F.count("*").over(Window.partitionBy("cell", "qid")))
    order = Window.partitionBy("cell", "qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= k").select("cell", "strategy", "qid", "rank", "id", "score", "n_candidates")


def _reranked(index: L.Index, questions: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: the field reranker's score of those marked ``score_again``,
    whose texts are fetched, each once a question."""
    wanted = rows.where("score_again").select("qid", "id").distinct()
    texts = L.blocks_of(index, wanted).select("id", "text", *([F.col("source_file")] if "source_file" in index.blocks().columns else [F.lit("").alias("source_file")]))
    asked = questions.select("qid", F.coalesce(F.get("entities", F.lit(0)), F.lit("")).alias("_entity"), F.array_sort(F.coalesce("fields", F.array().cast("array<string>"))).alias("_fields"))
    out = None
    for row in asked.select("_fields").distinct().collect():  # a few sets of a few known fields
        own = wanted.join(broadcast_if_small(asked.where(F.col("_fields") == F.array(*map(F.lit, row[0])).cast("array<string>"))), "qid").join(texts, "id")
        some = own.select("qid", "id", resolve.field_score(F.col("text"), F.col("source_file"), F.col("_entity"), tuple(row[0])).alias("_score"))
        out = some if out is None else out.unionByName(some)
    if out is None:
        return rows.withColumn("again", F.lit(None).cast("double"))
    return rows.join(out, ["qid", "id"], "left").withColumn("again", F.when(F.col("score_again"), F.col("_score"))).drop("_score")
