"""Contexts of fixed-width blocks, selections of equal size from them, and what is lost when
only a selection is read.

Rows are (group, id): blocks of a context. Nothing gathers a context in a task: places are
ranges with prefix sums, and what is kept of a context is counted, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.global_order import ranked_globally

#: Tokens of a block.
WIDTH = 128
#: Bytes of keys and values of a token: layers, heads, head size, two of them, bytes each.
KV_BYTES = 24 * 2 * 64 * 2 * 2
MODES = ("full", "visibility", "random", "bm25")
# The gates and their targets, in percent.
TARGETS = {
    "gold_recall": 99.0, "exact_match": 95.0, "numeric_preservation": 99.0, "kv_reduction": 60.0,
    "token_reduction": 60.0, "random_gap": 20.0, "bm25_gap": 0.0, "contradiction": 95.0,
}


def laid_out(blocks: DataFrame, width: int = WIDTH, start: int = 0, pad: str = "\n") -> DataFrame:
    """Blocks (group, id, tokens) cut or filled up with ``pad`` to ``width`` tokens, in the
    order of their ids: (group, id, block_id, token_start, token_end, tokens, n_padded,
    n_cut). ``start`` tokens stand before a context's first block. Null tokens: none."""
    own = F.coalesce("tokens", F.array().cast("array<string>"))
    exact = F.slice(F.concat(own, F.array_repeat(F.lit(pad), width)), 1, width)
    sized = blocks.select("group", "id", exact.alias("tokens"), F.greatest(F.lit(0), width - F.size(own)).alias("n_padded"), F.greatest(F.lit(0), F.size(own) - width).alias("n_cut"))
    placed = ranked_globally(sized, ["group"], [F.col("id")], "block_id", start=0)
    first = F.col("block_id") * width + start
    return placed.withColumns({"token_start": first, "token_end": first + width})


def same_size(blocks: DataFrame, seed: str = "42") -> DataFrame:
    """(group, mode, id) of blocks (group, id, visible, score): all of a context, the visible
    ones, and as many by hash of seed, context and block, and by score (null: 0, ties by
    id). A null ``visible`` is false."""
    drawn = F.sha2(F.concat_ws("|", F.lit(seed), F.col("group").cast("string"), F.col("id").cast("string")), 256)
    rows = blocks.select("group", "id", F.coalesce("visible", F.lit(False)).alias("visible"), F.coalesce("score", F.lit(0.0)).alias("score"), drawn.alias("drawn"))
    sizes = rows.groupBy(F.col("group").alias("_of")).agg(F.count_if("visible").alias("n"))
    rows = ranked_globally(rows, ["group"], [F.col("score").desc(), F.col("id")], "by_score")
    rows = ranked_globally(rows, ["group"], [F.col("drawn"), F.col("id")], "by_draw")
    chosen = {"full": F.lit(True), "visibility": F.col("visible"), "random": F.col("by_draw") <= F.col("n"), "bm25": F.col("by_score") <= F.col("n")}
    modes = F.array_compact(F.array(*[F.when(chosen[m], m) for m in MODES]))
    return rows.join(sizes, F.col("group").eqNullSafe(F.col("_of"))).select("group", F.explode(modes).alias("mode"), "id")


def judged(kept: DataFrame, blocks: DataFrame, samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Each context's run in each mode.

    ``kept``: (group, mode, id); ``blocks``: (group, id, n_tokens, gold, deprecated);
    ``samples``: (group, category, expected, stale); ``answers``: (group, mode, answer). A
    mode that keeps no block has an answer but no tokens. Recall holds if every gold block
    is kept; a deprecated one that is kept is a wrong retention. In category C an answer
    that holds the ``stale`` text is untrue even if it matches.
    """
    flags = blocks.select("group", "id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("gold", "deprecated")])
    totals = flags.groupBy("group").agg(F.count("*").alias("total_blocks"), F.count_if("gold").alias("n_gold"), F.count_if("deprecated").alias("n_deprecated"))
    read = kept.join(flags, ["group", "id"]).groupBy("group", "mode").agg(
        F.count("*").alias("kept_blocks"), F.sum("n_tokens").alias("input_tokens"), F.count_if("gold").alias("gold_kept"), F.count_if("deprecated").alias("wrong_kept"),
    )
    rows = answers.join(samples, "group").join(totals, "group").join(read, ["group", "mode"], "left").fillna(0, ["kept_blocks", "input_tokens", "gold_kept", "wrong_kept"])
    answer, expected = F.coalesce("answer", F.lit("")), F.coalesce("expected", F.lit(""))
    match = (T.bare_answer(expected) != "") & T.contained_match(answer, expected)
    untrue = (F.col("category") == "C") & (F.col("n_deprecated") > 0) & F.contains(answer, F.col("stale"))
    return rows.select(
        "group", "mode", "category", match.alias("exact_match"), T.numbers_kept(answer, expected).alias("numeric_preservation"),
        (F.col("gold_kept") == F.col("n_gold")).alias("gold_recall"), (F.col("wrong_kept") > 0).alias("wrong_retention"),
        (match & ~F.coalesce(untrue, F.lit(False))).alias("active_truth"), "input_tokens", (F.col("input_tokens") * KV_BYTES).alias("kv_bytes"), "kept_blocks", "total_blocks",
    )


def gates(runs: DataFrame) -> DataFrame:
    """(gate, value, target, status) of judged runs, all modes in one aggregate: a row per
    gate and one for all of them. Without runs of category C contradiction is 100; any
    other figure without runs fails."""
    of = lambda mode, value: F.avg(F.when(F.col("mode") == mode, value))
    share = lambda mode, flag: of(mode, F.col(flag).cast("double")) * 100
    in_c = F.when(F.col("category") == "C", F.col("active_truth").cast("double"))
    left = F.when(F.col("total_blocks") > 0, 1 - F.col("kept_blocks") / F.col("total_blocks"))
    tokens = {m: of(m, F.col("input_tokens")) for m in ("full", "visibility")}
    values: dict[str, Column] = {
        "gold_recall": share("visibility", "gold_recall"), "exact_match": share("visibility", "exact_match"),
        "numeric_preservation": share("visibility", "numeric_preservation"), "kv_reduction": of("visibility", left) * 100,
        "token_reduction": F.when(tokens["full"] > 0, (1 - tokens["visibility"] / tokens["full"]) * 100),
        "random_gap": share("visibility", "exact_match") - share("random", "exact_match"), "bm25_gap": share("visibility", "exact_match") - share("bm25", "exact_match"),
        "contradiction": F.coalesce(of("visibility", in_c) * 100, F.lit(100.0)),
    }
    one = runs.agg(*[F.round(v, 6).alias(g) for g, v in values.items()])
    passed = lambda g: F.coalesce(F.col(g) >= TARGETS[g], F.lit(False))
    status = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    every = passed("gold_recall")
    for g in list(TARGETS)[1:]:
        every = every & passed(g)
    lines = [F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(t).alias("target"), status(passed(g)).alias("status")) for g, t in TARGETS.items()]
    lines.append(F.struct(F.lit("overall").alias("gate"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("target"), status(every).alias("status")))
    return one.select(F.explode(F.array(*lines)).alias("line")).select("line.*")
