"""Evaluation aggregates: recall, reciprocal ranks, rates, percentiles, gates, economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS, HIDDEN, BYTES = 24, 1024, 2


def recall_at(found: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per question of ``gold`` (qid, gold_group, id) whether the first k of ``found``
    (qid, id, rank) hold a row of every group, and 1 / rank of the first gold row."""
    hit = gold.join(found, ["qid", "id"], "left").groupBy("qid", "gold_group").agg(F.min("rank").alias("first"))
    recalls = [F.min(F.coalesce(F.col("first") <= k, F.lit(False))).alias(f"hit_{k}") for k in ks]
    return hit.groupBy("qid").agg(*recalls, F.coalesce(1.0 / F.min("first"), F.lit(0.0)).alias("rr"))


def percent(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")) * 100, 6)


def overlap_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per question the percentage of exact rows that were found."""
    hits = exact.join(found.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return exact.groupBy("qid").agg(F.count("*").alias("n")).join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.col("n") * 100).alias("recall"))


def latency(value: Column) -> list[Column]:
    """Mean, exact percentiles with linear interpolation, and the maximum."""
    out = [F.round(F.avg(value), 6).alias("mean")]
    out += [F.round(F.percentile(value, q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return [*out, F.max(value).alias("most")]


def economics(baseline: Column, actual: Column, output: Column, ttft: Column, decode: Column, input_price: float, output_price: float) -> dict[str, Column]:
    """Token, memory and cost figures of a call; negative inputs count as zero."""
    zero = lambda c: F.greatest(F.lit(0), c)
    baseline, actual, output = zero(baseline).cast("bigint"), zero(actual).cast("bigint"), zero(output).cast("bigint")
    ttft, decode = zero(ttft.cast("double")), zero(decode.cast("double"))
    avoided, total, per_token = zero(baseline - actual), ttft + decode, LAYERS * HIDDEN * 2 * BYTES
    rate = lambda n, ms: F.when(ms > 0, n / (ms / 1000.0)).otherwise(0.0)
    return {
        "avoided": avoided, "input_tps": rate(actual, ttft), "output_tps": rate(output, decode), "effective_tps": rate(baseline, total),
        "kv_bytes": actual * per_token, "kv_avoided": avoided * per_token,
        "cost": F.round(actual / 1_000_000.0 * input_price + output / 1_000_000.0 * output_price, 12), "avoided_cost": F.round(avoided / 1_000_000.0 * input_price, 12),
    }


def leak_reasons(id_: Column, path: Column) -> Column:
    """Why a question's id or path could give its answer away; empty if they don't."""
    opaque = F.regexp_like(id_, F.lit("^q_[0-9a-f]{16}$"))
    return F.array_compact(F.array(
        F.when(~opaque, "id_not_opaque"), F.when(F.contains(path, id_), "id_in_path"),
        F.when(~F.regexp_like(path, F.lit("^[a-z0-9_/.-]+$")), "path_not_plain"), F.when(F.regexp_like(F.lower(path), F.lit("gold|answer|expected")), "path_names_answer"),
    ))


def gate(passed: list[Column]) -> Column:
    """VALIDATING if all hold, QUALITY_ONLY if the first does, else NON_VALIDATING."""
    all_of = passed[0]
    for p in passed[1:]:
        all_of = all_of & p
    return F.when(all_of, "VALIDATING").when(passed[0], "QUALITY_ONLY").otherwise("NON_VALIDATING")
