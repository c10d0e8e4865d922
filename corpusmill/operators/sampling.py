"""Deterministic sampling, splitting off what is done, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.plans import broadcast_if_small, top_k, written


def hash_order(key: str, seed: int) -> F.Column:
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)


def stratified(df: DataFrame, by: str, key: str, each: int, seed: int = 42) -> DataFrame:
    """``each`` rows per stratum in hash order, fewer where a stratum has fewer."""
    return top_k(df, [by], [hash_order(key, seed), F.col(key)], each, "sample_rank")


def proportional(df: DataFrame, by: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """About ``total`` rows, each stratum by its share, one at least."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    share = sizes.join(F.broadcast(sizes.agg(F.sum("_n").alias("_all")))).select(F.col(by).alias("_by"), F.greatest(F.lit(1), F.round(F.lit(total) * F.col("_n") / F.col("_all"))).alias("_take"))
    ranked = top_k(df, [by], [hash_order(key, seed), F.col(key)], total, "sample_rank")
    return ranked.join(broadcast_if_small(share), ranked[by].eqNullSafe(share["_by"])).where("sample_rank <= _take").drop("_by", "_take")


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of a run: rows whose keys the output doesn't have."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def cached(asked: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """``asked`` (key, ...) with the value a cache (key, version, value) has for this
    version, and whether it hit."""
    current = cache.where(F.col("version") == version).select("key", "value")
    return asked.join(current, "key", "left").withColumn("hit", F.col("value").isNotNull())


def trimmed(rows: DataFrame, by: str, size: str, budget: int) -> DataFrame:
    """Per ``by`` how many rows (kept), largest ``size`` first, fit the budget together, one
    at least, and how many there are (n). Rows of one size are counted before the window
    orders them, so that it has a row per size, however many rows a group has; a null
    size counts as 0."""
    of_size = rows.select(by, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")).groupBy(by, "_size").agg(F.count("*").alias("_count"))
    before = F.sum(F.col("_size") * F.col("_count")).over(Window.partitionBy(by).orderBy(F.col("_size").desc())) - F.col("_size") * F.col("_count")
    room = F.greatest(F.lit(0), F.lit(budget) - F.col("_before"))
    fit = F.when(F.col("_before") > budget, F.lit(0)).when(F.col("_size") == 0, F.col("_count")).otherwise(F.least(F.col("_count"), F.floor(room / F.col("_size"))))
    sums = of_size.withColumn("_before", before).withColumn("_fit", fit.cast("long"))
    return sums.groupBy(by).agg(F.greatest(F.lit(1), F.sum("_fit")).alias("kept"), F.sum("_count").alias("n"))


def drawn_with_replacement(rows: DataFrame, key: str, weight: Column, n: int, seed: str) -> DataFrame:
    """(draw, and the columns of ``rows``): ``n`` draws, each of a row in proportion to its
    whole-number ``weight``, a row as often as it is drawn. Rows in the order of ``key`` (unique)
    own ranges of the weights' prefix sums, which are sums over partitions before and rows
    inside; a draw is a hash of seed and number modulo the total. Draws meet rows by bins
    of the sums, so the result doesn't depend on partitions. Rows of no weight are never drawn."""
    heavy = rows.withColumn("_w", F.coalesce(weight.cast("long"), F.lit(0))).where("_w > 0")
    dealt = heavy.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "weighted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.sum("_w").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))  # a row a partition
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy(key))
    ends = dealt.withColumn("_end", inside).join(F.broadcast(parts), "_part").withColumn("_end", F.col("_end") + F.col("_before"))
    total = dealt.agg(F.sum("_w")).first()[0]
    if not total or n < 1:
        return rows.select(F.lit(0).cast("long").alias("draw"), "*").limit(0)
    size = max(1, total // max(1, min(dealt.count(), 10_000_000)))
    lot = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")), 256), 1, 15), 16, 10).cast("long"), F.lit(total))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), lot.alias("_lot")).withColumn("_bin", F.floor(F.col("_lot") / size))
    spread = ends.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_end") - F.col("_w")) / size), F.floor((F.col("_end") - 1) / size))))
    met = draws.join(spread, "_bin").where((F.col("_lot") < F.col("_end")) & (F.col("_lot") >= F.col("_end") - F.col("_w")))
    return met.select("draw", *rows.columns)
