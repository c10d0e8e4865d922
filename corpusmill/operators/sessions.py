"""Sessions: turns folded in order, running figures along a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T

FOLLOW_UP = r"(?i)\b(and|also|too|its|their|that|those|same|previous|about it|what about)\b"


def planned(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, text) with the entities they name, those that are active
    after them (the last named), and how the turn would be searched."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    named = T.entity_candidates(F.col("text"))
    rows = turns.withColumn("named", named).withColumn("active", F.last(F.when(F.size("named") > 0, F.col("named")), ignorenulls=True).over(order))
    before = F.lag("active").over(order)
    kind = (
        F.when(T.reference_marker(F.col("text")).isNotNull(), "marker").when(F.size("named") > 0, "entity")
        .when((F.size(F.coalesce(before, F.array().cast("array<string>"))) > 0) & F.regexp_like("text", F.lit(FOLLOW_UP)), "follow_up").otherwise("semantic")
    )
    query = F.when(F.col("kind") == "follow_up", F.concat_ws(" ", F.transform("before", lambda e: F.concat(F.lit("Project "), e)), F.col("text"))).otherwise(F.col("text"))
    return rows.withColumns({"before": before, "kind": kind}).withColumn("query", query)


def folded(turns: DataFrame) -> DataFrame:
    """A row per conversation: its number of turns, the entities of the last turn that
    names any, all speakers in order of appearance, and words said."""
    rows = planned(turns)
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turn_count"), F.max_by("active", "turn").alias("active"), F.sum(F.size(T.words(F.col("text")))).alias("words"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])).alias("roles"),
    )


def switches(turns: DataFrame, topic: str) -> DataFrame:
    """Turns with the number of topic changes so far, and the distance to the first turn
    of the topic in the conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.coalesce((F.lag(topic).over(order) != F.col(topic)).cast("int"), F.lit(0))
    rows = turns.withColumn("_changed", changed).withColumn("first_seen", F.min("turn").over(Window.partitionBy("conv_id", topic)))
    return rows.withColumn("switches", F.sum("_changed").over(order)).withColumn("distance", F.col("turn") - F.col("first_seen")).drop("_changed")
