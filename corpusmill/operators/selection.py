"""Selections and their evaluation: linking, tiers, retention, recall of ranked lists,
diagnosis of misses, context with gaps, mass over blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T
from corpusmill.functions.plans import broadcast_if_small, ranked

HOT, WARM = 16, 24


def linked_entities(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity) of the dictionary names (entity: words between single spaces) that a text
    (id, text) has as whole words, any case; a name inside a longer one that the text has
    too is left out. Runs of words of the names' lengths (the driver gets those) are
    looked up in the dictionary, so no pattern runs per text and name."""
    names = entities.select(F.lower("entity").alias("entity")).distinct()
    lengths = [r.n for r in names.select(F.size(F.split("entity", " ")).alias("n")).distinct().collect()]
    words = texts.select("id", T.lower_words(F.col("text")).alias("w"))
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " ")))
    runs = F.concat(*[F.coalesce(run(n), F.array().cast("array<string>")) for n in lengths]) if lengths else F.array().cast("array<string>")
    found = words.select("id", F.explode(F.array_distinct(runs)).alias("entity")).join(broadcast_if_small(names), "entity").select("id", "entity").distinct()
    longer = found.groupBy("id").agg(F.collect_list("entity").alias("all"))  # names of a bounded dictionary
    inside = F.exists("all", lambda x: (x != F.col("entity")) & F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), F.col("entity"), F.lit(" "))))
    return found.join(longer, "id").where(~inside).select("id", "entity")


def ranked_features(rows: DataFrame) -> DataFrame:
    """``rows`` (group, id, score) with the score's share of the group's largest, the
    relative position by id and what is left after it, the rank by score and its tier."""
    by = Window.partitionBy("group")
    place, n = F.row_number().over(by.orderBy("id")) - 1, F.count("*").over(by)
    rank = F.row_number().over(by.orderBy(F.col("score").desc(), "id"))
    top = F.max("score").over(by)
    return rows.select(
        "group", "id", F.round(F.when(top > 0, F.col("score") / top).otherwise(0.0), 9).alias("share"), F.round(place / n, 9).alias("position"),
        F.round((n - 1 - place) / n, 9).alias("recency"), rank.alias("rank"), F.when(rank <= HOT, "HOT").when(rank <= WARM, "WARM").otherwise("COLD").alias("tier"),
    )


def retained(rows: DataFrame, best: int, last: int, word: str) -> DataFrame:
    """``rows`` (group, id, text, score) with keep: among the ``best`` by score, among the
    ``last`` by id, or with ``word`` in the text."""
    by = Window.partitionBy("group")
    rank = F.row_number().over(by.orderBy(F.col("score").desc(), "id"))
    end = F.row_number().over(by.orderBy(F.col("id").desc()))
    return rows.select("group", "id", F.coalesce((rank <= best) | (end <= last) | F.contains(F.lower("text"), F.lit(word)), F.lit(False)).alias("keep"))


def restricted(rows: DataFrame, most: int = 5) -> DataFrame:
    """Of candidates (case, id, expected) the expected ones first, then the others, by id, at
    most ``most`` of a case, with their place."""
    return ranked(rows, ["case"], [F.col("expected").desc(), F.col("id")], "place").where(F.col("place") <= most)


def list_metrics(chosen: Column, gold: Column) -> dict[str, Column]:
    """Recall at 1, 3 and 5, precision at 5, coverage and share of irrelevant ones, in
    percent, of an ordered array of ids; 100 where nothing is gold (irrelevant: 0)."""
    hits = lambda k: F.size(F.array_intersect(F.slice(chosen, 1, k), gold))
    none, n = F.size(gold) == 0, F.size(gold)
    of = lambda x, y: F.round(F.when(y > 0, 100.0 * x / y).otherwise(0.0), 6)
    out = {f"recall_{k}": F.when(none, 100.0).otherwise(of(hits(k), n)) for k in (1, 3, 5)}
    out["precision_5"] = F.when(none, 100.0).otherwise(of(hits(5), F.least(F.lit(5), F.size(chosen))))
    out["coverage"] = F.when(none, 100.0).otherwise(of(F.size(F.array_intersect(chosen, gold)), n))
    out["irrelevant"] = F.when(none, 0.0).otherwise(of(F.size(F.array_except(chosen, gold)), F.size(chosen)))
    return out


def diagnosis(gold: Column, retrieved: Column, packed: Column, right: Column) -> Column:
    """Where an answer was lost: by retrieval, by packing, or after both."""
    lost = lambda kept: F.size(F.array_except(gold, kept)) > 0
    return F.when(right, "none").when(lost(retrieved), "retrieval").when(lost(packed), "packing").otherwise("answer")


def with_gaps(rows: DataFrame, mark: str = "[...]") -> DataFrame:
    """(group, context, n_gaps) of kept rows (group, id, text): texts in order of id, with
    ``mark`` where ids are left out between them."""
    before = F.lag("id").over(Window.partitionBy("group").orderBy("id"))
    gap = F.coalesce(F.col("id") != before + 1, F.lit(False))
    parts = rows.withColumn("gap", gap).withColumn("part", F.when(F.col("gap"), F.concat(F.lit(f"{mark}\n"), "text")).otherwise(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "part"))), lambda x: x["part"]), "\n")
    return parts.groupBy("group").agg(joined.alias("context"), F.count_if("gap").alias("n_gaps"))


def block_mass(blocks: DataFrame, weight: Callable[[Column], Column]) -> DataFrame:
    """(group, id, mass) of blocks (group, id, start, stop: places, stop excluded): the
    ``weight`` of the places inside, as a share of the group's blocks'. A block sums up its
    own places, which are spelled out nowhere."""
    places = F.sequence(F.col("start"), F.col("stop") - 1)
    of_block = F.when(F.col("stop") > F.col("start"), F.aggregate(places, F.lit(0.0), lambda x, p: x + weight(p))).otherwise(0.0)
    sums = blocks.select("group", "id", of_block.alias("sum"))
    total = F.sum("sum").over(Window.partitionBy("group"))
    return sums.select("group", "id", F.round(F.when(total > 0, F.col("sum") / total).otherwise(0.0), 9).alias("mass"))


def paired(records: DataFrame, one: str, other: str) -> DataFrame:
    """Records (key, mode, value) of two modes beside each other, by the key: means, the
    difference, and the share of the first that the second saves (percent)."""
    of = lambda m: F.avg(F.when(F.col("mode") == m, F.col("value")))
    both = records.where(F.col("mode").isin(one, other)).groupBy("key").agg(of(one).alias("one"), of(other).alias("other")).where("one IS NOT NULL AND other IS NOT NULL")
    saved = F.when(F.col("one") > 0, 100.0 * (F.col("one") - F.col("other")) / F.col("one")).otherwise(0.0)
    return both.select("key", *[F.round(c, 6).alias(c) for c in ("one", "other")], F.round(F.col("other") - F.col("one"), 6).alias("delta"), F.round(saved, 6).alias("saved"))


def id_gate(rows: DataFrame, key: str) -> DataFrame:
    """How many rows, ids and repeated ids; the gate fails on any repeated one. Ids are
    aggregated by value first, so that a hot one is a count per task."""
    counts = rows.groupBy(key).agg(F.count("*").alias("c"))
    out = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))
    return out.select("n", "n_distinct", (F.col("n") - F.col("n_distinct")).alias("n_repeated"), F.when(F.col("n") > F.col("n_distinct"), "FAIL").otherwise("PASS").alias("gate"))


def seeded(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of seed and key: the same ones for the same seed,
    however rows are partitioned."""
    hashed = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("hash", hashed).orderBy("hash", key).limit(n)
