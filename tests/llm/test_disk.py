"""What the n-gram join and the pipeline's third stage leave and move on disk."""

import collections
import os
import random
import time

from pyspark.sql import functions as F
from test_operators import brute_components, near_copies

from corpusmill.llm import ngram_join
from corpusmill.llm.common import discard, marked, shared_dir, stored


def shuffled(spark):
    """Bytes of shuffle files on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(f"{d}/{f}") for top in dirs for d, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_") and os.path.exists(f"{d}/{f}"))


def settled(spark):
    spark._jvm.System.gc()
    before = None
    while before != (before := shuffled(spark)):
        time.sleep(0.5)
    return before


def long_rows(spark, n, start=0):
    rnd = random.Random(start)
    return spark.createDataFrame([(start + i, " ".join(f"{rnd.getrandbits(60):x}" for _ in range(200))) for i in range(n)], "doc_id long, text string")


def test_stored_tables_leave_no_shuffle_files(spark):
    before = settled(spark)
    rows = stored(spark.range(300_000).repartition(8, "id").groupBy("id").agg(F.count("*").alias("n")), "rows")
    time.sleep(1)
    assert shuffled(spark) <= before and rows.count() == 300_000


def test_the_join_leaves_little(spark):
    docs = stored(long_rows(spark, 400).unionByName(long_rows(spark, 100)), "docs")
    before, size = set(os.listdir(shared_dir(spark).removeprefix("file:"))), docs.count() * 200 * 8
    assert ngram_join.near_duplicates(docs).count() == 500
    new = [f"{shared_dir(spark).removeprefix('file:')}/{x}" for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before]
    left = sum(os.path.getsize(f"{d}/{f}") for top in new for d, _, names in os.walk(top) for f in names if f.startswith("part-"))
    assert left < size / 10  # no prefixes, no sets


def test_rounds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUND_TOKENS", 6000)
    monkeypatch.setattr(ngram_join, "ROUND_SETS", 30)
    rows = near_copies(0)
    rows += rows[:40]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_marked_rows(spark):
    rows = spark.range(40_000).select(F.col("id").alias("row"), F.when(F.col("id") % 10 > 0, F.xxhash64("id")).alias("key"))
    keys = stored(rows.where("row % 7 = 0"), "keys")
    exact = marked(rows, "row", keys, exact=True)
    assert exact.columns == ["row", "key", "_marked"] and exact.where("_marked <> (row % 7 = 0)").count() == 0
    found = marked(rows, "key", keys.where("key IS NOT NULL"))
    assert found.count() == 40_000 and found.where("NOT _marked AND row % 7 = 0 AND key IS NOT NULL").count() == 0
    assert found.where("_marked AND row % 7 > 0").count() < 4_000
    assert marked(rows, "key", keys.where("key = 0")).where("_marked").count() == 0


def test_keep_first_moves_no_text_that_stays(spark):
    docs = stored(long_rows(spark, 400).unionByName(long_rows(spark, 20)), "docs")
    before = settled(spark)
    kept = ngram_join.keep_first(spark, docs, "")
    time.sleep(1)
    between = settled(spark)
    kept.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - between < 400 * 200 * 8  # bytes of the texts, which don't shrink much
    assert between - before < 400 * 200 * 8 and kept.count() == kept.select("doc_id").distinct().count() == 400
    discard(spark, docs)
