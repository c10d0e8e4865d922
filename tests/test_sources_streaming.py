from corpusmill.operators import sessions as batch
from corpusmill.sources import tables
from corpusmill.streaming import sessions


def test_texts_to_index(spark, tmp_path):
    (tmp_path / "in/reports").mkdir(parents=True)
    (tmp_path / "in/reports/a.txt").write_text("  alpha beta \n\n" + "word " * 130)
    (tmp_path / "in/b.txt").write_text("beta")
    texts = tables.read_texts(spark, f"{tmp_path}/in")
    assert {(r.path, r.category) for r in texts.collect()} == {("reports/a.txt", "reports"), ("b.txt", "unknown")}
    rows = tables.blocks(texts)
    assert sorted((r.source_file, r.chunk_index, r.token_count) for r in rows.collect()) == [("b.txt", 0, 1), ("reports/a.txt", 0, 128), ("reports/a.txt", 1, 4)]


def test_code_files(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x.py").write_text("no")
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.bin").write_text("no")
    (tmp_path / "c.py").write_text("#" * 90_000)
    assert [r.text for r in tables.read_code(spark, str(tmp_path)).collect()] == ["x = 1"]


def test_session_stream(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, 1, "assistant", "c"), (1, 2, "user", "d"), (2, 0, "system", None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = sessions.folded_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("folded").orderBy("turn_count").collect():
        last[r.conv_id] = (r.turn_count, r.words, r.roles)
    assert last == {1: (3, 4, "user,assistant"), 2: (1, 0, "system")}


def test_session_stream_equals_the_batch_fold(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    turns = [(c, t, ("system", "user", "assistant")[(t * 7 + c) % 3], f"word {t} " + ("of Alice Martin" if t % 4 == c % 4 else "and NEPTUNE" if t % 5 == 0 else "")) for c in range(6) for t in range(12)]
    shuffled = sorted(turns, key=lambda r: (r[0] * 31 + r[1] * 17) % 23)
    for part in (shuffled[:30], shuffled[20:50], shuffled[50:]):  # ten turns come twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = sessions.folded_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded_all").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("folded_all").orderBy("turn_count").collect():
        last[r.conv_id] = (r.turn_count, r.words, r.roles.split(","), [x for x in r.active.split("|") if x])
    whole = batch.folded(spark.createDataFrame(turns, schema)).collect()
    assert last == {r.conv_id: (r.turn_count, r.words, r.roles, sorted(r.active or [])) for r in whole}


def test_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 3.0D").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    query = sessions.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.n, r.total) for r in spark.table("counted").collect()] == [(2, 5.0)]
