"""The written index: what it holds, what a lookup reads, searches against those of the texts."""

import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical_index as L
from corpusmill.operators import retrieval

TEXTS = [(1, "Alpha beta, beta Project NOVA-1", "a"), (2, "gamma ref_0123456789", "b"), (3, None, "c"), (4, "", "d"), (5, "alpha alpha budget amount of NOVA-1", "e"), (6, "budget delta", "f")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/x"
    L.write(spark.createDataFrame(TEXTS, "id long, text string, note string"), path, with_vectors=True)
    return L.read(spark, path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(spark, index):
    assert rows(index.blocks().select("id", "note")) == [(i, n) for i, _, n in TEXTS]
    assert {("beta", 1, 2, 6), ("alpha", 5, 2, 7), ("ref_0123456789", 2, 1, 2)} <= set(rows(index.postings()))
    assert ("alpha", 2, 3) in rows(index.terms()) and ("beta,", 1, 1) in rows(index.terms("words"))
    assert index.manifest["n_tokens"] == 17 and index.n_blocks == 6 and math.isclose(index.mean_length("tokens"), 17 / 6)
    assert ("NOVA-1", 2) in rows(index.entities()) and index.vectors().count() == 6
    with pytest.raises(Exception):
        L.read(spark, f"{index.path}/blocks")


def test_lookups(spark, index):
    wanted = spark.createDataFrame([("alpha",), ("delta",), ("none",), ("alpha",)], "term string")
    assert rows(L.matching(index, wanted).select("term", "id", "tf")) == [("alpha", 1, 1), ("alpha", 5, 2), ("delta", 6, 1)]
    assert [r.id for r in L.blocks_of(index, spark.createDataFrame([(5,), (9,)], "id long")).collect()] == [5]


def asked(spark):
    return spark.createDataFrame([(1, "alpha beta alpha"), (2, "Budget of"), (3, "zzz"), (4, None)], "qid long, text string")


@pytest.mark.parametrize("analyzer", ["tokens", "words"])
def test_scores_equal_those_of_the_texts(spark, index, analyzer):
    blocks, tokens = spark.createDataFrame(TEXTS, "id long, text string, note string").withColumn("text", F.coalesce("text", F.lit(""))), L.ANALYZERS[analyzer]
    assert rows(L.bm25_scores(index, asked(spark), analyzer)) == rows(retrieval.bm25_scores(blocks, asked(spark), tokens))
    assert rows(L.bm25_okapi_scores(index, asked(spark), analyzer)) == rows(retrieval.bm25_okapi_scores(blocks, asked(spark), tokens))
    terms = retrieval.query_terms(asked(spark), tokens)
    assert rows(L.tf_scores(index, terms, analyzer)) == rows(retrieval.tf_scores(blocks, terms, tokens))


def questions(spark):
    rows = [
        (1, "see ref_0123456789", ["Project NOVA-1"], "REF_0123456789", ["budget"], "single_fact_lookup"), (2, "about NOVA-1", ["Project NOVA-1"], "ref_ffffffffff", [], "comparison"),
        (3, "gamma delta", ["Project ZETA"], None, ["owner"], "aggregation"), (4, "zzz", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "qid long, text string, entities array<string>, marker string, fields array<string>, intent string")


def test_roles_and_tiers(spark, index):
    terms = L.role_terms(questions(spark))
    of = lambda q, role: sorted(r.term for r in terms.where((F.col("qid") == q) & (F.col("role") == role)).collect())
    assert of(1, "marker") == ["ref_0123456789"] and of(1, "entity") == ["1", "nova"] and of(1, "field") == ["amount", "budget", "cost"]
    assert of(2, "field") == ["amount", "budget", "cost", "higher", "lower"] and of(3, "field") == ["managed", "manager", "owner", "responsible"]
    assert of(3, "strong") == ["delta", "gamma", "managed", "manager", "owner", "zeta"] or of(3, "strong") == ["delta", "gamma", "manager", "owner", "zeta"]
    assert of(3, "all") == ["delta", "gamma", "project", "zeta"]
    found = rows(L.pruned(index, terms, 1).select("qid", "tier", "id", "score"))
    assert found == [(1, 1, 2, 1), (2, 2, 1, 2), (3, 3, 1, 1)]  # by marker; by name, the best one; by any term
    assert rows(L.strong_scores(index, terms).select("qid", "id").where("qid = 3")) == [(3, 2), (3, 6)]  # no name hits


def scanned(df):
    """Rows that file scans of the executed plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    todo, n = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            n += node.metrics().apply("numOutputRows").value()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "ROW_GROUP", 20_000)
    texts = spark.range(3000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.sha2((F.col("id") * 41 + i).cast("string"), 256)), F.lit("common")).alias("text"))
    L.write(texts, f"{tmp_path}/x", ("tokens",))
    index = L.read(spark, f"{tmp_path}/x")
    word = texts.first().text.split()[0]
    n, one = index.postings().count(), L.matching(index, spark.createDataFrame([(word,)], "term string"))
    assert n == 3000 * 42 and one.count() == 1 and scanned(one.select("id")) < n / 10
    plan = L.bm25_scores(index, spark.createDataFrame([(1, f"{word} common")], "qid long, text string"), "tokens")
    assert plan.count() == 3000 and "Bucketed: true" in plan._jdf.queryExecution().toString()


def test_postings_are_counted_in_their_block(spark, tmp_path):
    """Counts and lengths of each block, files sorted by term and id; a query's index has one analyzer."""
    from corpusmill.jobs import indexes

    assert all(len(analyzers) == 1 for _, _, analyzers, _ in indexes.SOURCES.values())
    texts = [(i, None if i % 50 == 9 else "" if i % 50 == 8 else " ".join(f"w{i * j % 17} É{j % 3}" for j in range(i % 40 + 1))) for i in range(1200)]
    L.write(spark.createDataFrame(texts, "id long, text string").repartition(3), f"{tmp_path}/y", ("words",), with_entities=False)
    index, expected = L.read(spark, f"{tmp_path}/y"), {}
    for i, text in texts:
        words = (text or "").lower().split()
        expected |= {(w, i): (words.count(w), len(words)) for w in words}
    assert {(r.term, r.id): (r.tf, r.dl) for r in index.postings("words").collect()} == expected
    assert index.postings("words").count() == len(expected) and index.manifest["n_words"] == sum(len((t or "").split()) for _, t in texts)
    files = index.postings("words").withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()}).collect()
    for name in {r.file for r in files}:
        own = [(r.term.encode(), r.id) for r in sorted((r for r in files if r.file == name), key=lambda r: r.at)]
        assert own == sorted(own)


def most_rows(df):
    """The most rows that any node of the executed plan gave."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            n = max(n, node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_the_best_blocks_are_found_without_a_row_per_block_and_query(spark, tmp_path):
    """Ranks, ties and scores as over all pairs; questions that all hold frequent words make no more rows."""
    texts = [(7 * i % 1009, " ".join(["common", "word", *(f"w{i * j % 23}" for j in range(i % 9))]) if i % 40 else None) for i in range(900)]
    L.write(spark.createDataFrame(texts, "id long, text string"), f"{tmp_path}/z", with_entities=False)
    index = L.read(spark, f"{tmp_path}/z")
    queries = spark.createDataFrame([(q, f"common word common w{q % 23} w{q % 5} none") for q in range(60)], "qid long, text string")
    terms = retrieval.query_terms(queries)
    for k in (1, 12, 5000):
        assert rows(L.best_tf(index, terms, k).select("qid", "rank", "id", "score")) == rows(retrieval.best(L.tf_scores(index, terms), k).select("qid", "rank", "id", "score"))
    for best, scores in ((L.best_bm25, L.bm25_scores), (L.best_bm25_okapi, L.bm25_okapi_scores)):
        assert rows(best(index, queries, 12).select("qid", "rank", "id", "score")) == rows(retrieval.best(scores(index, queries), 12).select("qid", "rank", "id", "score"))
    two = terms.where("qid < 4").withColumn("role", F.concat(F.lit("r"), F.col("qid") % 2))
    assert {r.role for r in L.best_tf(index, two, 3, ("role", "qid")).collect()} == {"r0", "r1"} and L.best_tf(index, terms.where("false"), 3).count() == 0
    found = L.best_tf(index, terms, 10)
    assert most_rows(found) <= index.postings().count() < 60 * 850 <= most_rows(retrieval.best(L.tf_scores(index, terms), 10))


def test_many_questions_are_searched_by_joins(spark, index, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 1)
    terms = retrieval.query_terms(asked(spark))
    assert rows(L.best_tf(index, terms, 2)) == rows(retrieval.best(L.tf_scores(index, terms), 2).select("qid", "id", "score", "rank"))
    assert rows(L.best_bm25(index, asked(spark), 2).select("qid", "id", "score")) == rows(retrieval.best(L.bm25_scores(index, asked(spark)), 2).select("qid", "id", "score"))
