"""Replies in envelopes, forms of answers, error flags, resolver accuracy, retrieval rates."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import answers as A

REPLIES = [
    ('{"answer": " 5 May 2027 "}', "5 May 2027"),
    ('```json\n{"answer": "x y"}\n```', "x y"),
    ('```\n["a", "b "]\n```  ', "a, b"),
    ('So: {"value": "v", "other": 3}', "v"),
    ('[{"name": "A", "n": 1}, {"name": "B"}, 7]', "A, B, 7"),
    ('{"first": "no", "answer": 12}', "12"),
    ('{"answer": "cut off", and more', "cut off"),
    ('{"Answer" : "any case", oops}', "any case"),
    ("  plain words ", "plain words"),
    ("{not json}", "{not json}"),
    ("", ""),
    (None, ""),
    ("{}", "{}"),
]


def test_envelopes(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    got = {r.i: r.a for r in df.select("i", A.envelope_answer(F.col("reply")).alias("a")).collect()}
    assert [got[i] for i in range(len(REPLIES) - 1)] == [w for _, w in REPLIES[:-1]]


@pytest.mark.parametrize(("reply", "want"), [('blue"}', "blue"), ("blue", "blue"), ('{"answer": "a"}', "a"), ('two\nlines"\n}', "two\nlines")])
def test_primed_envelopes(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert df.select(A.envelope_answer(F.col("reply"), primed=True)).first()[0] == want


def test_schema_examples(spark):
    made = [("comparison", ["budget"]), ("aggregation", None), ("multi_fact_extraction", ["deadline", "owner"]), ("single_fact_lookup", ["deadline"]), ("status_resolution", ["budget", "owner"]), ("single_fact_lookup", []), (None, None)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "i int, intent string, fields array<string>")
    got = [r.e for r in df.orderBy("i").select(A.schema_example(F.col("intent"), F.col("fields")).alias("e")).collect()]
    assert got == [A.COMPARISON_EXAMPLE, A.LISTING_EXAMPLE, "DATE and OWNER", "DATE", "BUDGET", "VALUE", "VALUE"]


def test_error_flags(spark):
    said = spark.createDataFrame(
        [(1, "F", "$5,000", "$7,000"), (2, "F", "$7,000", "7000"), (3, "F", "$5,000", "$7,000"), (4, "E", "NOT_FOUND", "x"), (5, "E", None, "x"), (6, "A", "$5,000", "$7,000")],
        "qid long, category string, answer string, expected string",
    )
    blocks = spark.createDataFrame(
        [(1, "suffix_distractor", "Project X has 5000"), (1, "active", "7000"), (2, "suffix_distractor", "7,000"), (3, "obsolete", "$5,000"), (3, "suffix_distractor", None), (6, "suffix_distractor", "$5,000")],
        "qid long, state string, text string",
    )
    got = {r.qid: (r.right, r.suffix_error, r.abstained) for r in A.error_flags(said, blocks).collect()}
    assert got == {1: (False, True, False), 2: (True, False, False), 3: (False, False, False), 4: (False, False, True), 5: (False, False, False), 6: (False, False, False)}


def test_resolver_accuracy(spark):
    states = spark.createDataFrame(
        [
            (1, "c/x_amendment.txt", "active", False), (1, "c/x_base.txt", "obsolete", False), (2, "c/x_amendment.txt", "active", False), (2, "c/x_base.txt", "active", False),
            (3, "c\\iris.txt", "active", False), (3, "c/iris_legacy.txt", "suffix_distractor", True), (4, "c/iris.txt", "active", False), (4, "c/iris_mobile.txt", "active", True),
        ],
        "qid long, source_file string, state string, alike boolean",
    )
    asked = spark.createDataFrame([(1, "C", None), (2, "C", None), (3, "F", "c/iris.txt"), (4, "F", "c/iris.txt"), (5, "F", "c/none.txt"), (6, "A", None)], "qid long, category string, target string")
    got = {r.category: (r.n, r.n_right, r.accuracy, r.gate) for r in A.resolver_accuracy(states, asked).collect()}
    assert got == {"C": (2, 1, 50.0, "FAIL"), "F": (3, 1, 33.333333, "FAIL")}
    fine = A.resolver_accuracy(states.where("qid IN (1, 3)"), asked.where("qid IN (1, 3)")).collect()
    assert {r.gate for r in fine} == {"PASS"}


def test_retrieval_rates(spark):
    units = spark.createDataFrame(
        [(1, 10, True, True, True, True), (1, 11, False, None, True, True), (1, 12, True, True, False, True), (2, 20, True, False, False, True)],
        "qid long, id long, expected boolean, utilised boolean, relevant boolean, own boolean",
    )
    found = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (1, 99), (3, 1)], "qid long, id long")
    got = {r.qid: tuple(r)[1:] for r in A.retrieval_rates(found, units).collect()}
    assert got == {1: (3, 0.666667, True, True, 0.5, 1.0), 2: (0, 0.0, False, False, 1.0, 1.0)}
