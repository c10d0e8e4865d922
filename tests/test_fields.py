"""Fields, canonical names, file formats and cell search on small fixtures."""

import json

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import code, facts, fields, vectors
from corpusmill.sources import tables


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_field_values(spark):
    value = lambda text, field, names=(): one(spark, text, lambda t: fields.field_value(t, field, names))
    assert value("was $5,000. Approved\nBudget: $900,000", "budget") == "$900,000"
    assert value("costs $5,000 and $6,000", "budget") == "$5,000" and value("no amount", "budget") is None and value(None, "budget") is None
    assert value("1 May 2020. Officially extended to 3 June 2021", "deadline") == "3 June 2021"
    assert value("for ALICE MARTIN and Emma Michel", "owner", ("Emma Michel", "Alice Martin")) == "Emma Michel"
    assert value("Department: Legal, with Sales", "department", fields.DEPARTMENTS) == "Legal"
    assert value("overseen by the sales unit", "department", fields.DEPARTMENTS) == "Sales"
    assert value("the Finance Committee met", "department", fields.DEPARTMENTS) is None
    assert value("the Finance Committee met; Lead Unit: Finance", "department", fields.DEPARTMENTS) == "Finance"
    assert value("based in Lyon, not Paris", "location", ("Paris", "Lyon")) == "Lyon"
    assert value("Lyons or paris", "location", ("Lyon", "Paris")) == "Paris" and value("", "location", ("Lyon",)) is None


def test_exact_projects_lists_and_numbers(spark):
    exact = lambda text: one(spark, text, lambda t: fields.exact_project(t, F.lit("APEX-400")))
    assert exact("of apex-400.") and exact("APEX-400- x") and exact("APEX-400-A and APEX-400") and not exact("APEX-400-Legacy") and not exact("none")
    listed = lambda text: one(spark, text, fields.json_list)
    assert listed('["a", "b"]') == ["a", "b"] and listed("plain") == ["plain"] and listed("") == [] and listed(None) == []
    assert one(spark, "2026", lambda t: T.normalized_budget(t, years=True)) == 2026 and one(spark, "2026", T.normalized_budget) is None


def test_canonical_names(spark):
    people = spark.createDataFrame([(0, "Jean Dupont", ["The Chief"]), (1, "Émile Zola", None), (2, "Jean Durand", [])], "place int, name string, aliases array<string>")
    raw = spark.createDataFrame([(x,) for x in (" jean DURAND", "the chief", "Jean D.", "emile z", "zola", "nobody", "", None, "zola")], "raw string")
    found = {r.raw: r.name for r in fields.canonical_names(raw, people).collect()}
    assert found == {" jean DURAND": "Jean Durand", "the chief": "Jean Dupont", "Jean D.": "Jean Dupont", "emile z": "Émile Zola", "zola": "Émile Zola", "nobody": None}
    assert fields.canonical_names(raw.where("false"), people).count() == 0


def test_file_formats(spark, tmp_path):
    rows = [(1, ' "a", b\nc '), (2, ""), (3, None), (4, "é\\")]
    df = spark.createDataFrame(rows, "k long, t string")
    tables.write_csv(df, f"{tmp_path}/csv")
    tables.write_json_lines(df, f"{tmp_path}/json")
    for back in (tables.read_csv(spark, f"{tmp_path}/csv", "k long, t string"), tables.read_json_lines(spark, f"{tmp_path}/json", "k long, t string")):
        assert sorted(map(tuple, back.collect())) == rows
    (tmp_path / "array.json").write_text(json.dumps([{"k": 1, "t": "x\ny"}, {"k": 2}], indent=1))
    assert sorted(map(tuple, tables.read_json_array(spark, f"{tmp_path}/array.json", "k long, t string").collect())) == [(1, "x\ny"), (2, None)]


def test_cell_search(spark):
    made = np.random.default_rng(0).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(900, None), (901, [0.0] * 8)], "id long, v array<double>")
    queries = rows.where("id < 5").select(F.col("id").alias("qid"), "v")
    exact = {(r.qid, r.rank, r.id) for r in vectors.cosine_top_k(rows.where("id < 900"), queries, 5).collect()}
    assert {(r.qid, r.rank, r.id) for r in vectors.ivf_top_k(rows, queries, 5, nlist=16, nprobe=16).collect()} == exact
    some = {(r.qid, r.id) for r in vectors.ivf_top_k(rows, queries, 5, nlist=16, nprobe=8).collect()}
    assert len(some & {(q, i) for q, _, i in exact}) >= 0.6 * len(exact)
    assert vectors.ivf_top_k(rows.where("id >= 900"), queries, 5).count() == 0


def test_deep_source_has_no_symbols(spark):
    files = spark.createDataFrame([("a.py", "(" * 50_000), ("b.py", "def f():\n    pass"), ("c.py", None)], "path string, text string")
    assert [(r.path, r.symbol) for r in code.symbols(files).collect()] == [("b.py", "f")]


def test_owners_and_amounts_by_aggregates(spark):
    day = lambda y: (y, 1, 1)
    rows = [("E", "owner", "A", None, "active", 1, day(2020)), ("E", "owner", "A", None, "active", 2, day(2018)), ("E", "owner", "B", None, "active", 3, day(2020)), ("E", "owner", "C", None, "active", 4, day(2019)),
            ("E", "owner", "D", None, "active", 5, (-1, -1, -1)), ("E", "owner", "F", None, "obsolete", 6, day(2030)), ("G", "deadline", "x", None, "active", 7, day(2020)),
            ("H", "budget", "y", 5, "active", 8, day(2020)), ("H", "budget", "z", 6, "active", 9, day(2021)), ("H", "budget", "w", 7, "obsolete", 10, day(2022))]
    df = spark.createDataFrame([(*r, 0, False, False) for r in rows], "entity string, field string, value string, amount long, status string, block_id long, date struct<y:int,m:int,d:int>, seq int, is_amendment boolean, is_noise boolean")
    assert {(r.entity, r.owner) for r in facts.current_owners(df).collect()} == {("E", "A"), ("E", "B"), ("E", "D")}
    assert {r.entity: r.amount for r in facts.known_amounts(df, "budget").collect()} == {"E": None, "G": None, "H": 6}
