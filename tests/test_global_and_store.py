"""Global ranks, scores by case, code context, strategies, renames, facts and claims on
small fixtures."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import code, fact_store, facts, fusion, global_order, retrieval, sampling, selection, strategies, vectors
from corpusmill.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_global_ranks(spark):
    rnd = random.Random(0)
    made = [(rnd.choice(["a", "b", None]) if i % 7 else "hot", i, rnd.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(made, "g string, id long, s int").repartition(6)
    got = {(r.g, r.id): r.rank for r in global_order.ranked_globally(df, ["g"], [F.col("s").desc(), F.col("id")]).collect()}
    for g in {g for g, _, _ in made}:
        for n, (_, i) in enumerate(sorted((-s, i) for x, i, s in made if x == g), 1):
            assert got[g, i] == n
    numbers = global_order.numbered(df, [F.col("id").desc()]).collect()
    assert sorted((r.number, r.id) for r in numbers) == [(n, 499 - n) for n in range(500)]
    assert global_order.numbered(df.limit(0), [F.col("id")]).count() == 0


def test_block_numbers(spark):
    texts = spark.createDataFrame([("b", "x", "w " * 130), ("a", "x", "one"), ("c", None, "")], "path string, category string, text string")
    found = tables.numbered_blocks(tables.blocks(texts)).select("source_file", "chunk_index", "block_id")
    assert rows(found) == [("a", 0, "block_0000"), ("b", 0, "block_0001"), ("b", 1, "block_0002")]


def test_full_reciprocal_ranks(spark):
    dense = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.9, 0.9, 0.0])], "qid long, id long, score double")
    lexical = spark.createDataFrame([(1, 3, 2.0)], "qid long, id long, score double")
    got = {r.id: (r.dense_rank, r.lexical_rank, r.score) for r in fusion.full_reciprocal_ranks(dense, lexical).collect()}
    assert {i: x[:2] for i, x in got.items()} == {1: (0, 2), 2: (1, 3), 0: (2, 1), 3: (3, 0)} and got[3][2] == round(1 / 60 + 1 / 63, 9)


def test_bm25_by_case(spark):
    units = spark.createDataFrame([(1, 1, "red fish"), (1, 2, "blue fish fish"), (2, 1, "red"), (2, 2, None), (3, 1, "red")], "case long, id long, text string")
    asked = spark.createDataFrame([(1, "Fish red"), (2, "red red"), (4, "x")], "case long, text string")
    got = {(r["case"], r["id"]): r.score for r in retrieval.bm25_case_scores(units, asked).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    part = lambda n, df, tf, dl, mean: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert got[1, 1] == round(part(2, 2, 1, 2, 2.5) + part(2, 1, 1, 2, 2.5), 6) and got[2, 1] == round(2 * part(2, 1, 1, 1, 0.5), 6)


def test_best_rows_of_score_blocks():
    rnd, best, every = np.random.default_rng(0), vectors._Best(5, 3), []
    for at in range(0, 60, 20):
        ids, scores = np.arange(at, at + 20)[::-1], rnd.integers(0, 4, (20, 5)) / 4
        best.add(ids, scores)
        every += [(q, -scores[i, q], ids[i]) for i in range(20) for q in range(5)]
    for q in range(5):
        assert best.ids[q].tolist() == [i for x, _, i in sorted(every) if x == q][:3]


def test_context_metrics_and_paths(spark):
    gold = spark.createDataFrame([("i", "a.py", 300, "f"), ("i", "a.py", 301, "f"), ("i", "b.py", 5, "g"), ("none", "z.py", 1, "h")], "id string, file string, line int, symbol string")
    chosen = spark.createDataFrame([("i", 1, "a.py", 250, 300, 10), ("i", 2, "c.py", 1, 2, 5), ("i", 3, "a.py", 290, 300, 5), ("j", 1, "a.py", 1, 0, 7)], "id string, rank int, file string, first int, last int, n_tokens int")
    got = {r.id: r for r in code.context_metrics(chosen, gold).collect()}
    assert got["i"].symbol_recall_1 == 50.0 and got["i"].line_coverage == round(100 / 3, 6) and got["i"].irrelevant_lines == round(100 * 63 / 64, 6) and got["i"].tokens_per_line == round(20 / 3, 6)
    assert (got["j"].symbol_recall_5, got["j"].line_coverage, got["j"].irrelevant_lines, got["j"].tokens_per_line) == (100.0, 100.0, 0.0, 7.0)
    ranges = spark.createDataFrame([("a.py", "all", 1, 5000), ("a.py", "f", 290, 310)], "path string, symbol string, first int, last int")
    assert rows(code.changed_symbols(gold.select("id", "file", "line"), ranges).where("file <> 'z.py'").select("line", "symbol")) == [(300, "f"), (301, "f"), (5, "b.py:5-5")]
    files = spark.createDataFrame([("src/pkg/m.py",), ("m.py",), ("src/xm.py",)], "path string")
    named = spark.createDataFrame([(1, "PKG/m.py"), (2, "C:\\w\\src\\pkg\\m.py"), (3, "none.py"), (4, "m.py")], "id long, suffix string")
    assert rows(code.matching_paths(files, named)) == [(1, "m.py"), (1, "src/pkg/m.py"), (2, "m.py"), (2, "src/pkg/m.py"), (4, "m.py"), (4, "src/pkg/m.py")]


def test_context_metrics_deal_out_by_issue_once(spark):
    """Overlapping, nested and reversed snippets, repeated lines, lines and snippets of no
    file; against counting line by line."""
    rnd = np.random.default_rng(1)
    gold = [(int(i), [None, "a", "b"][f], int(n), f"s{n % 5}") for i, f, n in zip(rnd.integers(0, 6, 300), rnd.integers(0, 3, 300), rnd.integers(1, 200, 300))]
    chosen = [(int(i), r, [None, "a", "b"][f], int(n), int(n + m), 1) for r, (i, f, n, m) in enumerate(zip(rnd.integers(0, 7, 40), rnd.integers(0, 3, 40), rnd.integers(1, 190, 40), rnd.integers(-3, 40, 40)), 1)]
    df = code.context_metrics(spark.createDataFrame(chosen, "id int, rank int, file string, first int, last int, n_tokens int"), spark.createDataFrame(gold + gold[:50], "id int, file string, line int, symbol string"), (1, 9))
    got = {r.id: r for r in df.collect()}
    assert set(got) == {c[0] for c in chosen}
    for i, r in got.items():
        lines, own = {g[1:3] for g in gold if g[0] == i}, [c for c in chosen if c[0] == i]
        covered = {(f, n) for f, n in lines if f and any(c[2] == f and c[3] <= n <= max(c[3], c[4]) for c in own)}
        assert r.line_coverage == (round(100 * len(covered) / len(lines), 6) if lines else 100.0)
        symbols = {(g[1], g[3]) for g in gold if g[0] == i}
        hit = [s for s in symbols if s[0] and any(c[2] == s[0] and c[1] <= 9 for c in own)]
        assert r.symbol_recall_9 == (round(100 * len(hit) / len(symbols), 6) if symbols else 100.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange ") == 1


def test_strategy_names():
    assert len(strategies.STRATEGIES) == 11
    with pytest.raises(ValueError):
        strategies.Cell("ooc_none")


def test_final_names(spark):
    chain = [(f"N{i}", f"N{i + 1}") for i in range(13)]
    steps = spark.createDataFrame([*chain, ("A", "B"), ("B", "C"), ("C", "B"), ("X", "X"), ("T", "A")], "old string, new string")
    got = dict(map(tuple, fact_store.final_names(steps).collect()))
    assert all(got[f"N{i}"] == "N13" for i in range(13)) and "X" not in got
    assert got["A"] == got["T"] == got["C"] == "B" and "B" not in got  # a circle has its smallest name
    assert fact_store.final_names(steps.limit(0)).count() == 0


PEOPLE = [("Ann Lee", ["the chief"]), ("Bob Ray", [])]


def test_facts_of_five_fields(spark):
    blocks = [
        (1, "c/base.txt", "Project A-1 was renamed to Project B-1."), (2, "c/update.txt", "Subject: $7,500 asked\nFrom: Bob Ray\nProject B-1 is run by the Legal unit in Rome until 3 May 2020."),
        (3, "noise/x.txt", "Budget is $9,000.\nProject A-1 has a budget of $8,000."), (4, "m.txt", "Project Z was reassigned from Ann Lee, to Bob Ray.\nThe Chief asked."), (5, "m.txt", None),
    ]
    evidence = spark.createDataFrame(blocks, "block_id long, source_file string, text string")
    names = fact_store.final_names(facts.renames(evidence))
    found = fact_store.renamed(fact_store.extract(evidence, PEOPLE, ("Legal", "HR"), ("Rome",)), names)
    got = rows(found.select("entity", "field", "value", "status", "block_id"))
    assert got == sorted([
        ("B-1", "budget", "$7,500", "active", 2), ("B-1", "budget", "$8,000", "active", 3), ("B-1", "deadline", "3 May 2020", "active", 2), ("B-1", "department", "Legal", "active", 2), ("B-1", "location", "Rome", "active", 2),
        ("B-1", "owner", "Bob Ray", "active", 2), ("Z", "owner", "Ann Lee", "active", 4), ("Z", "owner", "Ann Lee", "obsolete", 4),
    ], key=repr)
    mentioned = spark.createDataFrame([("A-1",), ("Z",)], "entity string")
    asked = spark.createDataFrame([(1, "A-1", "budget", 1), (2, "Z", "location", 1), (3, "Q", "budget", 1)], "qid long, entity string, field string, position int")
    assert rows(fact_store.looked_up(asked, found, mentioned, names)) == [(1, "$7,500"), (2, "KERNEL_MISSING_FIELD"), (3, "NOT_FOUND")]


def test_claims(spark):
    schema = "entity string, field string, value string, amount long, status string"
    store = spark.createDataFrame([("A", "budget", "$5,000", 5000, "active"), ("A", "budget", "$4,000", 4000, "obsolete"), ("A", "owner", "Ann Lee", None, "active"), ("A", "department", "Legal", None, "active"), ("A", "deadline", "1 May 2020", None, "obsolete"), ("C", "owner", "Bob Ray", None, "obsolete")], schema)
    names = spark.createDataFrame([("OLD", "A")], "old string, new string")
    asked = spark.createDataFrame([(1, "Project OLD"), (2, "Project A"), (3, "Project A"), (4, "bob ray")], "pack_id long, target string")
    packs = fact_store.pack(store, asked, names)
    assert {(r.pack_id, r["key"]) for r in packs.collect()} == {(1, "A"), (2, "A"), (3, "A"), (4, "C")}
    claims = spark.createDataFrame([
        (1, 1, "Project OLD has $5,000 under Ann Lee of Legal."), (1, 2, "No more."), (2, 1, "Project A had 4,000 until 1 May 2020."), (2, 2, "Project C and Project A have 6k; HR says so."), (3, 1, "Bob Ray leads."),
    ], "pack_id long, claim_id long, text string")
    said = spark.createDataFrame([(1, "It is fine", ["is fine"]), (2, "no", ["is fine"]), (3, "any", []), (4, None, ["x"])], "pack_id long, conclusion string, allowed array<string>")
    got = {r.pack_id: r for r in fact_store.verified(claims, packs, said, names, PEOPLE, ("Legal", "HR")).collect()}
    assert got[1].passed and got[1].score == 5 and got[1].groundedness == 1.0
    assert (got[2].obsolete, got[2].numeric, got[2].evidence, got[2].entity, got[2].score) == (2, 1, 1, 1, 1) and not got[2].passed and got[2].groundedness == 1 - 5 / 2
    assert (got[3].entity, got[3].score, got[3].passed) == (1, 4, False) and (got[4].n_claims, got[4].score) == (0, 4)


def test_dollars_are_no_year(spark):
    store = spark.createDataFrame([("A", "budget", "$1,995", 1995, "active"), ("A", "deadline", "3 May 1995", None, "active")], "entity string, field string, value string, amount long, status string")
    packs = fact_store.pack(store, spark.createDataFrame([(1, "Project A"), (2, "Project A"), (3, "Project A")], "pack_id long, target string"), spark.createDataFrame([], "old string, new string"))
    claims = spark.createDataFrame([(1, 1, "Project A has $1,995 until 3 May 1995."), (2, 1, "Project A has $1,996 until 3 May 1996."), (3, 1, "Project A has 1,996 until 3 May 1996.")], "pack_id long, claim_id long, text string")
    said = spark.createDataFrame([(i, "fine", ["fine"]) for i in (1, 2, 3)], "pack_id long, conclusion string, allowed array<string>")
    got = {r.pack_id: r.numeric for r in fact_store.verified(claims, packs, said, spark.createDataFrame([], "old string, new string"), PEOPLE, ("HR",)).collect()}
    assert got == {1: 0, 2: 2, 3: 1}


def test_mass_of_blocks_spells_out_no_places(spark):
    blocks = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 2, 2), (1, 3, 2, 4), (2, 1, 0, 0), (None, 1, 0, 3)], "group long, id long, start long, stop long")
    mass = selection.block_mass(blocks, lambda place: 1.0 / (place + 1))
    all_of = 1 + 1 / 2 + 1 / 3 + 1 / 4
    assert {(r.group, r.id): r.mass for r in mass.collect()} == {(1, 1): round(1.5 / all_of, 9), (1, 2): 0.0, (1, 3): round((1 / 3 + 1 / 4) / all_of, 9), (2, 1): 0.0, (None, 1): 1.0}
    plan = mass._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_draws_with_replacement(spark):
    made = [(i, i % 4 * 10) for i in range(60)] + [(100, 5000), (101, None)]
    df = spark.createDataFrame(made, "k long, w long")
    draw = lambda n, x: sorted(map(tuple, sampling.drawn_with_replacement(x, "k", F.col("w"), n, "s").select("draw", "k").collect()))
    got = draw(2000, df)
    assert [d for d, _ in got] == list(range(2000)) and got == draw(2000, df.repartition(7))
    assert all(dict(made)[k] for _, k in got) and 0.8 < sum(k == 100 for _, k in got) / 2000 / (5000 / 5900) < 1.2
    assert draw(5, df.where("w = 0")) == draw(0, df) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_context_recall_reads_the_gold_lines_once(spark):
    from corpusmill.jobs import code_jobs

    plan = code_jobs.context_recall(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" not in plan  # no diff is read again for a figure of its lines
