"""Fixed-width contexts, selections of one size, judged runs and their gates."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import visibility as V


def test_layout_cuts_and_fills(spark):
    made = [("a", 5, ["x"] * 3), ("a", 2, ["y"] * 6), ("a", 9, None), ("b", 1, [])]
    df = spark.createDataFrame(made, "group string, id long, tokens array<string>").repartition(3)
    got = {(r.group, r.id): r for r in V.laid_out(df, width=4, start=10).collect()}
    assert [(got["a", i].block_id, got["a", i].token_start, got["a", i].token_end) for i in (2, 5, 9)] == [(0, 10, 14), (1, 14, 18), (2, 18, 22)]
    assert got["a", 2].tokens == ["y"] * 4 and got["a", 2].n_cut == 2 and got["a", 2].n_padded == 0
    assert got["a", 5].tokens == ["x"] * 3 + ["\n"] and got["a", 5].n_padded == 1
    assert got["a", 9].tokens == ["\n"] * 4 and got["b", 1].block_id == 0
    assert V.laid_out(df.limit(0)).count() == 0


def test_selections_have_one_size_and_dont_depend_on_partitions(spark):
    made = [(g, i, i % 3 == 0 if i % 5 else None, float(i % 4) if i % 7 else None) for g in (1, 2) for i in range(30)] + [(3, 0, False, 1.0)]
    df = spark.createDataFrame(made, "group long, id long, visible boolean, score double")
    one, two = ({(r.group, r.mode, r.id) for r in V.same_size(df.repartition(n)).collect()} for n in (1, 7))
    assert one == two
    pick = lambda g, m: sorted(i for a, b, i in one if (a, b) == (g, m))
    for g in (1, 2):
        visible = [i for a, i, v, _ in made if a == g and v]
        assert pick(g, "visibility") == visible and pick(g, "full") == list(range(30))
        best = sorted((-(s or 0.0), i) for a, i, _, s in made if a == g)[: len(visible)]
        assert pick(g, "bm25") == sorted(i for _, i in best)
        assert len(pick(g, "random")) == len(visible)
    assert pick(1, "random") != pick(2, "random")
    assert pick(3, "full") == [0] and not pick(3, "visibility") and not pick(3, "random")
    assert {(r.group, r.mode, r.id) for r in V.same_size(df, "43").collect()} != one


@pytest.fixture(scope="module")
def runs(spark):
    blocks = spark.createDataFrame(
        [(1, 0, 10, True, False), (1, 1, 20, True, None), (1, 2, 30, False, True), (2, 0, None, None, None), (2, 1, 7, False, False)],
        "group long, id long, n_tokens int, gold boolean, deprecated boolean",
    )
    kept = spark.createDataFrame([(1, "full", 0), (1, "full", 1), (1, "full", 2), (1, "visibility", 0), (1, "visibility", 1), (1, "random", 2), (2, "full", 0), (2, "full", 1)], "group long, mode string, id long")
    samples = spark.createDataFrame([(1, "C", "May 5, 2027", "2026"), (2, "A", None, None)], "group long, category string, expected string, stale string")
    answers = spark.createDataFrame(
        [(1, "full", "It was 2026, now May 5, 2027."), (1, "visibility", "the May 5 2027"), (1, "random", "2026"), (2, "full", "x"), (2, "visibility", None)], "group long, mode string, answer string",
    )
    return V.judged(kept, blocks, samples, answers)


def test_judged_runs(runs):
    got = {(r.group, r.mode): r for r in runs.collect()}
    full, seen, drawn = (got[1, m] for m in ("full", "visibility", "random"))
    assert full.exact_match and not full.active_truth and full.wrong_retention and full.gold_recall and full.input_tokens == 60
    assert seen.exact_match and seen.active_truth and not seen.wrong_retention and seen.gold_recall and seen.kept_blocks == 2 and seen.total_blocks == 3
    assert seen.kv_bytes == 30 * V.KV_BYTES
    assert not drawn.exact_match and not drawn.gold_recall and not drawn.numeric_preservation and not drawn.active_truth
    none = got[2, "visibility"]  # nothing kept, nothing expected
    assert none.kept_blocks == 0 and none.input_tokens == 0 and none.gold_recall and not none.exact_match and none.numeric_preservation


def test_gates(runs, spark):
    got = {r.gate: (r.value, r.status) for r in V.gates(runs).collect()}
    assert got["gold_recall"] == (100.0, "PASS") and got["exact_match"] == (50.0, "FAIL") and got["contradiction"] == (100.0, "PASS")
    assert got["kv_reduction"] == (round((1 / 3 + 1) / 2 * 100, 6), "PASS")
    assert got["random_gap"] == (50.0, "PASS") and got["bm25_gap"] == (None, "FAIL") and got["overall"] == (None, "FAIL")
    good = spark.createDataFrame(
        [(m, "A", m in ("full", "visibility"), True, True, True, 100 if m == "full" else 20, 10 if m == "full" else 2, 10) for m in V.MODES],
        "mode string, category string, exact_match boolean, numeric_preservation boolean, gold_recall boolean, active_truth boolean, input_tokens long, kept_blocks long, total_blocks long",
    )
    assert {r.status for r in V.gates(good).collect()} == {"PASS"}
    assert {r.status for r in V.gates(good.where(F.lit(False))).where("gate <> 'contradiction'").collect()} == {"FAIL"}
