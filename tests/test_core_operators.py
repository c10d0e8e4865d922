"""Operators on small fixtures, against restated formulas."""

import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import code, evaluation, evidence_packing, facts, fusion, retrieval, sampling, sessions, vectors

BLOCKS = [(0, "Reference ref_a1b2c3d4e5. Project ALPHA budget is $900,000."), (1, "Project BETA budget is $100,000."), (2, "Unrelated operational note.")]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,amount",
    [("$900,000", 900000), ("1.5 million", 1500000), ("250k", 250000), ("2026", None), ("$2026", 2026), ("1234567", 1234567), ("12.9", 12), ("none", None)],
)
def test_normalized_budget(spark, text, amount):
    assert one(spark, text, T.normalized_budget) == amount


def test_budget_string_takes_the_first_pattern(spark):
    assert one(spark, "about 40 k, but $1,200 is due", T.budget_string) == "$1,200"
    assert one(spark, "a total of 3 million", T.budget_string).strip() == "3 million"


@pytest.mark.parametrize("text,date", [("on 3 October 1998.", (1998, 9, 3)), ("3 Foo 1998", (1998, -1, 3)), ("in 1990 or 2024", (2024, -1, -1)), ("in 1889", (-1, -1, -1))])
def test_date_parts(spark, text, date):
    assert tuple(one(spark, text, T.date_parts)) == date


def test_entities_and_boundaries(spark):
    assert sorted(one(spark, "KRONOS and Alice Martin met NEPTUNE-Legacy in Budget REPORT", T.entity_candidates)) == ["Alice Martin", "KRONOS", "NEPTUNE-L"]
    mention = lambda text: one(spark, text, lambda t: T.mentions(t, F.lit("NEPTUNE")))
    assert mention("of neptune.") and not mention("NEPTUNE-Legacy") and not mention("xNEPTUNE")
    assert one(spark, "NEPTUNE-Legacy", lambda t: T.suffixes(t, F.lit("NEPTUNE"))) == ["-legacy"]
    assert one(spark, "Néptune-r2 ends", lambda t: T.mentions_revision(t, F.lit("NEPTUNE")))


def test_question_parse(spark):
    fields = one(spark, "Who is the manager and what is the budget?", T.required_fields)
    assert fields == ["owner", "budget"]
    assert one(spark, "Compare A", lambda t: T.intent(t, F.array(), F.lit(1))) == "comparison"
    key = lambda q: one(spark, q, lambda t: T.canonical_hash(t, F.array(F.lit("A")), F.array(F.lit("budget")), F.lit("comparison"), F.lit(None).cast("string")))
    assert key("Which is  HIGHER?") == key("which is higher?") != key("which is lower?")


def test_answers(spark):
    assert one(spark, "The  $1,000 Project b", T.token_sorted_answer) == "1000 b the"
    assert one(spark, "The answer, a 42!", T.bare_answer) == "answer 42"
    assert one(spark, 'so: {"answer": "x"} ok', T.json_object) == '{"answer": "x"}'
    assert one(spark, "no object", T.json_object) is None


def test_chunks_and_sentences(spark):
    words = " ".join(map(str, range(300)))
    assert [len(c) for c in one(spark, words, lambda t: T.chunks(T.words(t)))] == [128, 128, 44]
    assert one(spark, "", lambda t: T.chunks(T.words(t))) == []
    assert one(spark, "One. Two!  Three? four", T.sentences) == ["One.", "Two!", "Three?", "four"]


def test_bm25_against_formula(spark):
    docs = {i: t.lower().split() for i, t in BLOCKS}
    query = "project budget budget"
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    expect = {}
    for i, d in docs.items():
        s = 0.0
        for t in query.split():
            df = sum(t in x for x in docs.values())
            if tf := d.count(t):
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s:
            expect[i] = round(s, 6)
    rows = retrieval.bm25_scores(spark.createDataFrame(BLOCKS, "id long, text string"), spark.createDataFrame([(7, query)], "qid long, text string")).collect()
    assert {r.id: r.score for r in rows} == pytest.approx(expect)


def test_tiers_and_fusion(spark):
    s = "qid long, id long, score double"
    first, second = spark.createDataFrame([(1, 5, 2.0)], s), spark.createDataFrame([(1, 6, 9.0), (2, 7, 1.0), (2, 8, 3.0)], s)
    rows = retrieval.tiered_candidates([first, second], [None, 1]).collect()
    assert {(r.qid, r.id, r.tier) for r in rows} == {(1, 5, 1), (2, 8, 2)}
    ranks = "qid long, id long, rank int"
    fused = fusion.reciprocal_ranks(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], ranks), spark.createDataFrame([(1, 2, 1)], ranks))
    assert {r.id: r.score for r in fused.collect()} == pytest.approx({1: round(1 / 61 + 1 / 100060, 9), 2: round(1 / 62 + 1 / 61, 9)})
    none = spark.createDataFrame([], s)
    total = fusion.fused(spark.createDataFrame([(1, 1, 0.5)], s), spark.createDataFrame([(1, 1, 30.0)], s), none, none, spark.createDataFrame([(1, 1, 1.0)], s)).first()
    assert total.score == pytest.approx(0.5 + 1.0 + 10.0)


def test_vectors(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])], "id long, v array<float>")
    found = vectors.cosine_top_k(rows, spark.createDataFrame([(9, [1.0, 0.0])], "qid long, v array<float>"), 2).collect()
    assert [(r.rank, r.id) for r in sorted(found, key=lambda r: r.rank)] == [(1, 0), (2, 2)]
    assert vectors.HashingEmbedder().encode([""])[0][-1] == 1.0


def test_vector_queries_in_rounds(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    texts = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)], "id long, text string")
    asked = texts.select(F.col("id").alias("qid"), "text").unionByName(spark.createDataFrame([(60, None), (61, "")], "qid long, text string"))
    whole, parts = (sorted(map(tuple, vectors.hashing_top_k(texts, asked, 3, each).collect())) for each in (100, 9))
    assert len(whole) == 3 * 62 and whole == parts
    assert vectors.hashing_top_k(texts, asked.limit(0), 3).count() == 0


def test_gold_by_windows(spark, tmp_path):
    from corpusmill.jobs import eval_jobs

    passage = [f"w{i}" for i in range(20)]  # eleven windows of ten words
    docs = [(1, " ".join(["x", *passage, "y"])), (2, " ".join(passage[4:])), (3, " ".join(passage[:12])), (4, "a short one here"), (5, None), (6, ""), (2, " ".join(passage[4:]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(passage)), (2, "Short  ONE"), (3, ""), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted((r.qid, r.id) for r in eval_jobs._gold(spark, str(tmp_path)).collect()) == [(1, 1), (1, 2), (2, 4)]


EVIDENCE = [
    (1, "contracts/contract_base_1.txt", "Project ALPHA budget is $900,000.\n3 May 2020\nProject ALPHA is managed by Jean Dupont."),
    (2, "contracts/amendment_2.txt", "The new budget of Project ALPHA was increased to $950,000.\n4 May 2021"),
    (3, "noise/x.txt", "Project ALPHA budget is $1.\n9 May 2030\nbudget $5,000"),
    (4, "reports/r.txt", "Subject: Project BETA $7,777\nProject BETA budget is $100,000.\nPreviously Project BETA was managed by Emma Michel."),
    (5, "reports/s.txt", "Project ALPHA was reassigned from Jean Dupont to Alice Martin.\n1 June 2022"),
]


def test_facts_and_kernels(spark):
    rows = facts.extract(spark.createDataFrame(EVIDENCE, "block_id long, source_file string, text string")).cache()
    budgets = facts.resolved(rows.where("field = 'budget'"), ["entity"])
    assert {r.entity: r.amount for r in budgets.collect()} == {"ALPHA": 950000, "BETA": 100000}
    assert rows.where("entity = 'BETA' AND amount = 7777").count() == 0  # a header line
    owners = {(r.owner, r.entity) for r in facts.current_owners(rows).collect()}
    assert owners == {("Alice Martin", "ALPHA")}
    pairs = spark.createDataFrame([(1, "ALPHA", "BETA"), (2, "ALPHA", "GAMMA"), (3, "ALPHA", "ALPHA")], "pair_id long, a string, b string")
    found = {r.pair_id: r.answer for r in facts.compared(pairs, budgets, facts.mentioned_entities(rows)).collect()}
    assert found == {1: "Project ALPHA (budget of $950,000)", 2: "NOT_FOUND", 3: "INSUFFICIENT_EVIDENCE"}


def test_supersession(spark):
    rows = [(1, "a/contract_base.txt", "E", (2020, 1, 1)), (2, "a/amendment_1.txt", "E", (2021, 1, 1)), (3, "a/amendment_2.txt", "E", (2022, 1, 1)), (4, "r.txt", "E", (2019, 1, 1)), (5, "r.txt", "F", (2019, 1, 1))]
    df = spark.createDataFrame(rows, "block_id long, source_file string, entity string, date struct<y:int,m:int,d:int>")
    assert {r.block_id: r.reason for r in facts.superseded(df).collect()} == {1: "amended", 2: "later amendment", 3: None, 4: "later date", 5: None}


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, "what is 42 ABC", i, i % 2, text, i, i, i) for i, text in enumerate(["what is this thing", "is " * 600, "it is 42 here", "ABC has no number"])]
    df = spark.createDataFrame(rows, "qid long, question string, id long, doc long, text string, bm25_rank int, dense_rank int, block_rank int")
    got = evidence_packing.packed(evidence_packing.scored(df)).first()
    assert {t.id for t in got.taken} == {0, 2, 3} and got.total == 12
    low = evidence_packing.rescued(evidence_packing.packed(evidence_packing.scored(df), most=1), most=3).first()
    assert low.taken[0].how == "packed" and any(t.how == "rescued" for t in low.taken)
    sents = spark.createDataFrame([(0, i, i, t) for i, t in enumerate(["first words here", "what is this thing", "more"])], "doc long, sent int, id long, text string")
    wide = evidence_packing.expanded(spark.createDataFrame([(1, 4, [(1, 0, "what is this thing", 4, "packed")])], "qid long, total int, taken array<struct<id:bigint,doc:bigint,text:string,n_tokens:int,how:string>>"), sents).first()
    assert wide.ids == [1, 0, 2] and wide.total == 8


def test_economics(spark):
    c = evaluation.economics(*map(F.lit, (10000, 1000, 250)), F.lit(100.0), F.lit(400.0), 1.0, 2.0)
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (r.avoided, r.input_tps, r.output_tps, r.effective_tps, r.cost, r.avoided_cost) == (9000, 10000.0, 625.0, 20000.0, 0.0015, 0.009)


def test_recall_needs_every_group(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 5)], "qid long, id long, rank int")
    gold = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 99)], "qid long, gold_group int, id long")
    rows = {r.qid: r for r in evaluation.recall_at(found, gold, (1, 10)).collect()}
    assert (rows[1].hit_1, rows[1].hit_10, rows[1].rr) == (False, True, 1.0)
    assert (rows[2].hit_10, rows[2].rr) == (False, 0.0)


def test_sampling_and_cache(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("s"))
    assert sampling.stratified(df, "s", "id", 5).count() == 10
    assert {r.s: r["count"] for r in sampling.proportional(df, "s", "id", 20).groupBy("s").count().collect()} == {0: 15, 1: 5}
    cache = spark.createDataFrame([("a", "v1", "x"), ("b", "v0", "y")], "key string, version string, value string")
    rows = sampling.cached(spark.createDataFrame([("a",), ("b",)], "key string"), cache, "v1").collect()
    assert {r.key: r.hit for r in rows} == {"a": True, "b": False}


def test_sessions(spark):
    rows = [(1, 0, "user", "About KRONOS please"), (1, 1, "assistant", "fine"), (1, 2, "user", "and its budget too"), (2, 0, "user", "hello there")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = {(r.conv_id, r.turn): (r.kind, r["query"]) for r in sessions.planned(turns).collect()}
    assert plans[1, 0][0] == "entity" and plans[1, 2] == ("follow_up", "Project KRONOS and its budget too") and plans[2, 0][0] == "semantic"
    assert {r.turn: r.switches for r in sessions.switches(turns, "role").where("conv_id = 1").collect()} == {0: 0, 1: 1, 2: 2}


PATCH = """diff --git a/pkg/m.py b/pkg/m.py
--- a/pkg/m.py
+++ b/pkg/m.py
@@ -10,3 +20,4 @@ class R
 keep
-old
+new
+more
 keep"""


def test_symbols_around_lines_are_not_spelled_out(spark):
    """300 symbols over every line and a few short ones, many changes of the same lines."""
    whole = spark.range(300).selectExpr("'m.py' AS path", "concat('all', id) AS symbol", "CAST(1 + id AS INT) AS first", "2147483647 AS last")
    short = [(a * 7 % 90 + 1, a * 7 % 90 + 1 + a % 23) for a in range(60)]
    ranges = whole.unionByName(spark.createDataFrame([("m.py", f"f{a}-{b}", a, b) for a, b in short], "path string, symbol string, first int, last int"))
    lines = spark.range(200).selectExpr("id", "'m.py' AS file", "explode(sequence(1, 120)) AS line").selectExpr("id", "file", "CAST(line AS INT) AS line")
    got = {(r.line, r.symbol): r.n for r in code.changed_symbols(lines.union(lines), ranges).groupBy("line", "symbol").count().withColumnRenamed("count", "n").collect()}
    def smallest(line):
        inside = min(((b - a, a, f"f{a}-{b}") for a, b in short if a <= line <= b), default=None)
        return inside[2] if inside else f"all{line - 1}"
    assert got == {(line, smallest(line)): 200 for line in range(1, 121)}


def test_changed_lines_count_on_behind_a_second_name(spark):
    patch = "+x\n@@ -1 +7 @@\n+a\n-b\n c\n+d\n--- q\n+++ b/two\r\n+e\n@@ none\n+f\n@@ -3,2 +1,2 @@\n+g"
    got = code.changed_lines(spark.createDataFrame([(2**60 + 1, patch), (None, "@@ -1 +1 @@\n+h"), (3, None)], "id long, patch string")).collect()
    assert [tuple(r) for r in got if r.id] == [(2**60 + 1, None, 7), (2**60 + 1, None, 9), (2**60 + 1, "two", 10), (2**60 + 1, "two", 11), (2**60 + 1, "two", 1)]
    assert [tuple(r) for r in got if not r.id] == [(None, None, 1)]


def test_code(spark):
    lines = code.changed_lines(spark.createDataFrame([("i", PATCH)], "id string, patch string"))
    assert {(r.file, r.line) for r in lines.collect()} == {("pkg/m.py", 21), ("pkg/m.py", 22)}
    files = spark.createDataFrame([("pkg/m.py", "\n" * 18 + "class Runner:\n    def execute(self):\n        a = 1\n        b = 2\n"), ("pkg/bad.py", "def (")], "path string, text string")
    ranges = code.symbols(files)
    assert {(r.symbol, r.first, r.last) for r in ranges.collect()} == {("Runner", 19, 22), ("Runner.execute", 20, 22)}
    assert {r.symbol for r in code.changed_symbols(lines, ranges).collect()} == {"Runner.execute"}
    issues = spark.createDataFrame([("i", "fails in /usr/lib/site-packages/pkg/m.py at execute")], "id string, text string")
    assert code.file_scores(issues, files).orderBy(F.desc("score")).first().path == "pkg/m.py"


def test_leaks(spark):
    assert one(spark, "q_0123456789abcdef", lambda t: evaluation.leak_reasons(t, F.lit("a/b.txt"))) == []
    assert one(spark, "q_1", lambda t: evaluation.leak_reasons(t, F.lit("gold/q_1.txt"))) == ["id_not_opaque", "id_in_path", "path_names_answer"]


def test_resolver(spark):
    from corpusmill.operators import resolve

    rows = [(1, "a/contract_base.txt", "NEPTUNE budget is $1. 1 May 2020"), (2, "a/amendment.txt", "NEPTUNE budget is $2. 1 May 2021"), (3, "r.txt", "NEPTUNE-Legacy budget is $3."), (4, "r.txt", "about KRONOS"), (2, "a/amendment.txt", "NEPTUNE budget is $2. 1 May 2021")]
    df = spark.createDataFrame([(9, "Compare the budget of Project NEPTUNE", ["Project NEPTUNE"], "comparison", None, *r) for r in rows], "qid long, question string, entities array<string>, intent string, marker string, block_id long, source_file string, text string")
    got = {r.block_id: r.state for r in resolve.resolved(df).collect()}
    assert got == {1: "obsolete", 2: "active", 3: "suffix_distractor", 4: "unrelated_entity"}
    assert resolve.resolved(df.withColumn("marker", F.lit("ref_0123456789"))).count() == 0


def test_field_score(spark):
    from corpusmill.operators import resolve

    score = lambda t: one(spark, t, lambda c: resolve.field_score(c, F.lit("f.txt"), F.lit("Project ALPHA"), ("budget",)))
    assert score("Project ALPHA budget is here") == pytest.approx(8 + 3 + 2 + 1.5 + 0.8)
    assert score("alpha " + "x " * 20 + "budget noise") == pytest.approx(3 + 1.5 + 0.8 - 3)


def test_contracts(spark):
    from corpusmill.operators import contracts

    blocks = [("a.txt", "Project ALPHA budget is $900,000."), ("b.txt", "Project BETA budget is $100,000.")]
    packs = spark.createDataFrame([(1, "What is the budget of Project ALPHA?", blocks)], "qid long, question string, blocks array<struct<source_file:string,text:string>>")
    made = contracts.compiled(packs)
    r = made.first()
    assert (r.answer_type, r.max_output_tokens, r.retry_tokens, r.amounts_allowed, r.sources_allowed) == ("numeric_fact", 64, 32, ["$100,000", "$900,000"], ["a.txt", "b.txt"])

    def verdict(answer, sources, tokens=5):
        row = made.crossJoin(spark.createDataFrame([(answer, sources, "$900,000", tokens)], "answer string, sources array<string>, expected string, output_tokens int"))
        return contracts.audited(row).first().verdict

    assert verdict("$900,000", ["a.txt"]) == "PASS" and verdict(None, []) == "MODEL_PARSE_FAIL"
    assert verdict("$999,999", ["a.txt"]) == "HALLUCINATION_FAIL" and verdict("$900,000", ["x.txt"]) == verdict("$900,000", []) == "SOURCE_FAIL"
    assert verdict("$900,000", ["a.txt"], 65) == "OUTPUT_BUDGET_FAIL" and verdict("no idea", ["a.txt"]) == "QUALITY_FAIL"


def test_output_and_claims(spark):
    from corpusmill.operators import contracts

    said = lambda a, proof="PARTIAL": one(spark, a, lambda c: contracts.verified_output(c, F.lit(proof), F.lit(False), F.lit("alice martin has 1,000"), F.array(F.lit("NEPTUNE-Legacy"))))
    assert said("Alice Martin 1000") == [] and said("NOT_FOUND") == [] and said("NOT_FOUND", "COMPLETE") and said("x", "ABSENT")
    assert said("NEPTUNE-Legacy") == ["forbidden: NEPTUNE-Legacy"] and said("Bob Smith") == ["not grounded: Bob Smith"]
    facts_ = spark.createDataFrame([("A", "budget", "$1", "active"), ("A", "budget", "$2", "obsolete")], "entity string, field string, value string, status string")
    claims = spark.createDataFrame([(1, "A", "budget", "$1"), (2, "A", "budget", "$2"), (3, "A", "budget", "$3"), (4, "B", "budget", "$1")], "claim_id long, entity string, field string, value string")
    assert {r.claim_id: r.state for r in contracts.verified_claims(claims, facts_).collect()} == {1: "active", 2: "obsolete", 3: "wrong_value", 4: "unknown_entity"}


def test_trimmed_by_sizes(spark):
    rows = [("a", 9000), ("a", 7000), ("a", 5000), ("a", 5000), ("a", 0), ("b", 30_000), ("b", 10), (None, 3), ("c", None)] + [("d", 300)] * 500
    out = sampling.trimmed(spark.createDataFrame(rows, "source string, n long"), "source", "n", 20_000)
    got = {r.source: (r.kept, r.n) for r in out.collect()}
    assert got == {"a": (2, 5), "b": (1, 2), None: (1, 1), "c": (1, 1), "d": (66, 500)}


def test_the_resolver_shuffles_no_texts(spark):
    row = lambda i, text, names, intent="single_fact_lookup", marker=None: (1, "What is the budget?", names, intent, marker, i, text, f"contracts/{'amendment' if i % 2 else 'base'}_{i}.txt")
    names = ["Project A.1"]
    rows = [
        row(1, "Project A.1 budget $5\n3 May 2001", names), row(3, "project a.1 budget $7\n3 May 2002", names), row(5, "Project A.1-B budget $9", names), row(7, "Project AX1 budget", names),
        row(9, None, names), row(9, None, names),
    ]
    df = spark.createDataFrame(rows, "qid long, question string, entities array<string>, intent string, marker string, block_id long, text string, source_file string")
    from corpusmill.operators import resolve

    found = resolve.resolved(df)
    assert {r.block_id: r.state for r in found.collect()} == {1: "obsolete", 3: "active", 5: "suffix_distractor", 7: "unrelated_entity", 9: "unrelated_entity"} and found.count() == 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "first(text" not in plan


def test_the_best_files_are_found_without_a_row_per_file_and_issue(spark):
    from corpusmill.functions.plans import top_k

    files = [(f"src/m{i % 97}_{i}.py", None if i % 31 == 5 else " ".join(["common", *(f"w{i * j % 19}" for j in range(i % 7))]) if i % 3 else f"class Box{i}Lid:\n    def do_{i}_it(self):\n        return common") for i in range(400)]
    issues = [(i, f"common Common w{i % 19} w{i % 5} none" + (f" see src/m{i}_{i}.py and Box{3 * i}Lid" if i % 4 == 0 else "")) for i in range(40)] + [(90, None), (91, "zzz")]
    files, issues = spark.createDataFrame(files, "path string, text string").repartition(3), spark.createDataFrame(issues, "id long, text string")
    order = [F.col("score").desc(), F.col("path")]
    for k in (9, 1000):
        expected = top_k(code.file_scores(issues, files), ["id"], order, k).select("id", "rank", "path", "score")
        assert sorted(map(tuple, code.best_files(issues, files, k).collect())) == sorted(map(tuple, expected.collect()))
    found = code.best_files(issues, files, 5)
    n = found.count()
    found.collect()
    todo, most = [found._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while todo:
        node = todo.pop()
        most = max(most, node.metrics().apply("numOutputRows").value()) if node.metrics().contains("numOutputRows") else most
        todo += [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert n == 200 and most < 40 * 380  # every issue shares a word with every file
    assert code.best_files(issues.where("id = 91"), files, 3).count() == 0


def test_owned_amounts_read_the_facts_once(spark):
    """As owners joined with resolved budgets, but with one scan of the evidence's facts."""
    kinds = ["owner", "budget", "budget", "deadline"]
    rows = [
        (f"E{i * 7 % 23}", kinds[i * 5 % 4], f"v{i % 3}", i % 9 if kinds[i * 5 % 4] == "budget" else None, "obsolete" if i % 5 == 0 else "active", f"f{i}", i, (-1 if i % 6 == 0 else 1990 + i % 4, 0, 1), i % 3, i % 2 == 0, False, i % 4 > 1 or i % 23 < 6)
        for i in range(400)
    ]
    kind = "entity string, field string, value string, amount long, status string, source_file string, block_id long, date struct<y int, m int, d int>, seq int, is_amendment boolean, is_base boolean, is_noise boolean"
    table = spark.createDataFrame(rows, kind)
    joined = facts.current_owners(table).join(facts.resolved(table.where("field = 'budget'"), ["entity"]).select("entity", "amount"), "entity")
    found = facts.owned_amounts(table, "budget")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.select("owner", "entity", "amount").collect())) and found.count() > 20
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_budgets_are_those_of_the_patterns_alone(spark):
    lines = ["Project A budget is $1,200.", "cost 3 million", "usd 12k", "USD 7", "5 Thousand", "12m", "year 1996", "12 dollars or $3", "9 unit", "none", "", "1,000 usd", "4\tk", "Usd4", None, "$x 55555"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    plain = F.coalesce(*[T.found(F.col("line"), f"(?i){p}", 1) for p in T.BUDGET_PATTERNS])
    assert table.where(~T.budget_string(F.col("line")).eqNullSafe(plain)).count() == 0
