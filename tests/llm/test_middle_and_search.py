"""Fill-in-the-middle, lexical search and exact top-k against brute force and round trips,
with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from corpusmill.llm import fill_middle, lexical_search, metric_tree

# --- 11 fill in the middle ---------------------------------------------------------------


def by_lines(doc_id, text, seed=7):
    """n, form, prefix_chars, middle_chars, output by the rule itself."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_text(rnd, n):
    words = ["é", "ab", "\n", " ", "漢字", "𝄞", "\r", "\n\n", "<", "S>", "x" * 40]
    return "".join(rnd.choices(words, k=n))


def test_middles_by_the_rule():
    rnd, memo = random.Random(5), fill_middle.Memo()
    passage = some_text(rnd, 4000)
    for n in range(300):
        text = some_text(rnd, rnd.choice([0, 1, 2, 20, 700])) + (passage if n % 3 == 0 else "") + some_text(rnd, rnd.choice([0, 3, 300]))
        got = fill_middle.transformed(text.encode(), n, memo)
        assert (*got[:4], got[4].decode()) == by_lines(n, text)
    assert memo.met > 100  # the passage's inner chunks are the same wherever it stands


def test_chunks_follow_the_content():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(3_000_000))
    ends = fill_middle.boundaries(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= fill_middle.MOST and sizes[:-1].min() >= fill_middle.LEAST and 700 < sizes.mean() < 2000
    shifted = {e - 5 for e in fill_middle.boundaries(b"12345" + data)}
    assert len(shifted & set(ends)) > 0.99 * len(ends)
    assert fill_middle.boundaries(b"") == [] and fill_middle.boundaries(b"a" * 20_000) == [8192, 16384, 20_000]


def test_marker_across_chunks_stays_plain():
    for at in range(8185, 8195):  # chunks of one letter end at 8192
        for m in ("<P>", "<S>", "<M>"):
            text = "a" * at + m + "b\n" * 10
            assert fill_middle.transformed(text.encode(), 3, fill_middle.Memo())[1] == "plain"


def test_memo_is_bounded():
    memo = fill_middle.Memo(2000)
    for n in range(100):
        memo.of(bytes([n]) * 500)
    assert memo.size <= 2000 and len(memo.known) == 4


def test_middle_cases(spark):
    long = "línea\n" * 400_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (3, "one", "x"), (None, "a\nb\nc", "x"), (4, "tail\n\n\n", "x"), (5, "<P>", "x"), (6, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    made = fill_middle.fill_in_middle(docs)
    got = made.withColumn("back", fill_middle.restored(made.output, made.form)).collect()
    want = sorted(repr((i, *by_lines(i, t or ""), t or "")) for i, t, _ in rows)
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_rates(spark):
    docs = spark.createDataFrame([(n, "a\nb\nc\n") for n in range(400)], "doc_id long, text string")
    forms = collections.Counter(r.form for r in fill_middle.fill_in_middle(docs, rate=50, spm_rate=0).collect())
    assert set(forms) == {"plain", "psm"} and 150 < forms["plain"] < 250


# --- 12 lexical search -------------------------------------------------------------------


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked_lists(docs, items, k):
    each = [(i, collections.Counter(words_of(t)), len(words_of(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in each), sum(n for _, _, n in each)
    df = collections.Counter(t for _, c, _ in each for t in c)
    asked = collections.defaultdict(collections.Counter)
    for item, text in dict.fromkeys(items):
        asked[item].update(words_of(text))
    out = []
    for item, want in asked.items():
        rows = []
        for doc, c, n in each:
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_terms))) for t, r in want.items() if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, r, None if missing else doc, -s) for r, (s, missing, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


LETTERS = ["a", "b", "É", "Ab", "漢字", "x1", "a_b", "İ", "\u0085", "ab", "zz"]


def test_search_against_brute_force(spark):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice(LETTERS) + rnd.choice([" ", "--", "\n", "\0", ".", "_"]) for _ in range(n))
    docs = [(n, text(rnd.choice([0, 1, 5, 30]))) for n in range(300)] + [(400 + n, "a b a b") for n in range(40)] + [(7, None), (None, "x1 É"), (None, "x1 É"), (3, "ab ab"), (900, "ab " * 50_000)]
    items = [(n, text(rnd.choice([1, 3, 9]))) for n in range(30)] + [(50, None), (51, ""), (52, "never"), (53, "zz ab"), (53, "zz ab"), (53, "x1"), (None, "zz a")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(5)
    asked = spark.createDataFrame([(*i, 1, 1) for i in items], "item_id long, text string, doc_id int, score int")
    for k, size in ((20, 1_000_000), (3, 60)):  # one round; a few
        got = sorted((tuple(r) for r in lexical_search.search(frame, asked, k, size).collect()), key=repr)
        assert got == ranked_lists(docs, items, k)
    assert lexical_search.search(frame.limit(0), asked).count() == lexical_search.search(frame, asked.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 2, 5, 100])
def test_pieces_hold_every_term_once(most):
    wanted = lexical_search.Wanted([(1, t, 1) for t in ("a", "ab", "é", "b")])
    text = "A ab..abc é A_b\tab Éa a"
    n, found = lexical_search.scanned(wanted.automaton(), text.encode(), most)
    want = collections.Counter(words_of(text))
    assert n == sum(want.values()) and {wanted.terms[t]: c for t, c in found.items()} == {t: want[t] for t in wanted.terms if want[t]}


def test_best_of_an_item_when_rows_are_let_go(monkeypatch):
    monkeypatch.setattr(lexical_search, "HELD", 10)
    best, rnd, rows = lexical_search.Best(3, 4), random.Random(0), []
    for doc in rnd.sample(range(500), 500):
        scores = np.array([rnd.randint(0, 9) for _ in range(3)])
        best.add((False, doc), scores)
        rows += [(i, -int(s), doc) for i, s in enumerate(scores) if s > 0]
    want = [r for i in range(3) for r in sorted(r for r in rows if r[0] == i)[:4]]
    assert [tuple(x) for x in best.select()[[0, 1, 3]].T.tolist()] == want and best.held <= 12


# --- 13 exact top-k ----------------------------------------------------------------------


def best_by_hand(rows, queries, k):
    least = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x * 256) < 1e150 for x in v):
            w = [math.floor(256 * x) for x in v]
            least[i] = min(least.get(i, w), w)
    out = []
    for q in sorted(q for q in queries if q in least):
        scores = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(least[q], v)))), i) for i, v in least.items() if i != q and len(v) == len(least[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def found_by_trees(vectors, queries, k=5, **more):
    return sorted(tuple(r) for r in metric_tree.search(*metric_tree.build_index(vectors, k), queries, k, **more).collect())


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "TREE", 100)
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((8, 6))
    rows = [(n, (centres[n % 8] + 0.05 * rnd.standard_normal(6)).astype(np.float32).tolist()) for n in range(900)]
    rows += [(1000 + n, rows[17][1]) for n in range(300)] + [(2000 + n, [0.0] * 6) for n in range(40)]  # copies: ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = [i for i, _ in rows if i % 50 == 0]
    want = best_by_hand(rows, asked, 5)
    assert found_by_trees(vectors, vectors.where("vec_id % 50 = 0")) == want
    assert found_by_trees(vectors, vectors.where("vec_id % 50 = 0"), round_bytes=400) == want  # rounds


def test_topk_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, None]), (8, []), (50, [-0.001, 1.0]), (50, [-0.001, 1.0])]
    rows += [(100, []), (150, [1.0, 2.0, 3.0]), (200, [1e30, -1e30]), (201, [1e30, 1e-3]), (202, [-1e30, 1e20]), (203, [1e200, 1.0]), (9, None), (1, [2.0, 0.5]), (None, [1.0, 1.0]), (-50, [3.0, 3.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert found_by_trees(vectors, vectors.where("vec_id % 50 = 0"), 3) == best_by_hand(rows, [-50, 0, 50, 100, 150, 200], 3)
    assert found_by_trees(vectors.limit(0), vectors.limit(0)) == []
    assert found_by_trees(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")) == []
    with pytest.raises(ValueError):
        metric_tree.search(*metric_tree.build_index(vectors, 2), vectors, 3)


def test_pages_hold_their_bounds():
    rnd = np.random.default_rng(0)
    x = np.floor(256 * rnd.standard_normal((1000, 5)))
    pages, points = metric_tree.build(x, 10), metric_tree.lifted(x)

    def below(n):
        p = pages[n]
        return set(p["entries"].tolist()) if p["children"][0] < 0 else set().union(*(below(c) for c in p["children"]))

    assert below(len(pages) - 1) == set(range(1000)) and max(len(p["entries"]) for p in pages) <= 10
    for p in pages:
        for e, c, r in zip(p["entries"], p["children"], p["radii"]):
            if c >= 0:
                under = np.array(sorted(below(c)))
                assert metric_tree.between(points[under], points[[e]]).max() <= r + 1e-6
                assert np.allclose(metric_tree.between(points[pages[c]["entries"]], points[[e]])[:, 0], pages[c]["above"])


def test_bounds_save_work():
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((40, 32))
    x = centres[rnd.integers(0, 40, 4000)] + 0.1 * rnd.standard_normal((4000, 32))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    tree = metric_tree.Tree(x, np.arange(4000), np.ones(4000, int), metric_tree.build(x))
    block = metric_tree.Block(np.arange(50), x[:50], np.full(50, metric_tree.LEAST_SCORE), 5)
    tree.search(block)
    assert tree.computed < 0.45 * 50 * 4000
    for q in range(50):
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        assert [tuple(c) for c in block.found[q].T.tolist()] == want


def test_one_vector_in_most_rows(spark):
    rows = [(n, [1.0, 2.0]) for n in range(20_000)] + [(20_000 + n, [n / 100, 1.0]) for n in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    began = time.time()
    assert found_by_trees(vectors, vectors.where("vec_id % 4000 = 0"), 5) == best_by_hand(rows, range(0, 20_001, 4000), 5)
    assert time.time() - began < 60
