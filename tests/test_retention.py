"""Features of blocks against a plain version, and forests on a held-out part."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retention
from corpusmill.operators.vectors import HashingEmbedder


def plain(blocks, samples):
    out, embed = {}, HashingEmbedder()
    for group, (question, entity) in samples.items():
        own = sorted((i, t or "") for g, i, t in blocks if g == group)
        n, words = len(own), [t.lower().split() for _, t in own]
        mean, scores = sum(map(len, words)) / n, []
        for w in words:
            score = 0.0
            for q in (question or "").lower().split():
                df = sum(q in x for x in words)
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * w.count(q) * 2.5 / (w.count(q) + 1.5 * (1 - 0.75 + 0.75 * len(w) / mean)) if q in w else 0.0
            scores.append(round(score, 6))
        asked, best = set(re.findall(r"\d+", question or "")), max(scores)
        for k, (i, t) in enumerate(own):
            near = float(np.dot(*embed.encode([t, question or ""])))
            named = bool(entity) and re.search(rf"(?<![a-zA-Z0-9_-]){re.escape(entity.lower())}(?![a-zA-Z0-9_-])", t.lower()) is not None
            found = (scores[k] / best if best else 0.0, near, k / n, (n - 1 - k) / n, named, len(asked & set(re.findall(r"\d+", t))) / max(1, len(asked)), "active" in t.lower())
            out[group, i] = [round(float(x), 6) for x in found]
    return out


@pytest.fixture(scope="module")
def made():
    rnd, words = random.Random(3), "Iris budget status ACTIVE 2027 410 the of iris-legacy owner inactive".split()
    blocks = [(g, i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) if rnd.random() < 0.95 else None) for g in range(1, 40) for i in range(rnd.randint(1, 9))]
    samples = {g: (rnd.choice(["What is the budget of Iris in 2027?", "status 410 2027", "", None]), rnd.choice(["Iris", "", None])) for g in range(1, 40)}
    return blocks, samples


def frames(spark, made):
    blocks, samples = made
    one = spark.createDataFrame(blocks, "group long, id long, text string").repartition(5)
    return one, spark.createDataFrame([(g, *s) for g, s in samples.items()], "group long, question string, entity string")


def test_features(spark, made):
    got = {(r.group, r.id): [r[f] for f in retention.FEATURES] for r in retention.block_features(*frames(spark, made)).collect()}
    want = plain(*made)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=2e-6), key
    empty = frames(spark, made)[0].limit(0)
    assert retention.block_features(empty, frames(spark, made)[1]).count() == 0


def test_forests(spark, made):
    features = retention.block_features(*frames(spark, made))
    rows = features.select("*", ((F.col("entity") > 0) | (F.col("position") < 0.3)).alias("keep"), (F.col("group") % 4 == 0).alias("is_test"))
    got = {r.ablation: r for r in retention.forests(rows, trees=10).collect()}
    assert set(got) == set(retention.ABLATIONS)
    n = rows.groupBy("is_test").count().collect()
    assert all(r.n_train + r.n_test == sum(x["count"] for x in n) for r in got.values())
    assert got["full"].accuracy > 0.9 and got["full"].accuracy > got["semantic_only"].accuracy and got["full"].f1 > 0.9
    with pytest.raises(ValueError):
        retention.forests(rows.where("keep"))
