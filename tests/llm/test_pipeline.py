"""The corpus pipeline, stage by stage, and the registered queries."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from corpusmill.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_row", F.lit("own"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_columns_and_take_effect(spark, stages):
    docs, good, sound, single, mixed, packed = stages
    assert all(x.columns == docs.columns for x in (good, sound, single, mixed))
    score = quality_classifier.scorer(spark, quality_classifier.fit(docs, quality_classifier.learning(spark.read.parquet(f"{SF}/labels.parquet"))))
    assert ids(good) == ids(docs.where(score("text") >= 0.3)) != ids(docs)
    assert ids(sound) == ids(quality_rules.rate(good).where("kept")) != ids(good)
    found = ngram_join.near_duplicates(sound).collect()
    assert ids(single) == sorted(r.doc_id for r in found if r.doc_id == r.component_id) != ids(sound)
    assert ids(mixed) == ids(single)
    assert sorted(set(ids(packed))) == ids(mixed)


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1])


def test_mixing_decides_the_order_of_sequences(spark, stages):
    name, pack = corpus_pipeline.STAGES[-1]
    placed = lambda df: sorted(map(tuple, df.select("ids_crc32", "piece", "sequence_id", "offset").collect()))
    assert placed(pack(spark, stages[-2], SF)) == placed(stages[-1])
    assert placed(stored(pack(spark, stages[-3], SF), name)) != placed(stages[-1])


def test_sequences_follow_the_mixture(spark):
    rows = [(i, "word " * (1 + i * 7 % 5), "a" if i < 300 else "b", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(1).sortWithinPartitions("doc_id")
    for given in (docs, stored(docs, "unmixed")):  # rows of a plan, rows of files
        single = packing.pack_documents(given, capacity=20, ordered=True).toPandas().sort_values("sequence_id")
        assert single.doc_id.head(150).max() < 300 <= single.doc_id.tail(150).min()
    mixed = stored(mixing.in_order(spark, docs, SF), "mixed")
    got = packing.pack_documents(mixed, capacity=20, ordered=True).toPandas().sort_values("sequence_id")
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    place = {r.doc_id: i for i, r in enumerate(mixing.placed(docs, docs.columns).select("row.doc_id", "slot", "place").orderBy("slot", "place").collect())}
    quarters = [got.doc_id.map(place)[k * len(got) // 4 : (k + 1) * len(got) // 4] for k in range(4)]
    assert all(abs(q.mean() - 150 * k - 75) < 30 for k, q in enumerate(quarters)), [q.mean() for q in quarters]
    assert len(got) == 600 and not got.duplicated(["sequence_id", "offset"]).any()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
