"""The corpus pipeline: documents to training sequences, in five written stages.

Every stage takes what its predecessor kept, as a table, and its result is written and
read again before the next. All but the last return the columns of ``documents``. The
mixture is the order of the fourth stage's files and rows; packing numbers its sequences
along it.

Cases: documents with a null or empty text score the sample's prior and then fail the base
rules, so none reaches the packing; a null source is a source of its own. Rows of a null
doc_id are judged and packed like others. Of repeated rows and of near copies one row
stays, by smallest doc_id (null last), and among equal ids by a hash of the text. Very long
texts are read whole. An empty table passes every stage as an empty table. Extra columns
are carried up to the packing, whatever their names; it returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from corpusmill.llm.common import stored, table


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, ordered=True)


STAGES = [
    ("quality_classifier", quality_classifier.keep_good),
    ("quality_rules", quality_rules.keep_sound),
    ("ngram_jaccard_join", ngram_join.keep_first),
    ("source_mixing", mixing.in_order),
    ("best_fit_packing", pack),
]

#: Trained models, sketches and a search can't be put in SQL: tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
