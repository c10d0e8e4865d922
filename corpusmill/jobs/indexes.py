"""Indexes of the driver's tables, written once per session and state of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import shared_path
from corpusmill.operators import lexical_index

#: Low bits of a sentence's id: a text has fewer sentences than 2^31. Documents' ids are below 2^32.
SENT_BITS = 31


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, sent, id, text) of all documents; id orders sentences within and across."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), F.posexplode(T.sentences(F.col("text"))).alias("sent", "text"))
    return rows.select("doc", "sent", (F.shiftleft(F.col("doc").cast("long"), SENT_BITS) + F.col("sent")).alias("id"), "text")


def marked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_file, text): evidence texts, each with a reference marker of its own."""
    from corpusmill.jobs.fact_jobs import evidence

    mark = F.concat(F.lit("\nReference ref_"), F.substring(F.sha2(F.col("block_id").cast("string"), 256), 1, 10), F.lit("."))
    return evidence(spark, sf_dir).select(F.col("block_id").alias("id"), "source_file", F.concat("text", mark).alias("text"))


#: By kind: the blocks, the tables they come from, the analyzers that queries ask for, and whether vectors are written.
#: A query asks for one analyzer: the other one's postings aren't written for it, nor are tables that it doesn't read.
SOURCES = {
    "documents": (documents, ("documents",), ("tokens",), False),
    "document_words": (documents, ("documents",), ("words",), False),
    "sentences": (sentence_rows, ("documents",), ("words",), False),
    "evidence": (marked_evidence, ("orders", "customer", "nation"), ("tokens",), False),
    "evidence_vectors": (marked_evidence, ("orders", "customer", "nation"), ("tokens",), True),
}
_WRITTEN: dict[tuple, lexical_index.Index] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def index_of(spark: SparkSession, sf_dir: str, kind: str) -> lexical_index.Index:
    """The index of a kind of blocks: written by the first query of the session that reads
    it, and anew when files have changed."""
    rows, tables, analyzers, with_vectors = SOURCES[kind]
    key = (spark.sparkContext.applicationId, kind, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in _WRITTEN:
        path = shared_path(spark, f"index-{kind}")
        lexical_index.write(rows(spark, sf_dir), path, analyzers, with_vectors, with_entities=False)
        _WRITTEN[key] = lexical_index.read(spark, path)
    return _WRITTEN[key]
