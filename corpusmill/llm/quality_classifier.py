"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words (lower-cased runs of letters, of digits, and of other signs)
and the trigrams of its character classes (letters by case, digits, white space, each
punctuation mark), all hashed, over the whole text, plus words equal to the word before
and lines equal to an earlier line. Their shares are square-rooted and weighted by inverse
document frequency; a truncated singular value decomposition of a bounded labelled sample
gives the latent space. The sample's vectors are broadcast; every document's vector is
multiplied with all of them in blocks, exactly, and the nearest vote with their labels,
weighted by a power of the cosine.

The sample: the ``SAMPLE_DOCS`` labelled documents of smallest hashed id, one text of each
(of several under one id that of smallest hash). The driver gets their term vectors, at
most SAMPLE_DOCS x (WORD_TERMS + CLASS_TERMS + 2) floats.

Cases: null, empty and shorter texts than three bytes have a zero vector and get the
sample's share of label 1; where nothing is labelled every score is 0.5. Equal cosines
are voted by the sample's order. Repeated rows are scored each and learned from once; an
empty table gives no rows. Extra columns are carried along by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import id_bucket, table

SAMPLE_DOCS = 3000
WORD_TERMS, CLASS_TERMS = 2048, 1024
LATENT = 48
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.3
BLOCK = 256
TERM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
#: Words whose term a task keeps, and characters of such a word at most.
CACHE_WORDS, CACHED_CHARS = 50_000, 24


def _classes() -> np.ndarray:
    """A class for every byte: bytes above 127 count as lower-case letters."""
    out = np.ones(256, np.int64)
    marks = 7
    for b in range(128):
        ch = chr(b)
        if ch.islower():
            out[b] = 1
        elif ch.isupper():
            out[b] = 2
        elif ch.isdigit():
            out[b] = 3
        elif ch == " ":
            out[b] = 4
        elif ch == "\n":
            out[b] = 5
        elif b < 32 or b == 127:
            out[b] = 6
        else:
            out[b] = marks
            marks += 1
    return out


CLASSES = _classes()


class WordTerms(dict):
    """The term of a word; those of recent short words are kept, a bounded number."""

    def __missing__(self, word: str) -> int:
        term = zlib.crc32(word.encode()) % WORD_TERMS
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = term
        return term


def features(texts: list[str | None], terms: WordTerms | None = None) -> np.ndarray:
    """Square roots of the shares of each term, a row per text."""
    terms = WordTerms() if terms is None else terms
    out = np.zeros((len(texts), WORD_TERMS + CLASS_TERMS + 2), np.float32)
    for row, text in zip(out, texts):
        if not text:
            continue
        c = CLASSES[np.frombuffer(text.encode(), np.uint8)]
        if len(c) < 3:
            continue
        words = TERM.findall(text.lower())
        row[:WORD_TERMS] = np.bincount(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)), minlength=WORD_TERMS) / max(1, len(words))
        hashed = (((c[:-2] * 40 + c[1:-1]) * 40 + c[2:]) * 2654435761 >> 7) % CLASS_TERMS
        row[WORD_TERMS:-2] = np.bincount(hashed, minlength=CLASS_TERMS) / len(c)
        words = text.split()
        lines = [x for x in text.split("\n") if x]
        row[-2] = sum(map(str.__eq__, words, words[1:])) / max(1, len(words))
        row[-1] = (len(lines) - len(set(lines))) / max(1, len(lines))
    return np.sqrt(out)


@dataclass
class Model:
    projection: np.ndarray  # features x latent, with the weights
    vectors: np.ndarray  # sample x latent, of length 1
    labels: np.ndarray

    def latent(self, found: np.ndarray) -> np.ndarray:
        out = found @ self.projection
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], terms: WordTerms | None = None) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosines = self.latent(features(texts, terms)) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, nearest, axis=1).astype(np.float64), 0.0) ** POWER
        total = weights.sum(axis=1)
        prior = float(self.labels.mean())
        return np.where(total > 1e-12, (weights * self.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-12), prior)


def latent_space(found: np.ndarray, latent: int, seed: int = 0) -> np.ndarray:
    """The projection on the first right singular vectors of the weighted features, by
    subspace iteration from a fixed seed."""
    seen = (found > 0).sum(axis=0)
    weight = (np.log((len(found) + 1) / (seen + 1)) + 1).astype(np.float32)
    rows = found * weight
    basis = np.random.default_rng(seed).standard_normal((rows.shape[1], latent + 8)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (weight[:, None] * (basis @ right.T)[:, :latent]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, latent: int = LATENT) -> Model:
    """From documents (doc_id, text) and labels (doc_id, quality), those to learn from."""
    ids = docs.select("doc_id").distinct()
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([features([x])[0].tobytes() for x in texts])

    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted((r.doc_id, r.quality, r.v) for r in one.select("doc_id", "quality", vector("text").alias("v")).collect())
    if not rows:
        return Model(np.zeros((WORD_TERMS + CLASS_TERMS + 2, latent), np.float32), np.zeros((0, latent), np.float32), np.zeros(0))
    found = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1)
    model = Model(latent_space(found, latent), np.zeros((0, latent), np.float32), np.array([r[1] for r in rows], np.float64))
    model.vectors = model.latent(found)
    return model


def scorer(spark: SparkSession, model: Model):
    """A pandas UDF: score of a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = WordTerms()
        for texts in batches:
            parts = [sent.value.score(texts.iloc[i : i + BLOCK].tolist(), terms) for i in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def learning(labels: DataFrame) -> DataFrame:
    return labels.where(id_bucket("doc_id", 5) != 0)


def held_out() -> Column:
    return F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, fit(docs, learning(table(spark, sf_dir, "labels"))))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents predicted good, with their columns."""
    score = scorer(spark, fit(docs, learning(table(spark, sf_dir, "labels"))))
    return docs.where(score("text") >= THRESHOLD)
