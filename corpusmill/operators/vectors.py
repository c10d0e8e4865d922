"""Exact vector search and the hashing embedder.

Vectors are compared by blocked matrix products in Arrow batches; each task returns its
best k rows per query, which a ranked window merges. Queries come to the driver and are
broadcast in rounds of about ``ROUND_QUERIES``, told apart by a hash; one round passes over
the vectors once. Where there is more than one, each round's result is checkpointed before
the next, so that neither driver nor executors hold more than a round's queries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.plans import broadcast_if_small, top_k

ROUND_QUERIES = 20_000
EPSILON = 1e-8
DIM = 128
FOUND = "qid long, id long, score double"


def _merge(rows: DataFrame, k: int) -> DataFrame:
    return top_k(rows, ["qid"], [F.col("score").desc(), F.col("id")], k)


class _Best:
    """Each query's k best (score, id), ties to the smaller id: arrays of queries x k."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: rows x queries. Queries whose k-th best no row reaches are left alone."""
        scores = scores.T
        some = np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= self.scores[:, -1])
        if not len(some):
            return
        mine, own = scores[some], ids
        if len(ids) > 4 * self.k:  # rows that tie with the k-th stay
            least = np.partition(mine, len(ids) - self.k, axis=1)[:, -self.k]
            wide = int((mine >= least[:, None]).sum(axis=1).max())
            best = np.argpartition(-mine, wide - 1, axis=1)[:, :wide] if wide < len(ids) else np.tile(np.arange(len(ids)), (len(some), 1))
            mine, own = np.take_along_axis(mine, best, axis=1), ids[best]
        both = np.concatenate([self.scores[some], mine], axis=1)
        names = np.concatenate([self.ids[some], np.broadcast_to(own, mine.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.scores[some], self.ids[some] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)


def _search(queries: Broadcast, vectors_of, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = queries.value
        best, norms = _Best(len(qids), k), np.linalg.norm(matrix, axis=1)
        for batch in batches:
            ids, rows = vectors_of(batch)
            for at in range(0, len(ids), 2048):
                part = rows[at : at + 2048]
                scores = (part @ matrix.T) / (np.linalg.norm(part, axis=1, keepdims=True) * norms + EPSILON)
                best.add(ids[at : at + 2048], np.round(scores, 6))
        kept = np.isfinite(best.scores)
        columns = np.repeat(qids, kept.sum(axis=1)), best.ids[kept], best.scores[kept]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["qid", "id", "score"])

    return run


def _in_rounds(rows: DataFrame, queries: DataFrame, matrix_of: Callable[[list], np.ndarray], vectors_of, k: int, each: int) -> DataFrame:
    """(qid, id, score, rank) for ``queries`` (qid and a column more), whose matrix
    ``matrix_of`` makes from that column's values."""
    spark = queries.sparkSession
    rounds = max(1, -(-queries.count() // each))
    done = []
    for i in range(rounds):
        part = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(rounds)) == i)
        asked = part.collect()
        if not asked:
            continue
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in asked]), matrix_of([r[1] for r in asked])))
        found = _merge(rows.mapInArrow(_search(sent, vectors_of, k), FOUND), k)
        if rounds > 1:
            found = found.checkpoint()
            sent.unpersist()
        done.append(found)
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], FOUND + ", rank int")


def _stored_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column("id").to_numpy(), flat.reshape(batch.num_rows, -1)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, each: int = ROUND_QUERIES) -> DataFrame:
    """(qid, id, score, rank) over ``vectors`` (id, v) for ``queries`` (qid, v), all of one
    dimension, none null. Scores are rounded to six digits."""
    matrix = lambda found: np.array(found, dtype=np.float64)
    return _in_rounds(vectors.select("id", "v"), queries.select("qid", "v"), matrix, _stored_vectors, k, each)


class HashingEmbedder:
    """Bags of hashed tokens: a token counts in bucket SHA-256 (first four bytes, little
    end first) modulo DIM; an empty text has its last bucket."""

    TOKEN = re.compile(r"[a-z0-9_]+")

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        if token not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "little") % DIM
        return self.known[token]

    def encode(self, texts: list[str | None]) -> np.ndarray:
        places: list[int] = []
        lengths = []
        for text in texts:
            tokens = self.TOKEN.findall((text or "").lower())
            places += map(self.bucket, tokens)
            lengths.append(len(tokens))
        rows = np.repeat(np.arange(len(texts)), lengths)
        out = np.bincount(rows * DIM + np.array(places, dtype=np.int64), minlength=len(texts) * DIM).reshape(-1, DIM).astype(np.float64)
        out[np.array(lengths, dtype=np.int64) == 0, -1] = 1.0
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _all_scores(queries: Broadcast, vectors_of):
    """Every row's score for every query, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = queries.value
        norms = np.linalg.norm(matrix, axis=1)
        for batch in batches:
            ids, rows = vectors_of(batch)
            step = max(1, 500_000 // max(1, len(qids)))
            for at in range(0, len(ids), step):
                part = rows[at : at + step]
                scores = np.round((part @ matrix.T) / (np.linalg.norm(part, axis=1, keepdims=True) * norms + EPSILON), 6)
                columns = np.tile(qids, len(part)), np.repeat(ids[at : at + step], len(qids)), scores.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "id", "score"])

    return run


def hashed_scores(blocks: DataFrame, queries: DataFrame, each: int = ROUND_QUERIES) -> DataFrame:
    """(qid, id, score) of all of ``blocks`` (id, text) for each of ``queries`` (qid, text), by
    cosine of hashed bags; queries are broadcast in rounds, a pass each."""
    embedder, spark = HashingEmbedder(), blocks.sparkSession
    rounds, rows = max(1, -(-queries.count() // each)), spark.createDataFrame([], FOUND)

    def embedded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("id").to_numpy(), embedder.encode(batch.column("text").to_pylist())

    for i in range(rounds):
        asked = queries.select("qid", "text").where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == i).collect()
        if asked:
            sent = spark.sparkContext.broadcast((np.array([r[0] for r in asked]), HashingEmbedder().encode([r[1] for r in asked])))
            rows = rows.unionByName(blocks.select("id", "text").mapInArrow(_all_scores(sent, embedded), FOUND))
    return rows


def hashed_vectors(blocks: DataFrame) -> DataFrame:
    """(id, v): the unit vector of each of ``blocks`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = HashingEmbedder()
        for batch in batches:
            rows = embedder.encode(batch.column("text").to_pylist())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), DIM).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), flat], names=["id", "v"])

    return blocks.select("id", "text").mapInArrow(run, "id long, v array<double>")


def hashed_cosine(one: Column, other: Column) -> Column:
    """The cosine of the hashed bags of two texts of a row; null counts as empty."""

    @F.pandas_udf("double")
    def cosine(left: pd.Series, right: pd.Series) -> pd.Series:
        embedder = HashingEmbedder()
        return pd.Series(np.einsum("ij,ij->i", embedder.encode(left.tolist()), embedder.encode(right.tolist())))

    return cosine(F.coalesce(one, F.lit("")), F.coalesce(other, F.lit("")))


def hashing_top_k(blocks: DataFrame, queries: DataFrame, k: int, each: int = ROUND_QUERIES) -> DataFrame:
    """(qid, id, score, rank) by cosine of hashed bags, of ``blocks`` (id, text) for
    ``queries`` (qid, text)."""
    embedder = HashingEmbedder()

    def embedded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("id").to_numpy(), embedder.encode(batch.column("text").to_pylist())

    return _in_rounds(blocks.select("id", "text"), queries.select("qid", "text"), HashingEmbedder().encode, embedded, k, each)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ivf_top_k(rows: DataFrame, queries: DataFrame, k: int, nlist: int | None = None, nprobe: int = 8, sample: int = 50_000, seed: int = 42) -> DataFrame:
    """(qid, rank, id, score): the k nearest by cosine among the vectors of the ``nprobe``
    cells nearest to a query. Cells are k-means centres of unit vectors, 4 * sqrt(n) and 64
    at least (``nlist``), fitted on ``sample`` rows in hash order, so never more than
    those; every vector is in one cell. With ``nprobe`` = ``nlist`` the search is exact.
    Null and zero vectors take no part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = rows.where("v IS NOT NULL").withColumn("norm", F.sqrt(_dot("v", "v"))).where("norm > 0")
    unit = unit.select("id", F.transform(F.col("v").cast("array<double>"), lambda x: x / F.col("norm")).alias("v"))
    drawn = unit.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select(array_to_vector("v").alias("features")).persist()
    n, held = unit.count(), drawn.count()
    if not held:
        return rows.sparkSession.createDataFrame([], "qid long, rank int, id long, score double")
    model = KMeans(k=max(1, min(nlist or max(64, int(4 * n**0.5)), held)), seed=seed, maxIter=10).fit(drawn)
    drawn.unpersist()
    cells = model.transform(unit.withColumn("features", array_to_vector("v"))).select("id", "v", F.col("prediction").cast("long").alias("cell"))
    centres = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "id long, v array<double>")
    probes = cosine_top_k(centres, queries, nprobe).select("qid", F.col("id").alias("cell")).join(queries.select("qid", F.col("v").alias("q")), "qid")
    near = cells.join(broadcast_if_small(probes), "cell").select("qid", "id", F.round(_dot("q", "v") / (F.sqrt(_dot("q", "q")) + EPSILON), 6).alias("score"))
    return _merge(near, k).select("qid", "rank", "id", "score")
