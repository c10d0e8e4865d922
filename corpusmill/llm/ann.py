"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: vectors are scaled to length 1 and rotated by a fixed random orthogonal matrix;
a vector's code is the signs of its coordinates, packed, with a correction scalar (the
inner product of vector and code). Vectors lie in blocks of bounded size, by hashed id.

Search: a query is rotated alike and rounded to eight bit planes; popcounts of code and
planes estimate its inner product with every vector of a block, and the code's error
bound says how far off that may be. Vectors whose upper end reaches the k-th lower end
are compared exactly, on the original vectors. The queries are a stated set, sent in
rounds of bounded size to where the index blocks are: these are read once a round and
never shuffled, and a block returns k rows per query of its dimension.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component take
no part, neither as queries nor as candidates. Rows of one vec_id are one vector (the
smallest in the order of its components), found by an aggregate before any group is
made. Very large or small components don't overflow: a vector is scaled by a power of two
first. Only vectors of a query's dimension are its candidates. Equal
scores go to the smaller vec_id; with fewer than k candidates, all are returned. Empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import arrow_batches, stored, table

K = 5
QUERY_MOD = 50
INDEX_BLOCK = 4096
QUERY_BLOCK = 1024
#: Bytes of query vectors that a round broadcasts.
ROUND_BYTES = 32_000_000
PLANES = 8
#: Standard deviations of the error bound.
SIGMAS = 3.0
SEED = 20_240_501
INDEX_SCHEMA = "dim int, block int, ids binary, vectors binary, codes binary, scalars binary"
QUERY_SCHEMA = "dim int, query_block int, ids binary, vectors binary"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, in order of ids."""
    ids = group.column("vec_id").to_numpy()
    flat = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors, order = flat.reshape(len(ids), -1), np.argsort(ids, kind="stable")
    most = np.abs(vectors).max(axis=1, keepdims=True)
    return ids[order].astype("<i8"), np.ldexp(vectors, -np.frexp(most)[1])[order]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes (rows of 64-bit words) and correction scalars."""
    dim = vectors.shape[1]
    turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(dim).T
    scalars = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return pack_bits(turned > 0), scalars


def pack_bits(bits: np.ndarray) -> np.ndarray:
    words = -(-bits.shape[-1] // 64)
    padded = np.zeros((*bits.shape[:-1], words * 64), bool)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def _index_block(keys: tuple, group: pa.Table) -> pa.Table:
    ids, vectors = _rows(group)
    codes, scalars = encode(vectors)
    columns = [[keys[0].as_py()], [keys[1].as_py()], *([x.tobytes()] for x in (ids, vectors, codes, scalars))]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])


def _query_block(keys: tuple, group: pa.Table) -> pa.Table:
    ids, vectors = _rows(group)
    columns = [[keys[0].as_py()], [keys[1].as_py()], [ids.tobytes()], [vectors.tobytes()]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in QUERY_SCHEMA.split(", ")])


def in_blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """vec_id, embedding, dim and the number of a block of about ``rows`` rows."""
    sound = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    sound = sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    one = sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = -(-sound.count() // rows) or 1
    return one.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name))


def build_index(vectors: DataFrame, rows: int = INDEX_BLOCK) -> DataFrame:
    """A row per block, of all usable vectors (vec_id, embedding)."""
    return stored(in_blocks(vectors, rows, "block").groupBy("dim", "block").applyInArrow(_index_block, INDEX_SCHEMA), "ann-index")


def estimates(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of unit ``queries`` with coded vectors, and error bounds."""
    dim = queries.shape[1]
    turned = queries @ rotation(dim).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    weighted = np.zeros((len(queries), len(codes)), np.int64)
    for p in range(PLANES):
        plane = pack_bits((levels >> p) & 1 == 1)
        for w in range(codes.shape[1]):
            weighted += np.bitwise_count(codes[None, :, w] & plane[:, w, None]).astype(np.int64) << p
    sums = levels.sum(axis=1) * step + low * dim
    signed = 2 * (low[:, None] * ones[None, :] + step[:, None] * weighted) - sums[:, None]
    found = signed / np.sqrt(dim) / scalars[None, :]
    spread = np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / np.sqrt(max(1, dim - 1))
    return found, SIGMAS * (spread[None, :] + step[:, None] / np.sqrt(3) / scalars[None, :])


def search_block(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    lengths, query_lengths = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    out = []
    for at in range(0, len(queries), 64):
        part = slice(at, at + 64)
        found, error = estimates(codes, scalars, queries[part] / query_lengths[part, None])
        found[query_ids[part, None] == ids[None, :]] = -np.inf
        least = found - error
        for j, query in enumerate(queries[part]):
            others = int(np.isfinite(found[j]).sum())
            if not others:
                continue
            kth = np.partition(least[j], -min(k, others))[-min(k, others)]
            near = np.flatnonzero((found[j] + error[j] >= kth) & np.isfinite(found[j]))
            score = (vectors[near] * query).sum(axis=1) / (lengths[near] * query_lengths[at + j])
            best = np.lexsort((ids[near], -score))[:k]
            out += [(int(query_ids[at + j]), int(ids[near[b]]), float(score[b])) for b in best]
    return out


def _met(k: int):
    """The k nearest in its index block of each query, of rows with an index block and a
    query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids, scalars = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["scalars"], "<f8")
                vectors, codes = np.frombuffer(b["vectors"], "<f8").reshape(-1, b["dim"]), np.frombuffer(b["codes"], "<u8").reshape(len(ids), -1)
                rows = search_block(ids, vectors, codes, scalars, np.frombuffer(b["q_ids"], "<i8"), np.frombuffer(b["q_vectors"], "<f8").reshape(-1, b["dim"]), k)
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = K, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The k nearest of each query (vec_id, embedding): query_id, rank, vec_id, score."""
    spark = index.sparkSession
    blocks = in_blocks(queries, QUERY_BLOCK, "query_block").groupBy("dim", "query_block").applyInArrow(_query_block, QUERY_SCHEMA)
    blocks = stored(blocks.select("dim", "query_block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "ann-queries")
    total = blocks.agg(F.sum(F.octet_length("q_vectors"))).first()[0] or 0
    rounds = max(1, -(-total // round_bytes))
    found = None
    for n in range(rounds):
        part = blocks.where(F.pmod(F.xxhash64("dim", "query_block"), F.lit(rounds)) == n)
        with arrow_batches(spark, 4):
            met = stored(index.join(F.broadcast(part), "dim").mapInArrow(_met(k), FOUND_SCHEMA), "ann-found")
        found = met if found is None else found.unionByName(met)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where(F.col("vec_id") % QUERY_MOD == 0))

