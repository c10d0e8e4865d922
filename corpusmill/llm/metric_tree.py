"""Exact top-k by inner product: M-trees searched best first.

Components become integers, ``floor(256 * x)``. A vector x gets one more coordinate,
``sqrt(M^2 - |x|^2)`` with M the longest length in its tree, and a query a zero there:
distances are then ``sqrt(|q|^2 + M^2 - 2 q.x)``, so that the nearest are those of the
largest inner product.

A tree is a row of pages. Entries of inner pages are routing vectors, each with its
covering radius, its distance to the routing vector of the page above, and a child page;
entries of leaves are vectors with that distance alone. Vectors are dealt to trees by
their nearest pivot and their distance to it, in runs of bounded size: any number of
vectors may share a pivot.

Search: the pages of a tree wait in a heap by the least distance that they can hold. An
entry's distance to a query is computed only if the stored distances leave it a chance:
``|d(q, parent) - d(entry, parent)| - radius`` is no more than the query's k-th distance.
Queries come in rounds of bounded size by broadcast variable; the queries of a block go
through a tree together, each pruned by its own bound. A round's bounds start from the
k-th best score in a sample, which can't be better than the final one, and a task takes
its own over from tree to tree; in a tree, the leaf that the nearest routing vectors lead
to may raise them first. Scores are exact integers; bounds are in floating point,
with a slack above its errors.

Cases: vectors that are null or hold null or non-finite components (or of 1e150 and more,
scaled) take no part. Rows of one vec_id are one vector (the smallest in the order of its
components); a null vec_id takes no part. Equal vectors are one entry with their k + 1
smallest ids: no more can be among k results. Zero vectors take part, empty ones too,
with score 0 to each other. Only vectors of a query's dimension are its candidates. Equal
scores go to the smaller vec_id; with fewer than k candidates all are returned. Scores
beyond 64 bits count as the nearest long. Empty tables give no
rows; columns but vec_id and embedding aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import stored, table

K = 5
QUERY_MOD = 50
SCALE = 256
#: Vectors and bytes of a tree at most, entries of a page.
TREE, TREE_BYTES, PAGE = 4096, 8_000_000, 64
#: Vectors of a shuffle partition where trees are built, and such partitions at most.
DEALT, MOST_DEALT = 8192, 20_000
#: The sample that gives queries their first bounds; the first of it are the pivots.
SAMPLE, PIVOTS = 4096, 128
#: Queries that go through a tree together, bytes of queries in a round.
BLOCK, ROUND_BYTES = 256, 16_000_000
#: Share of the lengths by which a distance may be off: the root of what squares may be.
SLACK = 1e-6
LARGEST = 1e150
TREE_SCHEMA = "dim int, vectors binary, ids binary, counts binary, pages array<struct<entries:binary,children:binary,radii:binary,above:binary>>"
QUERY_SCHEMA = "query_id long, v array<double>, pivot int, bar long"
FOUND_SCHEMA = "query_id long, vec_id long, score long"
#: Scores are cut to what a long and its negative hold; the least also stands for no bound.
MOST_SCORE = 2**63 - 1
LEAST_SCORE = -MOST_SCORE


# --- a tree ------------------------------------------------------------------------------


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all points ``a`` to all points ``b``."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def lifted(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` with the coordinate that makes them equally long."""
    squares = (vectors * vectors).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))])


def halves(points: np.ndarray, members: np.ndarray, most: int) -> list[np.ndarray]:
    """Groups of at most ``most`` members: halved by which of two far ones is nearer."""
    if len(members) <= most:
        return [members]
    own = points[members]
    far = between(own[:1], own)[0].argmax()
    other = between(own[far : far + 1], own)[0].argmax()
    a, b = between(own[[far, other]], own)
    order = members[np.argsort(a - b, kind="stable")]
    middle = len(members) // 2
    return halves(points, order[:middle], most) + halves(points, order[middle:], most)


def build(vectors: np.ndarray, page: int = PAGE) -> list[dict]:
    """Pages of a tree of ``vectors``, the root last. Of a page: ``entries`` (vectors by
    number), ``children`` (pages by number, -1 in a leaf), ``radii``, and distances to the
    routing vector ``above`` (zeros in the root)."""
    points, pages = lifted(vectors), []
    entries, radii, children = np.arange(len(vectors)), np.zeros(len(vectors)), np.full(len(vectors), -1)
    while True:
        groups = halves(points[entries], np.arange(len(entries)), page)
        routers, reach = [], []
        for g in groups:
            own = points[entries[g]]
            router = ((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()
            away = between(own, own[router : router + 1])[:, 0]
            pages.append({"entries": entries[g], "children": children[g], "radii": radii[g], "above": away})
            routers.append(entries[g][router])
            reach.append((away + radii[g]).max(initial=0))
        if len(groups) == 1:
            pages[-1]["above"] = np.zeros(len(entries))
            return pages
        entries, radii, children = np.array(routers), np.array(reach), np.arange(len(pages) - len(groups), len(pages))


# --- search ------------------------------------------------------------------------------


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by floating point or longs where these hold them,
    else by Python's integers."""
    most = [float(np.abs(x).max(initial=0)) for x in (queries, vectors)]
    if (size := most[0] * most[1] * queries.shape[1]) < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    if size < 2**62 and max(most) < 2**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    integers = np.frompyfunc(int, 1, 1)
    return np.clip(integers(queries).dot(integers(vectors).T), LEAST_SCORE, MOST_SCORE).astype(np.int64)


class Block:
    """Queries of one dimension, their k best (score, id) so far, and bars: scores that the
    k-th best of all reaches."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int):
        self.ids, self.queries, self.bars, self.k = ids, queries, bars.copy(), k
        self.squares = (queries * queries).sum(axis=1)
        self.found = [np.empty((2, 0), np.int64) for _ in ids]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.found[q], np.stack([-scores, ids])[:, ids != self.ids[q]]], axis=1)
        self.found[q] = rows = rows[:, np.lexsort(rows[::-1])[: self.k]]
        if rows.shape[1] == self.k:
            self.bars[q] = max(self.bars[q], -rows[0, -1])


class Tree:
    """Vectors and pages; the ids of vector n are those from first[n] to first[n + 1].
    ``computed`` counts distances and scores."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray, pages: list[dict]):
        self.vectors, self.ids, self.pages, self.computed = vectors, ids, pages, 0
        self.counts, self.first = counts, np.cumsum(counts) - counts
        self.longest = float((vectors * vectors).sum(axis=1).max(initial=0))

    def search(self, block: Block) -> None:
        """Adds to each query's best what the tree has; rows below its bar may be left out."""
        self._near_leaf(block)
        far = self._far(block, np.arange(len(block.ids)))
        #: least distance of all, place, page, queries, their distances to its routing vector, their least ones
        heap = [(0.0, 0, len(self.pages) - 1, np.arange(len(block.ids)), None, np.zeros(len(block.ids)))]
        pushed = 0
        while heap:
            _, _, number, which, to_router, least = heapq.heappop(heap)
            page, stay = self.pages[number], least <= far[which]
            which = which[stay]
            chance = np.ones((len(which), len(page["entries"])), bool)
            if to_router is not None:
                chance &= np.abs(to_router[stay][:, None] - page["above"]) - page["radii"] <= far[which, None]
            rows, some = np.flatnonzero(chance.any(axis=1)), np.flatnonzero(chance.any(axis=0))
            if not len(rows):
                continue
            which, chance, entries = which[rows], chance[np.ix_(rows, some)], page["entries"][some]
            self.computed += chance.size
            if page["children"][0] < 0:
                self._leaf(block, which, entries)
                far[which] = self._far(block, which)
                continue
            away = self._away(block, which, entries)
            nearest = np.maximum(away - page["radii"][some], 0)
            chance &= nearest <= far[which, None]
            for j in np.flatnonzero(chance.any(axis=0)):
                on, pushed = chance[:, j], pushed + 1
                heapq.heappush(heap, (float(nearest[on, j].min()), pushed, int(page["children"][some[j]]), which[on], away[on, j], nearest[on, j]))

    def _away(self, block: Block, which: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(block.squares[which, None] + self.longest - 2 * (block.queries[which] @ self.vectors[entries].T), 0))

    def _near_leaf(self, block: Block) -> None:
        """Raises each query's bar to the k-th best score of the leaf that the nearest
        routing vectors lead to."""
        todo = [(len(self.pages) - 1, np.arange(len(block.ids)))]
        while todo:
            number, which = todo.pop()
            entries, children = self.pages[number]["entries"], self.pages[number]["children"]
            self.computed += len(which) * len(entries)
            if children[0] >= 0:
                nearest = self._away(block, which, entries).argmin(axis=1)
                todo += [(int(children[c]), which[nearest == c]) for c in np.unique(nearest)]
            elif len(entries) >= block.k:
                scores = exact(block.queries[which], self.vectors[entries])
                scores[(self.counts[entries] == 1) & (self.ids[self.first[entries]] == block.ids[which, None])] = LEAST_SCORE
                block.bars[which] = np.maximum(block.bars[which], np.partition(scores, -block.k, axis=1)[:, -block.k])

    def _far(self, block: Block, which: np.ndarray) -> np.ndarray:
        """The distance of each query's bar, with the slack."""
        bars, squares = block.bars[which], block.squares[which]
        away = np.sqrt(np.maximum(squares + self.longest - 2 * bars.astype(np.float64), 0))
        return np.where(bars == LEAST_SCORE, np.inf, away + SLACK * (np.sqrt(squares) + np.sqrt(self.longest)))

    def _leaf(self, block: Block, which: np.ndarray, entries: np.ndarray) -> None:
        scores = exact(block.queries[which], self.vectors[entries])
        good = scores >= block.bars[which, None]
        for i in np.flatnonzero(good.any(axis=1)):
            own = entries[good[i]]
            many = self.counts[own]
            ids = self.ids[np.repeat(self.first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            block.add(int(which[i]), np.repeat(scores[i][good[i]], many), ids)


# --- on Spark ----------------------------------------------------------------------------


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, v: whole numbers in the floating point of the embedding, a row per vec_id."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    scaled = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * SCALE).alias("v")).where("vec_id is not null and v is not null")
    sound = scaled.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    floored = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x).cast(kind))
    return sound.select("vec_id", floored.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one dimension."""
    dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Sample:
    """Some of the vectors, by dimension: the first few are pivots, all give first bars."""

    def __init__(self, rows: list, k: int):
        self.k, by_dim = k, {}
        for r in rows:
            by_dim.setdefault(len(r.v), []).append(r)
        self.vectors = {d: np.array([r.v for r in x], np.float64).reshape(len(x), d) for d, x in by_dim.items()}
        #: of a vector that one row alone has, its id
        self.single = {d: np.array([r.ids[0] if len(r.ids) == 1 else -1 for r in x]) for d, x in by_dim.items()}
        self.is_single = {d: np.array([len(r.ids) == 1 for r in x]) for d, x in by_dim.items()}

    def pivots(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and its distance."""
        own = self.vectors.get(vectors.shape[1])
        if own is None:
            return np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        away = between(vectors, own[:PIVOTS])
        return away.argmin(axis=1).astype(np.int32), away.min(axis=1)

    def bars(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The k-th best score of each query in the sample, without itself."""
        dim = queries.shape[1]
        bars = np.full(len(queries), LEAST_SCORE)
        if dim not in self.vectors or len(self.vectors[dim]) <= self.k:
            return bars
        for at in range(0, len(queries), BLOCK):
            part = slice(at, at + BLOCK)
            scores = exact(queries[part], self.vectors[dim])
            scores[self.is_single[dim] & (self.single[dim] == ids[part, None])] = LEAST_SCORE
            bars[part] = np.partition(scores, -self.k, axis=1)[:, -self.k]
        return bars


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """v, ids: each vector once, with its k + 1 smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = whole(vectors).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def sampled(rows: DataFrame, k: int) -> Sample:
    """A bounded sample of ``entries``, by hash."""
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    few = max(PIVOTS, min(SAMPLE, TREE_BYTES // (8 * max(1, dim))))
    return Sample(rows.orderBy(F.xxhash64("v"), "ids").limit(few).collect(), k)


def _with_pivots(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch):
                pivot, away = sent.value.pivots(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([part.column("v"), part.column("ids"), pa.array(pivot), pa.array(away)], names=["v", "ids", "pivot", "away"])

    return run


def _tree_row(vectors: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
    pages = [{name: x.astype("<f8" if name in ("radii", "above") else "<i8").tobytes() for name, x in p.items()} for p in build(vectors)]
    flat, counts = np.array([i for x in ids for i in x], "<i8"), np.array([len(x) for x in ids], "<i8")
    page = pa.struct([(name, pa.binary()) for name in ("entries", "children", "radii", "above")])
    columns = [pa.array([vectors.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (vectors.astype("<f8"), flat, counts)), pa.array([pages], pa.list_(page))]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "vectors", "ids", "counts", "pages"])


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of runs of rows (v, ids) as they come."""
    vectors, ids = [], []
    for batch in batches:
        for part in _runs(batch):
            for v, i in zip(_matrix(part.column("v")), part.column("ids").to_pylist()):
                if vectors and (len(v) != len(vectors[0]) or len(vectors) == TREE or 8 * len(v) * (len(vectors) + 1) > TREE_BYTES):
                    yield _tree_row(np.array(vectors), ids)
                    vectors, ids = [], []
                vectors.append(v)
                ids.append(i)
    if vectors:
        yield _tree_row(np.array(vectors), ids)


def build_index(vectors: DataFrame, k: int = K) -> tuple[DataFrame, Sample]:
    """A row per tree, of all usable vectors (vec_id, embedding), for searches of up to
    ``k`` results; and a sample of them."""
    rows = stored(entries(vectors, k), "metric-entries")
    sample = sampled(rows, k)
    sent = rows.sparkSession.sparkContext.broadcast(sample)
    kind = dict(rows.dtypes)["v"]
    dealt = rows.mapInArrow(_with_pivots(sent), f"v {kind}, ids array<long>, pivot int, away double")
    n = min(MOST_DEALT, max(1, -(-rows.count() // DEALT)))
    order = [F.size("v"), F.col("pivot"), F.col("away"), F.xxhash64("v")]
    trees = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).select("v", "ids").mapInArrow(_planted, TREE_SCHEMA)
    return stored(trees, "metric-trees"), sample


def _read_trees(batch: pa.RecordBatch) -> Iterator[Tree]:
    for n in range(batch.num_rows):
        dim = batch.column("dim")[n].as_py()
        get = lambda name, kind, n=n: np.frombuffer(batch.column(name)[n].as_buffer(), kind)
        counts = get("counts", "<i8")
        pages = [{name: np.frombuffer(x, "<f8" if name in ("radii", "above") else "<i8") for name, x in p.items()} for p in batch.column("pages")[n].as_py()]
        yield Tree(get("vectors", "<f8").reshape(len(counts), dim), get("ids", "<i8"), counts, pages)


def _searched(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(*x, k) for x in sent.value]
        for batch in batches:
            for tree in _read_trees(batch):
                for block in blocks:
                    if block.queries.shape[1] == tree.vectors.shape[1]:
                        tree.search(block)
        for block in blocks:
            ids = np.repeat(block.ids, [x.shape[1] for x in block.found])
            found = np.concatenate(block.found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found[1]), pa.array(-found[0])], names=["query_id", "vec_id", "score"])

    return run


def _with_bars(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch):
                queries = _matrix(part.column("v"))
                pivot, bars = sent.value.pivots(queries)[0], sent.value.bars(part.column("vec_id").to_numpy(), queries)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v").cast(pa.list_(pa.float64())), pa.array(pivot), pa.array(bars)], names=["query_id", "v", "pivot", "bar"])

    return run


def _blocks(rows: list) -> list[tuple]:
    """A round's queries in blocks of one dimension, near ones together."""
    rows, out = sorted(rows, key=lambda r: (len(r.v), r.pivot, r.query_id)), []
    starts = [n for n, r in enumerate(rows) if n == 0 or len(r.v) != len(rows[n - 1].v)] + [len(rows)]
    for a, b in zip(starts, starts[1:]):
        for at in range(a, b, BLOCK):
            part = rows[at : min(b, at + BLOCK)]
            ids, bars = (np.array([getattr(r, x) for r in part], np.int64) for x in ("query_id", "bar"))
            out.append((ids, np.array([r.v for r in part], np.float64).reshape(len(part), -1), bars))
    return out


def search(index: DataFrame, sample: Sample, queries: DataFrame, k: int = K, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The k best of each query (vec_id, embedding): query_id, rank, vec_id, score."""
    if k > sample.k:
        raise ValueError(f"the index was built for {sample.k} results")
    spark = index.sparkSession
    asked = stored(whole(queries).mapInArrow(_with_bars(spark.sparkContext.broadcast(sample)), QUERY_SCHEMA), "metric-queries")
    total = asked.agg(F.sum(8 * F.size("v") + 24)).first()[0] or 0
    rounds = max(1, -(-total // round_bytes))
    found = None
    for n in range(rounds):
        part = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == n)
        sent = spark.sparkContext.broadcast(_blocks(part.collect()))
        met = stored(index.mapInArrow(_searched(sent, k), FOUND_SCHEMA), "metric-found")
        sent.unpersist()
        found = met if found is None else found.unionByName(met)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(*build_index(vectors), vectors.where(F.col("vec_id") % QUERY_MOD == 0))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e AS q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id AND len(q.v) = len(e.v)
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
