"""N-gram Jaccard join: near-duplicate groups of documents by their word shingles, exact.

Documents are sets of hashed five-word shingles; documents of equal sets are one node.
Two nodes link when 100 * intersection >= 75 * union. The result has each document's
component under links. All links are found by the traversal of signature trees, in cells
of sets that share a rare shingle:

1. Every set gets a prefix under one global order of shingles (those frequent by a count
   sketch last, then by hash), a little longer than needed: so two linked sets share not
   one shingle of their prefixes but at least ``least_shared``. Prefix shingles are
   shuffled once; those of one node alone fall away, then the nodes with too few left.
   What stays are sets that may have company; only their texts are shingled again, once
   each, and stored. Of these whole sets, nodes fall away that share less than 3/4 of
   their shingles with all others together (``crowded``).
2. Every node goes, with its set, to one cell, that of the shingle of smallest hash among
   those it shares with others. A signature tree over the cell is traversed against
   itself; pairs that its bounds allow are compared exactly, unless links found before
   connect them. Copies meet here, and a group of thousands costs a comparison or two per
   member. Cells have a bounded number of tokens: larger ones are cut by hash, and a
   second round, by another hash, ties cut cells together.
3. What still shares enough shingles with another component is taken by family: nodes
   that such shingles connect. A family within the bound is one cell. Nodes of larger
   families go to all cells of their shingles but the largest ones (of which a linked pair
   can't have all its shared ones); cells beyond the bound are cut into tiles that meet
   each other pairwise. After that no possible link between components is left unlooked at.

No link that joins components is lost; links inside a component that is connected already
are not enumerated, so there is no count of links per document.

Cases: null texts and texts without a word have an empty set, link with nothing and are
their own component; a text of fewer than five words is one shingle. Rows of a null
doc_id join the component of their copies and never name one; a text that only such
rows have links with nothing and has a null component. Repeated rows are one node. Very long
texts are read whole. An empty table gives no rows. Only doc_id and text are read.

Shingles are 64-bit hashes (a false one in a pair of documents has a chance of about
1e-14); nodes are 64-bit hashes of sets, checked for collisions by a second hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import arrow_batches, discard, marked, shuffles_freed, small, stored, table
from corpusmill.llm.components import connected_components
from corpusmill.llm.signature_tree import OF, SHARE, connect

WORDS = 5
#: Buckets of the count sketch, and rows of the table that it is sent in.
SKETCH, SKETCH_PARTS = 1 << 20, 256
#: A prefix is longer by one shingle for so many of the set.
LONGER = 32
#: Tokens of a cell that one traversal takes.
CELL_TOKENS = 1_000_000
#: Rows with a shingle each, or tokens of sets, that one shuffle takes; the rest goes in
#: further rounds, so that the disk that shuffles take is bounded.
ROUND_TOKENS = 1 << 27
#: Sets whose texts are read in one pass; their ids are broadcast.
ROUND_SETS = 500_000
#: Rows of texts that are shingled together, and rows with sets in an Arrow batch.
TEXT_ROWS, SET_ROWS = 500, 500
CACHE_WORDS, CACHED_BYTES, SEEN = 100_000, 40, 100_000
_C, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

DOC_SCHEMA = "doc_id long, node long, proof long, n int, cold array<long>, hot array<long>"


class WordHashes(dict):
    """Hashes of words; those of recent short words are kept, a bounded number."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    m = len(h) - width + 1
    out = np.full(m, width, np.uint64)
    for i in range(width):
        out = out * _C + h[i : i + m]
    return _mixed(out)


def all_shingles(texts: list[str | None], hashes: WordHashes) -> list[np.ndarray]:
    """The hash of every shingle of every text, in order, repeated ones too."""
    words = [x.encode().lower().split() if x else [] for x in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    rolled = _rolled(h, WORDS) if len(h) >= WORDS else h[:0]
    stop = np.cumsum(counts)
    return [rolled[e - n : e - WORDS + 1] if n >= WORDS else _rolled(h[e - n : e], n) if n else h[:0] for n, e in zip(counts.tolist(), stop.tolist())]


def distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    return tokens[np.append(True, tokens[1:] != tokens[:-1])] if len(tokens) else tokens


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, TEXT_ROWS):
        yield batch.slice(at, TEXT_ROWS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- the count sketch ------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, hashes = np.zeros(SKETCH, np.int64), WordHashes()
    for whole in batches:
        for batch in _slices(whole):
            found = np.concatenate(all_shingles(batch.column("text").to_pylist(), hashes))
            counts += np.bincount((found >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
    parts = counts.reshape(SKETCH_PARTS, -1)
    some = [k for k in range(SKETCH_PARTS) if parts[k].any()]
    data = [np.minimum(parts[k], 2**31 - 1).astype(np.int32).tobytes() for k in some]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["part", "counts"])


def _sum(group: pa.Table) -> pa.Table:
    total = np.minimum(sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in group.column("counts")), 2**31 - 1).astype(np.int32)
    return pa.table([pa.array([group.column("part")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def frequent(docs: DataFrame) -> np.ndarray:
    """Per sketch bucket its count if that stands out from the mean, else 0. The sketch
    counts the shingles of all documents in an array of fixed size; it orders them, and
    any order gives the same result."""
    schema = "part int, counts binary"
    per_task = docs.select("text").mapInArrow(_count, schema).withColumn("salt", F.spark_partition_id() % 64)
    some = per_task.groupBy("part", "salt").applyInArrow(_sum, schema)
    counts = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.int64)
    with shuffles_freed(docs.sparkSession):
        for r in some.groupBy("part").applyInArrow(_sum, schema).collect():
            counts[r.part] = np.frombuffer(r.counts, np.int32)
    counts = counts.ravel()
    mean = counts.mean()
    return np.where(counts > mean + 6 * np.sqrt(mean) + 16, counts, 0).astype(np.int32)


# --- prefixes --------------------------------------------------------------------------


def longer(n: int) -> int:
    return 1 + n // LONGER


def least_shared(n: Column) -> Column:
    """Prefix shingles that a set of ``n`` shares with any set it links with. With t the
    least overlap, prefixes of n - t + k share k: here k is ``longer`` of the smaller
    set, which has 3/4 of the larger one's size at least."""
    return F.lit(1) + F.floor(F.ceil(n * SHARE / OF) / LONGER)


def prefix(tokens: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rare and the frequent shingles of a set's prefix."""
    n = len(tokens)
    length = min(n, n - -(-SHARE * n // OF) + longer(n))
    count = often[(tokens >> np.uint64(44)).astype(np.int64)]
    cold = tokens[count == 0][:length]
    if len(cold) == length:
        return cold, tokens[:0]
    hot = np.flatnonzero(count)
    return cold, tokens[hot[np.lexsort((tokens[hot], count[hot]))]][: length - len(cold)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _describe(sent, seed: int):
    names = [x.split()[0] for x in DOC_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hashes = sent.value, WordHashes()
        for whole in batches:
            for batch in _slices(whole):
                nodes, proofs, sizes, cold, hot = [], [], [], [], []
                for tokens in map(distinct, all_shingles(batch.column("text").to_pylist(), hashes)):
                    data = tokens.tobytes()
                    nodes.append(_signed(xxhash.xxh3_64_intdigest(data, seed)) if data else None)
                    proofs.append(_signed(xxhash.xxh64_intdigest(data, seed)) if data else None)
                    sizes.append(len(tokens))
                    x, y = prefix(tokens, often)
                    cold.append(x)
                    hot.append(y)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(proofs, pa.int64()), pa.array(sizes, pa.int32()), _lists(cold), _lists(hot)], names=names
                )

    return run


def described(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """DOC_SCHEMA and a row number for every document; the nodes (node, rep: the smallest
    doc_id, row: that document's row, copies: rows of that id); and the seed of the node
    hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs))
    for seed in range(8):
        found = stored(docs.mapInArrow(_describe(sent, seed), DOC_SCHEMA).withColumn("row", F.monotonically_increasing_id()), "shingles")
        ids = found.where("n > 0").groupBy("node", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("proof").alias("p"), F.max("proof").alias("q"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "copies")).alias("first")
        nodes = ids.groupBy("node").agg(first, F.min("p").alias("p"), F.max("q").alias("q"))
        nodes = stored(nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"), F.col("first.copies").alias("copies"), "p", "q"), "nodes")
        if not nodes.where("p <> q").limit(1).count():
            return found, nodes.select("node", "rep", "row", "copies"), seed
    raise RuntimeError("set hashes collide under every seed")


# --- shingles that nodes share ---------------------------------------------------------


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those of keys that have more than one node."""
    names = ["key", "node", "n"]
    rest = np.zeros((3, 0), np.int64)
    for batch in batches:
        if batch.num_rows:
            rows = np.concatenate([rest, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])], axis=1)
            last = np.searchsorted(rows[0], rows[0, -1])  # the last key may go on
            rest = rows[:, last:]
            yield _batch(_repeated(rows[:, :last]), names)
    yield _batch(_repeated(rest), names)


def _repeated(rows: np.ndarray) -> np.ndarray:
    if rows.shape[1] < 2:
        return rows[:, :0]
    same = rows[0, 1:] == rows[0, :-1]
    return rows[:, np.append(False, same) | np.append(same, False)]


def _batch(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    types = [pa.int32() if c == "n" else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(rows, types)], names=names)


def rounds(tokens: int | None) -> int:
    return -(-(tokens or 1) // ROUND_TOKENS)


def shared_rows(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, n: the prefix shingles that more than one node has; from here on a node
    goes by the row number of its first document, whose prefix is read. A frequent shingle
    is counted in every task first. Shingles go in rounds by their remainder; stored."""
    own = marked(found, "row", nodes.where(F.col("rep").isNotNull()).select("row"), exact=True).where("_marked").select(F.col("row").alias("node"), "n", "cold", "hot")
    n = rounds(found.agg(F.ceil(F.sum(F.col("n") * (OF - SHARE) / OF + F.col("n") / LONGER + 1))).first()[0])
    out = []
    for k in range(n):
        mine = F.pmod(F.col("key"), F.lit(n)) == k
        cold = own.select(F.explode("cold").alias("key"), "node", "n").where(mine).repartition("key").sortWithinPartitions("key")
        hot = own.select(F.explode("hot").alias("key"), "node", "n").where(mine)
        many = hot.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        out.append(stored(cold.mapInArrow(_shared, "key long, node long, n int").unionByName(hot.join(many, "key", "left_semi")), "shared"))
    return together(out)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enough(rows: DataFrame) -> DataFrame:
    """The nodes of ``rows`` (key, node, n) that have enough keys to link, stored."""
    counts = rows.groupBy("node", "n").agg(F.count("*").alias("c"))
    return stored(counts.where(F.col("c") >= least_shared(F.col("n"))).select("node"), "enough")


def still_open(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``rows`` (key, node, n) with the components so far, without nodes that have too few
    keys that join components, and then without keys that join none; stored."""
    spark = rows.sparkSession
    named = rows.drop("comp").join(small(components), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    last = stored(_joining(named), "joining")
    nodes = enough(last)
    out = stored(_joining(last.join(small(nodes), "node", "left_semi")), "open")
    for x in (last, nodes):
        discard(spark, x)
    return out


def _joining(rows: DataFrame) -> DataFrame:
    keys = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return rows.join(keys, "key", "left_semi").select("key", "node", "n", "comp")


# --- cells -----------------------------------------------------------------------------


def _token_sets(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for whole in batches:
            for batch in _slices(whole):
                ids, data = batch.column("doc_id").to_pylist(), [distinct(x).tobytes() for x in all_shingles(batch.column("text").to_pylist(), hashes)]
                sums = [_signed(xxhash.xxh3_64_intdigest(x, seed)) for x in data]
                if len(seen) > SEEN:
                    seen.clear()
                new = [(x not in seen, seen.add(x))[0] for x in zip(ids, sums)]
                rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "hash", "tokens"])
                yield rows.filter(pa.array(new, pa.bool_()))

    return run


def token_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """node and tokens (sorted 64-bit hashes) of the ``wanted`` nodes, one row each, from
    the texts of their documents; documents of the same id with other texts drop out.
    Neither texts nor sets are shuffled, but for the sets of repeated rows."""
    spark = docs.sparkSession
    known = nodes.where(F.col("rep").isNotNull()).select(F.col("node").alias("hash"), F.col("row").alias("node"), F.col("rep").alias("doc_id"), "copies")
    ids = stored(known.join(small(wanted), "node", "left_semi"), "wanted")
    n, out = max(1, -(-ids.count() // ROUND_SETS)), []
    for k in range(n):
        mine = ids.where(F.pmod("hash", F.lit(n)) == k)
        texts = marked(docs, "doc_id", mine.select("doc_id")).where("_marked").select("doc_id", "text")
        sets = texts.mapInArrow(_token_sets(seed), "doc_id long, hash long, tokens binary").join(F.broadcast(mine), ["doc_id", "hash"])
        out.append(stored(sets.select("node", "tokens", "copies"), "sets"))
    sets = together(out)
    if ids.where("copies > 1").limit(1).count():
        several = sets.where("copies > 1").groupBy("node").agg(F.first("tokens").alias("tokens"))
        sets = sets.where("copies = 1").select("node", "tokens").unionByName(several)
    discard(spark, ids)
    return sets.select("node", "tokens")


def _short_keys(k: int, n: int):
    """A row for each token with remainder ``k`` by ``n``; keys of 40 bits take less room to
    shuffle, and those that fall together only keep more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
            size = np.array([len(x) for x in sets], np.int64)
            keys = np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(24)
            rows = np.stack([keys.view(np.int64), np.repeat(batch.column("node").to_numpy(), size), np.repeat(size, size)])
            yield _batch(rows[:, rows[0] % n == k] if n > 1 else rows, ["key", "node", "n"])

    return run


def crowded(sets: DataFrame) -> DataFrame:
    """The nodes that share 3/4 of their tokens at least with other nodes of ``sets``: any
    two that link do. Tokens go in rounds by their remainder."""
    spark, n = sets.sparkSession, rounds(sets.agg(F.sum(F.length("tokens") / 8).cast("long")).first()[0])
    with arrow_batches(spark, SET_ROWS):
        counts = []
        for k in range(n):
            rows = sets.mapInArrow(_short_keys(k, n), "key long, node long, n int").repartition("key").sortWithinPartitions("key")
            counts.append(stored(rows.mapInArrow(_shared, "key long, node long, n int").groupBy("node", "n").agg(F.count("*").alias("c")), "counts"))
    every = together(counts).groupBy("node", "n").agg(F.sum("c").alias("c"))
    out = stored(every.where(OF * F.col("c") >= SHARE * F.col("n")).select("node"), "crowded")
    discard(spark, together(counts))
    return out


def one_cell(rows: DataFrame, turn: int) -> DataFrame:
    """key, tile, node, comp, n: every node in the cell of its shared key of smallest hash."""
    mine = rows.groupBy("node", "n", "comp").agg(F.min_by("key", F.xxhash64("key", F.lit(turn))).alias("key"))
    sizes = mine.groupBy("key").agg(F.sum("n").alias("all"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    tile = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("all") / CELL_TOKENS)).cast("string")
    return mine.join(sizes, "key").select("key", tile.alias("tile"), "node", "comp", "n")


def families(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (key, tile, node, comp, n) of the families (nodes that shared keys connect) within
    ``CELL_TOKENS``, and the nodes of the others; both stored."""
    spark = rows.sparkSession
    least = rows.groupBy("key").agg(F.min("node").alias("least"))
    ties = stored(rows.join(least, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "ties")
    family = connected_components(ties).select("node", F.col("component").alias("family"))
    own = stored(rows.select("node", "n", "comp").distinct().join(family, "node"), "families")
    discard(spark, ties)
    large = own.groupBy("family").agg(F.sum("n").alias("all")).where(F.col("all") > CELL_TOKENS).select("family")
    cells = own.join(large, "family", "left_anti").select(F.col("family").alias("key"), F.lit("family").alias("tile"), "node", "comp", "n")
    out = stored(cells, "cells"), stored(own.join(large, "family", "left_semi").select("node"), "members")
    discard(spark, own)
    return out


def all_cells(rows: DataFrame) -> DataFrame:
    """key, tile, node, comp, n: every node in the cells of its shared keys, but for the
    largest ones: of ``least_shared`` keys that a pair shares, the one of the smallest cell
    is none of those for either. Of cells with the same nodes one is kept."""
    counted = rows.join(rows.groupBy("key").agg(F.count("*").alias("c")), "key")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("c").desc(), F.col("key").desc()))
    kept = counted.withColumn("rank", rank).where(F.col("rank") >= least_shared(F.col("n"))).select("key", "node", "n", "comp")
    like = kept.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("h"), F.min("node").alias("a"), F.max("node").alias("b"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    keys = like.where("x < y").groupBy("c", "h", "a", "b").agg(F.min("key").alias("key")).select("key")
    return tiles(kept.join(keys, "key", "left_semi")).select("key", "tile", "node", "comp", "n")


def tiles(rows: DataFrame, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """``rows`` (key, node, n, comp) with tile: a cell's rows in one tile, or, of a large
    cell, the rows of its largest component in blocks, each beside every block of the
    others, and the blocks of the others beside each other."""
    sizes = rows.groupBy("key", "comp").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max_by("comp", "n").alias("top"), F.max("n").alias("most"))
    large = sizes.where(F.col("all") > cell_tokens)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / (cell_tokens / 2))).cast("int")
    joined = rows.join(large, "key", "left")
    top, rest = blocks(F.col("most")), blocks(F.col("all") - F.col("most"))
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    pair = lambda kind, i, j: F.concat_ws("-", F.lit(kind), i.cast("string"), j.cast("string"))
    in_top = F.transform(F.sequence(F.lit(0), rest - 1), lambda i: pair("t", i, mine(top)))
    in_rest = F.concat(
        F.transform(F.sequence(F.lit(0), top - 1), lambda j: pair("t", mine(rest), j)),
        F.transform(F.sequence(F.lit(0), rest - 1), lambda j: pair("r", F.least(mine(rest), j), F.greatest(mine(rest), j))),
    )
    where = F.when(F.col("all").isNull(), F.array(F.lit("all"))).when(F.col("comp") == F.col("top"), in_top).otherwise(in_rest)
    return joined.withColumn("tile", F.explode(where)).drop("all", "top", "most")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Nodes, components and sets of each cell, of rows sorted by key and tile."""
    at, cell = None, ([], [], [])
    for batch in batches:
        tokens = batch.column("tokens")
        for key, tile, node, comp, i in zip(*(batch.column(c).to_pylist() for c in ("key", "tile", "node", "comp")), range(batch.num_rows)):
            if (key, tile) != at:
                yield cell
                at, cell = (key, tile), ([], [], [])
            for column, x in zip(cell, (node, comp, np.frombuffer(tokens[i].as_buffer(), np.uint64))):
                column.append(x)
    yield cell


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes, comps, sets in _cells(batches):
        if len(nodes) > 1:
            names, labels = np.unique(np.array(comps, np.int64), return_inverse=True)
            root = connect(sets, labels)
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[root[tied]])], names=["a", "b"])


def linked(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: of the components of ``cells`` (key, tile, node, comp, n: stored) that links in
    their cell connect, each with the smallest one there; stored. Cells go in rounds by
    hash, with the sets of their nodes alone."""
    spark, n, out = cells.sparkSession, rounds(cells.agg(F.sum("n")).first()[0]), []
    for k in range(n):
        mine = cells if n == 1 else stored(cells.where(F.pmod(F.xxhash64("key", "tile"), F.lit(n)) == k), "cells")
        own = marked(sets, "node", mine.select("node"), exact=True).where("_marked").select("node", "tokens")
        dealt = own.join(small(mine.drop("n")), "node").repartition("key", "tile").sortWithinPartitions("key", "tile")
        with arrow_batches(spark, SET_ROWS):
            out.append(stored(dealt.select("key", "tile", "node", "comp", "tokens").mapInArrow(_linked, "a long, b long"), "links"))
        discard(spark, mine)
    if n > 1:
        discard(spark, cells)
    return together(out)


def renamed(edges: DataFrame) -> DataFrame:
    return stored(connected_components(edges), "renamed")


def merged(components: DataFrame, named: DataFrame) -> DataFrame:
    """``components`` (node, component) with those of ``named`` (node, component) renamed,
    stored."""
    new = named.select(F.col("node").alias("component"), F.col("component").alias("into"))
    out = stored(components.join(small(new), "component", "left").select("node", F.coalesce("into", "component").alias("component")), "components")
    discard(components.sparkSession, components)
    return out


# --- the join --------------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    whole, nodes, seed = described(docs)
    shared = shared_rows(whole, nodes)
    found = stored(whole.select("doc_id", "n", "node"), "found")
    discard(spark, whole)
    some = enough(shared)
    sets = token_sets(docs, nodes, some, seed)
    core = crowded(sets)
    components = stored(core.select("node", F.col("node").alias("component")), "components")
    rows = still_open(shared.join(small(core), "node", "left_semi"), components)
    discard(spark, shared)
    stars = linked(stored(one_cell(rows, 0), "cells"), sets)  # one cell each: no chains
    components = merged(components, stars.select(F.col("a").alias("node"), F.col("b").alias("component")))
    rows = still_open(last := rows, components)
    discard(spark, last)
    components = merged(components, renamed(linked(stored(one_cell(rows, 1), "cells"), sets)))
    rows = still_open(last := rows, components)
    discard(spark, last)
    cells, members = families(rows)
    components = merged(components, renamed(linked(cells, sets)))
    if not members.isEmpty():
        rows = still_open((last := rows).join(small(members), "node", "left_semi"), components)
        discard(spark, last)
        components = merged(components, renamed(linked(stored(all_cells(rows), "cells"), sets)))
    for x in (sets, core, some, rows, members):
        discard(spark, x)
    components = components.withColumnRenamed("node", "row")
    named = nodes.join(components, "row", "left")
    least = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component", "left").select("node", F.coalesce("least", "rep").alias("least"))
    return found.select("doc_id", "n", "node").join(named, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null last, and among equal
    ids that of the smallest hash. Components are found on a hash of id and text in place
    of the id: so rows of a null id link like others, and different texts of one id are
    told apart. Of repeated rows (id and text) one stays, but rows without a word and
    without an id stay each. Only rows that may fall away or repeat (``marked``) are joined
    and shuffled; the others' texts stay where they are read."""
    key = F.xxhash64("doc_id", "text")
    found = stored(near_duplicates(docs.select(key.alias("doc_id"), "text")), "near-duplicates")
    found = found.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_component"), (F.col("n_shingles") == 0).alias("_empty")).distinct()
    rows = docs.select(key.alias("_key"), "doc_id").groupBy("_key", "doc_id").agg(F.count("*").alias("_rows")).join(found, "_key")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))
    stay = rows.groupBy("_component").agg(first.alias("_first")).select("_first._key", F.lit(True).alias("_stays"))
    keys = rows.groupBy("_key").agg(F.sum("_rows").alias("_rows"), F.first("_empty").alias("_empty")).join(stay, "_key", "left")
    some = stored(keys.where("_stays IS NULL OR _rows > 1").select("_key", F.coalesce("_stays", F.lit(False)).alias("_stays"), "_empty"), "some")
    looked = marked(docs.withColumn("_key", key), "_key", some.select("_key"))
    each = F.when(F.col("_empty") & F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rest = looked.where("_marked").join(small(some), "_key", "left").where("coalesce(_stays, true)").withColumn("_each", each).dropDuplicates(["_key", "_each"])
    return looked.where("NOT _marked").select(*docs.columns).unionByName(rest.select(*docs.columns))
