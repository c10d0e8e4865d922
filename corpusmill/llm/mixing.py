"""Mixing sources to target weights, by Pfair scheduling.

Each source is a sequence of quanta of equal size, half a block (in characters), and the
mixture a stream of slots, a quantum each. A source of weight w is entitled to w * t quanta
before slot t. The stream is scheduled in ranges of ``RANGE`` slots. At both ends of a range
every source's entitlement is rounded, exactly (weights are ratios of whole numbers) and so
that the sum is the number of slots; that fixes how many quanta m a source has in the range,
and its quantum j there is due in the window from floor(j * RANGE / m) to
ceil((j + 1) * RANGE / m): its release time and deadline. Earliest deadline first among
released quanta meets all windows and leaves the source in the next range's first state. So
ranges are scheduled apart, on the executors, and at no slot, however late, is a source
further from its target than two quanta: less than a block (one for the rounding at the
ends of the range, one for the windows, neither of them reached).

No document is dropped or repeated: a source that has run out leaves its slots empty, and
the others go on in their proportions. Documents keep a pseudo-random order within their
source (by a hash of id and text). A document belongs to the quantum in which it begins;
one longer than a quantum delays the next of its source.

Target weights, where none are given: a source's characters to the power ``POWER``,
which lifts small sources, over the sum. The driver gets a row per source, ``MAX_SOURCES``
at most (else an error).

Cases: a null source is a source of its own; sources that given weights don't name, or
give no positive weight, are an error, weights for absent sources count among the weights
and leave their slots empty. Null and empty texts weigh one character. Repeated rows are
placed each; which of them comes first makes no difference. An empty table gives no rows.
Extra columns are carried along by ``in_order``, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import small, stored, table

BLOCK_CHARS = 16_384
#: Slots of a range.
RANGE = 1 << 14
POWER = 0.5
MAX_SOURCES = 100_000
#: Documents of a source whose prefix sums one task makes.
CHUNK_ROWS = 1_000
SLOT_SCHEMA = "sid int, quantum long, slot long, release long, deadline long"


def whole(weights: list) -> list[int]:
    """Whole numbers in the proportions of ``weights`` (floats, whole numbers, fractions)."""
    exact = [Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact))
    parts = [int(w * scale) for w in exact]
    common = math.gcd(*parts)
    return [p // common for p in parts]


def served(parts: list[int], slots: int) -> list[int]:
    """Quanta per source in the first ``slots`` slots: entitlements rounded down, and up
    where most is left over, so that their sum is ``slots``."""
    total = sum(parts)
    out = [p * slots // total for p in parts]
    rest = [p * slots % total for p in parts]
    for i in sorted(range(len(parts)), key=lambda i: (-rest[i], i))[: slots - sum(out)]:
        out[i] += 1
    return out


def schedule(quanta: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Earliest deadline first over sum(quanta) slots: (source, its quantum, slot, release,
    deadline) of each slot."""
    size = sum(quanta)
    coming = [(0, i) for i, m in enumerate(quanta) if m]  # release, source
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []  # deadline, source, release
    done = [0] * len(quanta)
    for t in range(size):
        while coming and coming[0][0] <= t:
            release, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(done[i] + 1) * size // quanta[i]), i, release))
        deadline, i, release = heapq.heappop(ready)
        yield i, done[i], t, release, deadline
        done[i] += 1
        if done[i] < quanta[i]:
            heapq.heappush(coming, (done[i] * size // quanta[i], i))


def ranges_needed(parts: list[int], quanta: list[int], size: int) -> int:
    """Ranges after which every source has been served all its quanta."""
    total = sum(parts)
    return max((-(-(q + 1) * total // (p * size)) for p, q in zip(parts, quanta) if q), default=0)


def slots(spark: SparkSession, parts: list[int], quanta: list[int], size: int = RANGE) -> DataFrame:
    """SLOT_SCHEMA for the first ``quanta`` quanta of each source. Ranges are scheduled
    apart, each by one row of the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.array(quanta, np.int64)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                first, past = served(parts, k * size), served(parts, (k + 1) * size)
                rows = np.array(list(schedule([b - a for a, b in zip(first, past)])), np.int64).T
                rows[1] += np.array(first, np.int64)[rows[0]]
                rows[2:] += k * size
                rows = rows[:, rows[1] < most[rows[0]]]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), *map(pa.array, rows[1:])], names=[x.split()[0] for x in SLOT_SCHEMA.split(", ")])

    n = ranges_needed(parts, quanta, size)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, SLOT_SCHEMA)


def units(text: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.length(text), F.lit(0))).cast("long")


def placed(docs: DataFrame, kept: list[str], weights: dict | None = None, block: int = BLOCK_CHARS, size: int = RANGE) -> DataFrame:
    """Of ``docs`` (doc_id, text, source and others) a struct ``row`` of the columns
    ``kept``, with units, block, quantum, release, deadline, slot and place (characters of the
    source before it in its quantum)."""
    spark, quantum = docs.sparkSession, max(1, block // 2)
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(units(F.col("text"))).alias("units")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is not None and (missing := [r.source for r in sizes if r.source not in weights]):
        raise ValueError(f"no weight for {missing[:5]}")
    sizes.sort(key=lambda r: (r.source is None, r.source or ""))
    target = {r.source: r.units**POWER for r in sizes} if weights is None else dict(weights)
    order = [r.source for r in sizes] + [s for s in target if s not in {r.source for r in sizes}]
    parts = whole([target[s] for s in order]) if order else []
    quanta = [-(-r.units // quantum) for r in sizes] + [0] * (len(order) - len(sizes))
    plan = small(stored(slots(spark, parts, quanta, size), "slots"))
    known = spark.createDataFrame([(i, r.source, -(-r.n // CHUNK_ROWS)) for i, r in enumerate(sizes)], "sid int, _source string, chunks int")
    hashed = F.xxhash64("doc_id", "text", F.lit(20_240_501))
    rows = docs.select(F.struct(*kept).alias("row"), F.col("source").alias("_s"), units(F.col("text")).alias("units"), hashed.alias("h"), "doc_id", F.xxhash64("text").alias("_t"))
    rows = rows.join(F.broadcast(known), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s", "_source")
    fraction = F.shiftrightunsigned("h", 33) / F.lit(float(1 << 31))
    rows = rows.withColumn("chunk", F.floor(fraction * F.col("chunks")).cast("int"))
    sums = rows.groupBy("sid", "chunk").agg(F.sum("units").alias("sum"))
    before = sums.select("sid", "chunk", (F.sum("sum").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("sid", "chunk").orderBy(F.shiftrightunsigned("h", 33), "h", "doc_id", "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("units").over(inside)).join(before, ["sid", "chunk"])
    start = F.col("before") + F.col("upto") - F.col("units")
    at = F.floor(start / F.lit(quantum)).cast("long")
    rows = rows.select("row", "units", "sid", at.alias("quantum"), (start % quantum).alias("place"))
    return rows.join(plan, ["sid", "quantum"]).select(
        "row", "units", F.shiftright("quantum", 1).alias("block"), "quantum", "release", "deadline", "slot", "place"
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return placed(docs, ["doc_id", "source"]).select("row.doc_id", "row.source", "units", "block", "quantum", "release", "deadline", "slot", "place")


def in_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns, in the order of the mixture: partitions and
    rows, and so the files that are written of them, follow slot and place."""
    rows = placed(docs, docs.columns)
    ordered = rows.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
