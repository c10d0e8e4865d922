"""Running numbers and ranks over all rows, in no single task.

Rows are dealt to partitions by ranges of the order and sorted there, so that a row's place
is its partition's offset and its place inside. Offsets are sums over the partitions
before: a row a partition (and group), however many rows there are. The sorted rows are
written first, as two runs of a range partitioning may cut differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.plans import broadcast_if_small, written


def ranked_globally(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """``rows`` with their place within ``by``, from ``start``, as a long; ``order`` must end
    with a unique key. A group of any size is spread over as many partitions as it needs."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the partition
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ordered")
    counts = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start).alias("_offset"))
    offsets = offsets.withColumnsRenamed({b: f"_of_{b}" for b in by})
    same = F.col("_part") == F.col("_of_part")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    found = dealt.join(broadcast_if_small(offsets.withColumnRenamed("_part", "_of_part")), same)
    return found.withColumn(name, F.col("_place") + F.col("_offset")).select(*rows.columns, name)


def numbered(rows: DataFrame, order: list[Column], name: str = "number", start: int = 0) -> DataFrame:
    """``rows`` with a running number over all of them."""
    return ranked_globally(rows.withColumn("_all", F.lit(0)), ["_all"], order, name, start).drop("_all")
