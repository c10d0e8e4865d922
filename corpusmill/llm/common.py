"""What the operators share: scratch tables, table readers, labels of the learning sets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session names none (tests in local mode) a temporary folder is set
    once; on a cluster without the setting that would lose data, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a
    lost executor costs a re-read, not a re-computation."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of ``stored`` tables (``df`` reads nothing else) that no later plan
    reads."""
    for folder in _folders(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the plans made inside: for rows that
    hold whole token sets."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_freed(spark: SparkSession):
    """Actions inside delete their shuffle files when they end; else these stay until the
    driver happens to collect its garbage. For plans that run once."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Bytes of a stored table (compressed) up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, stored unless it reads files alone, to be broadcast if those are small."""
    size = sum(_bytes(df.sparkSession, name) for name in _folders(df))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Bits for each key where keys are hashed: one row in so many is marked by chance.
BITS_PER_KEY = 16


def marked(df: DataFrame, column: str, keys: DataFrame, exact: bool = False) -> DataFrame:
    """``df`` with _marked: true where ``column`` is one of ``keys`` (that column, stored),
    by broadcast bitmaps of two bytes a key. A few other rows are marked too, unless
    ``exact``: then the column must hold row numbers, from 0 and dense but for gaps."""
    place = F.col(column)
    if not exact:
        place = F.pmod(F.xxhash64(column), F.lit(max(1, BITS_PER_KEY * keys.count())))
    bucket, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bits = keys.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_bucket", bucket).join(F.broadcast(bits), "_bucket", "left")
    return found.withColumn("_marked", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def _folders(df: DataFrame) -> set[str]:
    return {name.rpartition("/")[0] for name in df.inputFiles()}


def _bytes(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``: the fold of a row."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


#: White space of the word pattern ``[^\x20\x09-\x0D]+``. ``bytes.split()`` without
#: an argument splits at exactly these six bytes, so words are
#: ``text.encode().split()``.
SPACE = r"\x20\x09-\x0D"
