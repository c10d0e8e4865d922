"""Scans and sinks: text trees, JSON lines, CSV, source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import global_order

CODE_SUFFIXES = ("py", "js", "ts", "java", "go", "rs", "c", "cc", "cpp", "h", "hpp", "rb", "php", "scala", "kt", "swift", "md", "rst", "toml", "yaml", "json")
CODE_IGNORED = ("/.git/", "/node_modules/", "/__pycache__/", "/build/", "/dist/", "/venv/")
CODE_BYTES = 80_000


def read_texts(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, category, text) of a tree of text files: the path below ``root``, and its
    first folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    below = F.regexp_extract(F.col("_metadata.file_path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + r"/(.*)$", 1)
    parts = F.split("path", "/")
    return files.select(below.alias("path"), F.col("value").alias("text")).select("path", F.when(F.size(parts) > 1, parts[0]).otherwise("unknown").alias("category"), "text")


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.limit(limit) if limit is not None else rows


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each; a file is one task's work."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Texts keep their quotes, line ends and outer white space. Null is written as \N, so that
#: empty texts stay apart from it (a text that is \N itself comes back null).
CSV = {"nullValue": "\\N", "header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line; null fields stay, as nulls."""
    df.write.option("ignoreNullFields", False).json(path)


def read_code(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of source files of known kinds up to CODE_BYTES, bytes that aren't
    UTF-8 dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(CODE_SUFFIXES) + "}").load(root)
    ignored = F.lit(False)
    for x in CODE_IGNORED:
        ignored = ignored | F.contains("path", F.lit(x))
    return files.where((F.col("length") <= CODE_BYTES) & ~ignored).select("path", F.decode("content", "UTF-8").alias("text"))


def blocks(texts: DataFrame, size: int = 128) -> DataFrame:
    """(source_file, category, chunk_index, text, token_count) of texts (path, category,
    text), cleaned and cut into blocks. ``numbered_blocks`` numbers them."""
    cut = texts.select("path", "category", F.posexplode(T.chunks(T.words(T.clean_text(F.col("text"))), size)).alias("chunk_index", "w"))
    return cut.select(F.col("path").alias("source_file"), "category", "chunk_index", F.array_join("w", " ").alias("text"), F.size("w").alias("token_count"))


def numbered_blocks(blocks_: DataFrame) -> DataFrame:
    """``blocks`` with block_id: block_ and a running number in the order of paths and
    places, four digits at least."""
    rows = global_order.numbered(blocks_, [F.col("source_file"), F.col("chunk_index")])
    digits = F.col("number").cast("string")
    return rows.withColumn("block_id", F.concat(F.lit("block_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)))
