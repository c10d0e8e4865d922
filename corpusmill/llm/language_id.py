"""Language identification by compression.

Per language a zstandard raw-content dictionary is made of a bounded sample of labelled
texts. A text's language is the one whose dictionary compresses it to the fewest bytes;
a narrow margin to the second marks the answer as rejected. Every text is compressed
whole, in blocks of one size, so that a dictionary isn't outweighed by the text itself.

The sample: per language the labelled rows of smallest hashed id, at most
``SAMPLE_ROWS`` of them, of at most ``SAMPLE_BYTES`` together; rows that alone are longer
take no part, every other is taken whole. So fitting collects at most SAMPLE_BYTES per
language, of ``MAX_LANGS`` languages (else an error).

Cases: null texts and texts without a letter are ``und`` with score 0; so is everything
where nothing is labelled. Ties go to the language with more labelled documents, then to
the alphabetically first. Repeated rows are answered each, and learned from once; an empty
table gives no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import id_bucket, table

SAMPLE_ROWS, SAMPLE_BYTES = 256, 100_000
MAX_LANGS = 200
LEVEL, BLOCK_BYTES = 9, 2048
#: A margin is narrow if the second language takes less than this share more bytes.
LEAST_MARGIN = 0.01
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """Languages, those with most labelled rows first, with their dictionary bytes, from
    ``labelled`` (doc_id, text, lang)."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text", F.xxhash64("text").alias("t"))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t")
    rows = usable.select("lang", "doc_id", "t", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= sample_bytes).distinct()
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows)
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("lang", "doc_id", "t", "k")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    found = usable.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), ["lang", "t"]).where(same)
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in found.groupBy("lang", "k").agg(F.first("text").alias("text")).collect():
        texts.setdefault(r.lang, []).append((r.k, r.text))
    return [(x, "\n".join(t for _, t in sorted(texts[x])).lower().encode()) for x in sorted(texts, key=lambda x: (-sizes[x], x))]


class Sizes:
    """Compressed sizes of a text by language."""

    def __init__(self, model: list[tuple[str, bytes]]):
        import zstandard

        self.langs, self.compressors = [x for x, _ in model], []
        for _, sample in model:
            own = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: str) -> list[int]:
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def answer(sizes: Sizes, text: str | None) -> tuple[str, float, bool]:
    if not text or not sizes.langs or not has_letter(text):
        return UNKNOWN, 0.0, True
    found = sizes.of(text)
    best = min(range(len(found)), key=found.__getitem__)
    rest = [x for i, x in enumerate(found) if i != best]
    margin = 1.0 - found[best] / min(rest) if rest else 1.0
    return sizes.langs[best], margin, margin < LEAST_MARGIN


def predict(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """SCHEMA for each of ``docs`` (doc_id, text, held_out); ``score`` is the share of
    bytes that the answer saves over the second language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(sent.value)
        for batch in batches:
            found = [answer(sizes, x.as_py()) for x in batch.column("text")]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, SCHEMA)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)))
    return predict(docs, fit(docs.where(~F.col("held_out"))))
