"""Ranked lexical search without an index of the documents: an automaton of all item
terms reads every text.

Items are cut into terms, which go into one Aho-Corasick automaton, each between two
guards (a blank). A text's other separators become guards too, so that a term is found
only where it stands whole; two terms may share the guard between them. The automaton's
outputs are term numbers, and a list per term names its items. Texts are read twice: for
document frequencies and lengths, summed up within a task first; then for the scores,
where a task keeps the ``k`` best documents of each item. What is shuffled is a count per
term and task, and k rows per item and task.

Items go to the executors in rounds of a bounded size of terms, all of an item's terms in
one round; every round reads the texts.

Cases: null and empty texts have no terms and don't count as documents with terms. Texts
of any length are read whole, in pieces that end at guards. Rows of documents are judged
one by one, so repeated rows are ranked beside each other; a null doc_id comes after all
others of its score. Rows of items that are equal in item_id and text are one; those of
equal item_id and different texts are one item with the terms of all. A null item_id is
an item like others. An item without terms, or whose terms no document holds, has no rows;
empty tables give no rows. Columns but doc_id, item_id and text aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import stored, table

K = 20
#: Bytes of item terms that a round's automaton holds.
ROUND_BYTES = 1_000_000
#: Bytes of a text that the automaton reads at a time.
PIECE = 4_000_000
#: Candidate rows of a task between two selections of the k best.
HELD = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term: letters and digits of ASCII, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same of UTF-8 bytes: lower case for A-Z, a guard for what parts terms.
GUARD = 0x20
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else GUARD for b in range(256)).lower()
COUNTED, SUMMED = -1, -2
COUNT_SCHEMA = "key long, n long"
FOUND_SCHEMA = "item_id long, doc_id long, score long"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of items (item_id, text)."""
    one = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return one.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


class Wanted:
    """A round's items: their ids, the terms, and for each term its items and repeats."""

    def __init__(self, rows: list[tuple[int | None, str, int]]):
        self.item_ids = list({i: None for i, _, _ in rows})
        self.terms = sorted({t for _, t, _ in rows})
        item, term = {x: n for n, x in enumerate(self.item_ids)}, {x: n for n, x in enumerate(self.terms)}
        uses = sorted((term[t], item[i], n) for i, t, n in rows)
        self.first = np.searchsorted([u[0] for u in uses], np.arange(len(self.terms) + 1))
        self.item = np.array([u[1] for u in uses], np.int64)
        self.repeats = np.array([u[2] for u in uses], np.int64)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for n, t in enumerate(self.terms):
            found.add_word(f" {t} ".encode().decode("latin-1"), n)
        found.make_automaton()
        return found


def pieces(data: bytes, most: int = PIECE) -> Iterator[bytes]:
    """``data`` with guards, in parts that begin and end with one. A longer term than
    ``most`` stays whole."""
    data = b" %b " % data.translate(BYTES)
    at = 0
    while at < len(data) - 1:
        end = len(data) - 1 if at + most >= len(data) else data.find(b" ", at + most)
        yield data[at : end + 1]
        at = end


def scanned(automaton, data: bytes, most: int = PIECE) -> tuple[int, Counter]:
    """The number of terms of a text, and how often it holds each of the automaton's."""
    n, found = 0, Counter()
    for part in pieces(data, most):
        guard = np.frombuffer(part, np.uint8) == GUARD
        n += int(np.count_nonzero(guard[:-1] & ~guard[1:]))
        found.update(map(itemgetter(1), automaton.iter(part.decode("latin-1"))))
    return n, found


def counts(docs: DataFrame, sent) -> DataFrame:
    """(key, n): documents that hold a term, by its number; COUNTED documents have terms,
    SUMMED of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, total = sent.value.automaton(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                n, found = scanned(automaton, text.as_py() or b"")
                total.update(found.keys())
                total.update({COUNTED: int(n > 0), SUMMED: n})
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["key", "n"])

    return docs.select("text").mapInArrow(run, COUNT_SCHEMA).groupBy("key").agg(F.sum("n").alias("n"))


class Best:
    """The k best documents of each item met so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.held, self.parts = k, 0, []
        self.bar = np.ones(n_items, np.int64)

    def add(self, doc: tuple[bool, int], scores: np.ndarray) -> None:
        """A document's scores by item."""
        items = np.flatnonzero(scores >= self.bar)
        if len(items):
            missing, number = (np.full(len(items), x, np.int64) for x in doc)
            self.parts.append(np.stack([items, -scores[items], missing, number]))
            self.held += len(items)
            if self.held > max(HELD, 4 * self.k * len(self.bar)):
                self.select()

    def select(self) -> np.ndarray:
        if not self.parts:
            return np.empty((4, 0), np.int64)
        rows = np.concatenate(self.parts, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        start = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - start
        last = place == self.k - 1
        self.bar[rows[0, last]] = -rows[1, last]
        rows = rows[:, place < self.k]
        self.parts, self.held = [rows], rows.shape[1]
        return rows


def doc_scores(wanted: Wanted, weights: np.ndarray, found: Counter, m: int) -> np.ndarray:
    """The score of each item for a document that holds the terms ``found``."""
    term, tf = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
    many = wanted.first[term + 1] - wanted.first[term]
    use = np.repeat(wanted.first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
    scores = np.zeros(len(wanted.item_ids), np.int64)
    np.add.at(scores, wanted.item[use], np.repeat(part, many) * wanted.repeats[use])
    return scores


def best_in_tasks(docs: DataFrame, sent, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        automaton, best = wanted.automaton(), Best(len(wanted.item_ids), k)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, found = scanned(automaton, text.as_py() or b"")
                if found:
                    m = 100 - 25 + 25 * n * n_docs // n_terms
                    best.add((doc_id is None, doc_id or 0), doc_scores(wanted, weights, found, m))
        items, negative, missing, number = best.select()
        ids = pa.array(wanted.item_ids, pa.int64()).take(pa.array(items))
        yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int64(), mask=missing == 1), pa.array(-negative)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, FOUND_SCHEMA)


def search(docs: DataFrame, items: DataFrame, k: int = K, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of
    ``items`` (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = stored(item_terms(items), "item-terms")
    total = asked.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    rounds = -(-total // round_bytes)
    found = spark.createDataFrame([], FOUND_SCHEMA)
    for n in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == n)
        wanted = Wanted([tuple(r) for r in part.select("item_id", "term", "repeats").collect()])
        if not wanted.terms:
            continue
        sent = spark.sparkContext.broadcast(wanted)
        df = {r.key: r.n for r in counts(docs, sent).collect()}
        n_docs, n_terms = df.get(COUNTED, 0), df.get(SUMMED, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(wanted.terms))], np.int64)
        found = found.unionByName(best_in_tasks(docs, sent, weights, n_docs, n_terms, k))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _sql_terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_terms("text")} AS t FROM documents),
size AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS nn, sum(len(t))::BIGINT AS l FROM d),
q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest({_sql_terms("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p CROSS JOIN size GROUP BY term),
s AS (
  SELECT item_id, r, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // l)))))::BIGINT AS score
  FROM p JOIN q USING (term) JOIN w USING (term) CROSS JOIN size GROUP BY ALL
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
