"""Fill-in-the-middle: documents cut at line ends and put together anew.

A rolling hash cuts a text's bytes into content-defined chunks, so that a passage that
documents share falls into the same chunks wherever it stands. A task keeps what it knows
of a chunk by the chunk's content: its line ends, the code points before each of them, all
its code points, whether it holds a marker, and its outermost bytes. Sums over a
document's chunks give its lines and find the chunk, and in it the place, of each cut;
chunks seen before are not looked at again.

The number of a document draws its cuts and its form: eight-digit groups of the SHA-256 of
``seed:doc_id``. Cuts lie between lines (``[^\\n]*\\n|[^\\n]+``).

Cases: null text is empty. An empty text, or one that holds a marker, stays plain (whole,
no counts). A null doc_id draws as the empty string. Texts of any length are taken whole;
their hashes are computed in pieces. Rows are judged one by one: repeated rows give
repeated rows, an empty table an empty table. Columns but doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table

SEED = 7
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Chunks have about 1024 bytes, at least LEAST (but the last), at most MOST.
MASK, LEAST, MOST = np.uint32(0xFFC00000), 256, 8192
#: Bytes of a text hashed at a time, and those before that a hash depends on.
PIECE, REACH = 1 << 20, 31
#: Bytes of chunks that a task remembers.
MEMO_BYTES = 32_000_000
GEAR = np.random.default_rng(20_240_611).integers(0, 1 << 32, 256, dtype=np.uint32)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each byte and the 31 before it."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def boundaries(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    whole, ends, last = np.frombuffer(data, np.uint8), [], 0
    for at in range(0, len(data), PIECE):
        start = max(0, at - REACH)
        found = np.flatnonzero(rolling(whole[start : at + PIECE]) & MASK == 0) + start + 1
        for end in found[found > at].tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                last = end
                ends.append(last)
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [len(data)] if len(data) > last else ends


class Chunk(NamedTuple):
    """``ends``: places after line ends; ``chars_at``: code points before those."""

    ends: list[int]
    chars_at: list[int]
    chars: int
    marked: bool
    head: bytes
    tail: bytes


def summary(chunk: bytes) -> Chunk:
    data = np.frombuffer(chunk, np.uint8)
    ends, starts = np.flatnonzero(data == 10) + 1, (data & 0xC0) != 0x80
    chars_at = np.cumsum(starts)[ends - 1] if len(ends) else ends
    return Chunk(ends.tolist(), chars_at.tolist(), int(starts.sum()), any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:])


class Memo:
    """Summaries by content: a chunk is found by its hash and compared byte by byte. The
    chunks not met for longest are forgotten beyond ``most`` bytes."""

    def __init__(self, most: int = MEMO_BYTES):
        self.known: dict[bytes, Chunk] = {}
        self.most, self.size, self.met, self.made = most, 0, 0, 0

    def of(self, chunk: bytes) -> Chunk:
        found = self.known.pop(chunk, None)
        if found is None:
            found = summary(chunk)
            self.made += 1
            self.size += len(chunk)
        else:
            self.met += 1
        self.known[chunk] = found
        while self.size > self.most and len(self.known) > 1:
            oldest = next(iter(self.known))
            del self.known[oldest]
            self.size -= len(oldest)
        return found


class Cuts:
    """A text as the sum of its chunks."""

    def __init__(self, data: bytes, memo: Memo):
        ends = boundaries(data)
        self.starts, self.size = [0, *ends[:-1]], len(data)
        self.parts = [memo.of(data[a:b]) for a, b in zip(self.starts, ends)]
        self.lines = list(accumulate((len(p.ends) for p in self.parts), initial=0))
        self.chars = list(accumulate((p.chars for p in self.parts), initial=0))
        self.n = self.lines[-1] + bool(data and not data.endswith(b"\n"))

    def marked(self) -> bool:
        tail = b""
        for p in self.parts:
            if p.marked or any(m in tail + p.head for m in MARKERS):
                return True
            tail = (tail + p.tail)[-2:]
        return False

    def after(self, lines: int) -> tuple[int, int]:
        """Bytes and code points of the first ``lines`` lines."""
        if lines == 0:
            return 0, 0
        if lines > self.lines[-1]:
            return self.size, self.chars[-1]
        k = bisect_left(self.lines, lines) - 1
        p, i = self.parts[k], lines - self.lines[k] - 1
        return self.starts[k] + p.ends[i], self.chars[k] + p.chars_at[i]


def draws(doc_id: int | None, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(data: bytes, doc_id: int | None, memo: Memo, seed: int = SEED, rate: int = 100, spm_rate: int = 50) -> tuple:
    """n, form, prefix_chars, middle_chars and output of a text."""
    cuts, (h1, h2, h3, h4) = Cuts(data, memo), draws(doc_id, seed)
    if not data or h3 % 100 >= rate or cuts.marked():
        return cuts.n, "plain", None, None, data
    first, second = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
    (a, a_chars), (b, b_chars) = cuts.after(first), cuts.after(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_rate:
        form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return cuts.n, form, a_chars, b_chars - a_chars, output


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each of ``docs`` (doc_id,
    text); of 100 documents ``rate`` are cut, of 100 of those ``spm_rate`` begin with the
    suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *transformed(t.as_py() or b"", i, memo, seed, rate, spm_rate)) for i, t in zip(ids, batch.column("text"))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return sent.mapInArrow(run, SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. No part holds a marker, and none
    can arise where two parts meet: they begin with < and end with >."""
    at = {m: F.locate(m.decode(), output) for m in MARKERS}
    part = lambda begin, end: F.substr(output, at[begin] + 3, at[end] - at[begin] - 3)
    middle = F.substr(output, at[MIDDLE] + 3)
    return (
        F.when(form == "psm", F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(text).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT *, len(lines) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
