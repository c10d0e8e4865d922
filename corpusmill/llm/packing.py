"""Best-fit packing: documents' tokens into as few sequences of bounded length as found.

Documents become pieces (only those longer than a sequence are cut). Lengths repeat, so
the packing problem is its histogram: at most ``capacity`` counts, however many pieces
there are. Bin completion runs over that histogram on the driver and returns patterns
(lengths that share a sequence) with how often each is used. Spark then numbers the
pieces of each length (within salted groups of bounded size, joined to their groups'
prefix sums) and joins each number to the pattern that takes it.

Where the order of the documents counts (``ordered``: that of the files and rows they are
read from, a mixture), the pieces of a length are numbered in that order, and the uses of
every pattern are dealt out evenly over ``EPOCHS`` parts of the plan. So the sequences of
one part take the pieces of one part of the order, whatever their lengths. More patterns
than ``PLAN_ROWS`` allows make fewer parts.

Bin completion: a sequence is made around the largest piece left; the undominated
fillings of its rest, of any number of pieces, are branched over in order of waste, and
over how often each is used; a branch is left when its waste exceeds what one sequence
less than the incumbent's allows; the first incumbent is best-fit decreasing. Fillings
are made one at a time, by a depth-first search that a table of the sums which the pieces
left can make keeps from dead ends. The search ends at the lower bound or after
``max_nodes`` nodes (patterns looked at), the one limit: then the best found so far is
returned, with no proof that there is none better.

Cases: a null or empty text is a document of one token (the end token). Repeated rows
are packed each. Very long texts are tokenized whole and cut. An empty table gives no
pieces and no sequences. Only doc_id and text are read of the input.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import stored, table

CAPACITY = 4096
END_TOKEN = 1
#: Chunks of text (words with their punctuation) in a generation of kept ids, and bytes of
#: such a chunk at most.
CACHE_CHUNKS, CACHED_BYTES = 60_000, 40
#: Pieces of one length that are numbered together.
GROUP_ROWS = 1_000
#: Parts of an ordered plan, and the rows up to which they may lengthen it.
EPOCHS, PLAN_ROWS = 64, 100_000
MAX_NODES = 20_000
#: Steps of the search, from the last, whose sums stay in memory.
KEPT_SUMS = 32
# Patterns that a dive looks at around one piece before it takes the largest that fit.
LOOKS = 50
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The default tokenizer never makes a token across white space, lower-cases, and parts
    letters from digits and from other signs. So a text's ids are those of its chunks
    between ASCII white space, and a chunk of plain letters, digits and signs is encoded
    part by part by the tokenizer's model alone, without its text normalisation, which is
    the slow part; other chunks go through the whole tokenizer. Texts that may hold a
    special token, and all texts if a probe shows the tokenizer to work otherwise, are
    encoded whole. Ids of recent chunks are kept, in two generations of bounded size.
    """

    #: Apostrophes are left out: the tokenizer treats 's, 't and others apart.
    PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
    SIMPLE = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
    LETTER = re.compile(r"[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]")
    SIGNS = b".,!%*&$#|?;:)"
    PROBE = "It's a plain Probe: naïve Ünïts, 3,141 of 2024... don't (quote) «x» ab12cd\n\tÉtait-ce ça? ***!! E=mc² ½ 日本 e\u0301"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_chunk = True
        try:
            self.by_chunk = b"".join(map(self._chunk, self.PROBE.encode().lower().split())) == self._whole(self.PROBE)
        except Exception:  # a model that can't be asked for parts
            self.by_chunk = False

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, part: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(part)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            word = chunk.rstrip(self.SIGNS)
            if chunk.isalpha():  # letters a-z alone
                found = self._plain(chunk.decode())
            elif word and len(word) < len(chunk) and self.LETTER.fullmatch(word.decode()[-1]) and b"'" not in word:
                signs = chunk[len(word) :]
                found = (self.recent.get(word) or self._chunk(word)) + (self.recent.get(signs) or self._chunk(signs))
            else:
                text = chunk.decode().lower()
                if self.SIMPLE.fullmatch(text):
                    found = b"".join([self._plain(p.translate(self.letters)) for p in self.PART.findall(text)])
                else:
                    found = self._whole(chunk.decode())
        if len(chunk) <= CACHED_BYTES:
            self.recent[chunk] = found
        return found

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or "<|" in text:
            return self._whole(text)
        if len(self.recent) > CACHE_CHUNKS:
            self.older, self.recent = self.recent, {}
        get, chunk = self.recent.get, self._chunk
        return b"".join([get(c) or chunk(c) for c in text.encode().lower().split()])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def _cut(path: str, capacity: int, also: tuple[str, ...] = ()):
    end = END_TOKEN.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            at: list[int] = []
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                ids = words.of(text.as_py()) + end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, x in zip(rows, (doc_id, k, start, len(part) // 4, zlib.crc32(part))):
                        column.append(x)
                    at.append(i)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in also]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, types)), *kept], names=["doc_id", "piece", "start", "length", "ids_crc32", *also])

    return run


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer or default_tokenizer(), capacity), PIECE_SCHEMA)


def located_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_of`` with _file and _row: the file of a document and its row there, or, if
    ``docs`` isn't read from Parquet files, its partition and row."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        n = F.monotonically_increasing_id()
        rows = docs.select("doc_id", "text", n.alias("_n")).select(
            "doc_id", "text", F.format_string("part-%d", F.shiftright("_n", 33)).alias("_file"), F.col("_n").bitwiseAND((1 << 33) - 1).alias("_row")
        )
    return rows.mapInArrow(_cut(tokenizer or default_tokenizer(), capacity, ("_file", "_row")), f"{PIECE_SCHEMA}, _file string, _row long")


def positions(pieces: DataFrame) -> DataFrame:
    """``located_pieces`` (a stored table) with _pos, their document's number from 0 in
    the order of files and rows, and _total, how many documents there are."""
    files = pieces.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    number = F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("long")
    before = F.sum("_n").over(Window.orderBy(number, "_file")) - F.col("_n")  # a row per file
    starts = files.select("_file", before.alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    return pieces.join(F.broadcast(starts), "_file").withColumn("_pos", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


# --- bin completion over a histogram of lengths ---------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the total, or the pieces over half a sequence
    with what can't lie beside them (the bound over thresholds by Martello and Toth)."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in [0, *(n for n in lengths if n <= capacity // 2)]:
        alone = sum(counts[n] for n in lengths if n > capacity - k)
        half = [n for n in lengths if capacity // 2 < n <= capacity - k]
        room = sum((capacity - n) * counts[n] for n in half)
        small = sum(n * counts[n] for n in lengths if k <= n <= capacity // 2)
        best = max(best, alone + sum(counts[n] for n in half) + max(0, -(-(small - room) // capacity)))
        if k > 256:
            break
    return best


class _Left:
    """Counts of lengths left, their sorted list, and a bit set of them."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.lengths = sorted(n for n, c in counts.items() if c > 0)
        self.bits = sum(1 << n for n in self.lengths)

    def change(self, pattern: dict[int, int], times: int) -> None:
        for n, k in pattern.items():
            before = self.counts[n]
            self.counts[n] = before - k * times
            if before and not self.counts[n]:
                del self.lengths[bisect_left(self.lengths, n)]
                self.bits ^= 1 << n
            elif not before and self.counts[n]:
                self.lengths.insert(bisect_right(self.lengths, n), n)
                self.bits ^= 1 << n

    def at_most(self, room: int) -> int:
        """The largest length left within ``room``, or 0."""
        i = bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else 0


def _greedy(left: _Left, first: int, room: int) -> dict[int, int]:
    """Largest-that-fits filling beside ``first``."""
    used = {first: 1}
    i = bisect_right(left.lengths, room) - 1
    while i >= 0 and room > 0:
        n = left.lengths[i]
        k = min(left.counts[n] - used.get(n, 0), room // n)
        if k > 0:
            used[n] = used.get(n, 0) + k
            room -= k * n
        i = min(i - 1, bisect_right(left.lengths, room) - 1)
    return used


def _size(pattern: dict[int, int]) -> int:
    return sum(n * k for n, k in pattern.items())


class _Sums:
    """Which sums up to ``room`` the pieces left can make: for each of ``lengths`` (at
    most ``room``) a bit set of the sums of it and all shorter ones."""

    def __init__(self, left: _Left, room: int):
        self.lengths = left.lengths[: bisect_right(left.lengths, room)]
        self.most = [c if (c := left.counts[n]) * n <= room else room // n for n in self.lengths]
        full = (1 << (room + 1)) - 1
        now, self.upto = 1, []
        for n, c in zip(self.lengths, self.most):
            k, before = 1, -1
            while c and now != before:  # c copies, by doubling, while one makes new sums
                before, k = now, k if k < c else c
                now |= (now << (n * k)) & full
                c -= k
                k *= 2
            self.upto.append(now)
        self.all = now

    def of(self, size: int, top: int | None = None) -> Iterator[dict[int, int]]:
        """Every multiset of pieces that sums to ``size``, those of larger pieces first.
        No step leads into a dead end."""
        if size == 0:
            yield {}
            return
        i = len(self.lengths) - 1 if top is None else top
        while i >= 0 and self.upto[i] >> size & 1:
            n, below = self.lengths[i], self.upto[i - 1] if i else 1
            for k in range(min(self.most[i], size // n), 0, -1):
                if below >> (size - k * n) & 1:
                    for rest in self.of(size - k * n, i - 1):
                        yield {n: k, **rest}
            i -= 1


def dominated(left: _Left, pattern: dict[int, int], waste: int) -> bool:
    """Whether some of the pieces of ``pattern`` (without the first) could give way to one
    piece left that is no smaller than they are together: a larger piece, or one for many,
    or one more beside them."""
    sums, many, singles = 1, 0, 0
    for n, k in pattern.items():
        for _ in range(k):
            many |= (sums & ~1) << n
            sums |= sums << n
        singles |= 1 << n
    better = (_up_to(many, waste) | (_up_to((singles | 1) << 1, waste - 1) if waste else 0)) & left.bits
    while better:
        n = (better & -better).bit_length() - 1
        if left.counts[n] > pattern.get(n, 0):
            return True
        better &= better - 1
    return False


def _up_to(sums: int, more: int) -> int:
    """The sums, and those that exceed one of them by up to ``more``."""
    done = 0
    while done < more:
        step = min(done + 1, more - done)
        sums |= sums << step
        done += step
    return sums


class Fillings:
    """The undominated patterns around the largest length left, made one at a time, least
    waste first. ``next`` gives a pattern and its waste, or None when no pattern of at
    most the allowed waste is left; ``looked`` counts the patterns looked at.

    The sums that the search needs are dropped by ``forget``, and made again if it goes on
    (by then the pieces left are the same again).
    """

    def __init__(self, left: _Left, capacity: int, without: dict[int, int] | None = None):
        self.left, self.first, self.without = left, left.lengths[-1], without
        self.room, self.looked, self.allowed, self.limit = capacity - self.first, 0, 0, 0
        self.sums: _Sums | None = None
        self.found = self._search()

    def forget(self) -> None:
        self.sums = None
        self.found = None

    def next(self, allowed: int, looks: int) -> tuple[dict[int, int], int] | None:
        """At most ``looks`` patterns are looked at."""
        self.allowed, self.limit = allowed, self.looked + looks
        if self.found is None:
            seen, self.looked = self.looked, 0
            self.found = self._search(seen)
        return next(self.found, None)

    def _search(self, seen: int = 0) -> Iterator[tuple[dict[int, int], int]]:
        left, first, room = self.left, self.first, self.room
        left.counts[first] -= 1
        alone = left.counts.get(room, 0) > 0 or room == 0
        if not alone:
            self.sums = _Sums(left, room)
        left.counts[first] += 1
        if alone:  # one piece that fills the rest is as good as any
            self.looked += 1
            pattern = {first: 1} if not room else {first: 2} if room == first else {first: 1, room: 1}
            if self.looked > seen and pattern != self.without:
                yield pattern, 0
            if pattern != self.without:
                return
            left.counts[first] -= 1
            self.sums = _Sums(left, room)
            left.counts[first] += 1
        sums = self.sums
        for waste in range(room + 1):
            if waste > self.allowed:
                return
            if not sums.all >> (room - waste) & 1:
                continue
            for rest in sums.of(room - waste):
                self.looked += 1
                if self.looked <= seen:
                    continue
                if self.looked > self.limit:
                    return
                left.counts[first] -= 1
                worse = dominated(left, rest, waste)
                left.counts[first] += 1
                pattern = {**rest, first: rest.get(first, 0) + 1}
                if not worse and pattern != self.without:
                    yield pattern, waste


def _times(left: _Left, pattern: dict[int, int]) -> int:
    return max(1, min(left.counts[n] // k for n, k in pattern.items()))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    left, plan = _Left(counts), []
    while left.lengths:
        first = left.lengths[-1]
        left.counts[first] -= 1
        pattern = _greedy(left, first, capacity - first)
        left.counts[first] += 1
        times = _times(left, pattern)
        left.change(pattern, times)
        plan.append((pattern, times))
    return plan


def dive(counts: dict[int, int], capacity: int, loose: int, looks: int = LOOKS) -> tuple[list[tuple[dict[int, int], int]], int]:
    """One descent without a way back: the first ``loose`` sequences take the largest
    pieces that fit beside the largest, all others the undominated filling of least waste
    among the first ``looks``. Returns the plan and the number of patterns looked at.

    Where no whole number of pieces of the mean length fills a sequence, some sequences
    hold one piece fewer than others; fewest are needed if those hold the largest pieces,
    so that the smaller ones are left for fuller sequences.
    """
    left, plan, nodes = _Left(counts), [], 0
    while left.lengths:
        first, found = left.lengths[-1], None
        if loose <= 0:
            fillings = Fillings(left, capacity)
            found = fillings.next(capacity, looks)
            nodes += max(1, fillings.looked)
        if found is None:
            left.counts[first] -= 1
            pattern = _greedy(left, first, capacity - first)
            left.counts[first] += 1
            nodes += loose > 0
        else:
            pattern = found[0]
        times = _times(left, pattern)
        if loose > 0:
            times = min(times, loose)
            loose -= times
        left.change(pattern, times)
        plan.append((pattern, times))
    return plan, nodes


def restarted(counts: dict[int, int], capacity: int, fewest: int, bound: int, max_nodes: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """The best plan of dives from the top, none and then ever finer steps of ``loose``
    around the best so far, until ``bound`` is met or the nodes are spent."""
    tried: dict[int, int] = {}
    best: list[tuple[dict[int, int], int]] = []
    spent, at, step = 0, 0, max(1, fewest // 4)
    ask = [0, step, 2 * step, 3 * step]
    while spent < max_nodes:
        for loose in ask:
            if loose in tried or not 0 <= loose <= fewest or spent >= max_nodes:
                continue
            plan, nodes = dive(counts, capacity, loose)
            spent += nodes
            tried[loose] = sum(t for _, t in plan)
            if not best or tried[loose] < sum(t for _, t in best):
                best, at = plan, loose
            if tried[loose] <= bound:
                return best, spent
        if step == 1:
            break
        step = max(1, step // 2)
        ask = [at - step, at + step]
    return best, spent


def complete(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; every length's count is used up. Up to half of
    the nodes go to restarts from the top, the others to one search with backtracking."""
    counts = {n: c for n, c in counts.items() if c > 0}
    if not counts:
        return []
    total, bound = sum(n * c for n, c in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(t for _, t in best)
    left, waste, used, nodes = _Left(counts), 0, 0, 0
    if fewest > bound:
        plan_, nodes = restarted(counts, capacity, fewest, bound, max_nodes // 2)
        if plan_ and sum(t for _, t in plan_) < fewest:
            best, fewest = plan_, sum(t for _, t in plan_)
    plan: list[tuple[dict[int, int], int, int]] = []  # pattern, times, waste of each
    open_ = [Fillings(left, capacity)]
    while open_ and fewest > bound and nodes < max_nodes:
        top, allowed = open_[-1], (fewest - 1) * capacity - total - waste
        if len(plan) == len(open_):  # back from below: the same pattern fewer times, then the next
            pattern, times, lost = plan.pop()
            left.change(pattern, -times)
            waste, used = waste - times * lost, used - times
            allowed += times * lost
            times -= 1
            nodes += 1
        else:
            times = 0
        if not times:
            before = top.looked
            found = top.next(allowed, max_nodes - nodes)
            nodes += max(1, top.looked - before)
            if found is None:
                open_.pop()
                continue
            pattern, lost = found
            times = _times(left, pattern)
            if lost:
                times = max(1, min(times, allowed // lost))
        left.change(pattern, times)
        plan.append((pattern, times, lost))
        waste, used = waste + times * lost, used + times
        if not left.lengths:
            if used < fewest:
                best, fewest = [(p, t) for p, t, _ in plan], used
        elif waste <= (fewest - 1) * capacity - total:
            again = left.lengths[-1] == max(pattern)
            open_.append(Fillings(left, capacity, pattern if again else None))
            if len(open_) > KEPT_SUMS:
                open_[-1 - KEPT_SUMS].forget()
    return best


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of each length, which of its pieces (numbered from 0) go where: length, from, to,
    pieces of the length in a sequence, first sequence, first offset."""
    given: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            out.append((n, given[n], given[n] + k * times, k, sequence, offset))
            given[n] += k * times
            offset += n * k
        sequence += times
    return out


def in_epochs(plan: list[tuple[dict[int, int], int]], epochs: int = EPOCHS, most: int = PLAN_ROWS) -> list[tuple[dict[int, int], int]]:
    """``plan`` in parts that each use every pattern as often, give or take one; patterns
    of few uses begin at different parts."""
    while epochs > 1 and sum(len(p) * min(t, epochs) for p, t in plan) > most:
        epochs //= 2
    phase = [int(i * 0.6180339887498949 % 1 * epochs) for i in range(len(plan))]
    upto = lambda i, e: (e * plan[i][1] + phase[i]) // epochs
    return [(p, n) for e in range(epochs) for i, (p, _) in enumerate(plan) if (n := upto(i, e + 1) - upto(i, e))]


# --- on Spark --------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_nodes: int = MAX_NODES, group_rows: int = GROUP_ROWS, ordered: bool = False) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset; ``ordered`` pieces have
    their place (_file, _row), which the numbers of the sequences follow.

    To the driver comes a count per length, ``capacity`` rows at most; the broadcast
    tables have a row per length or per length of a pattern (and part of the plan).
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if not (ordered and c in ("_file", "_row"))]
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = complete(counts, capacity, max_nodes)
    plan = slots(in_epochs(found) if ordered else found)
    places = spark.createDataFrame(plan, "length long, first long, past long, each long, sequence long, at long")
    salts = spark.createDataFrame([(n, -(-c // group_rows)) for n, c in counts.items()], "length long, salts long")
    if ordered:
        pieces, order = positions(pieces), ["_pos", "piece"]
        salt = F.floor(F.col("_pos") / F.col("_total") * F.col("salts")).cast("long")
    else:
        order = ["doc_id", "piece", "ids_crc32"]
        salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", salt).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    in_group = Window.partitionBy("length", "salt").orderBy(*order)
    numbered = (
        salted.withColumn("_k", F.row_number().over(in_group)).join(before, ["length", "salt"])
        .withColumn("_k", F.col("_k") - 1 + F.col("before"))
    )
    same = (F.col("length") == F.col("_length")) & (F.col("_k") >= F.col("first")) & (F.col("_k") < F.col("past"))
    places = places.withColumnRenamed("length", "_length")
    if ordered:  # a length has a row per pattern and part: looked up by blocks of numbers
        block = lambda k: F.floor(k / (10 * group_rows)).cast("long")
        places = places.withColumn("_block", F.explode(F.sequence(block(F.col("first")), block(F.col("past") - 1))))
        same = same & (F.col("_block") == block(F.col("_k")))
    found = numbered.join(F.broadcast(places), same)
    nth = F.col("_k") - F.col("first")
    return found.select(
        *columns,
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ordered: bool = False) -> DataFrame:
    cut = located_pieces if ordered else pieces_of
    return pack(stored(cut(docs, tokenizer, capacity), "pieces"), capacity, ordered=ordered)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
