"""Quality rules: base counts of a text, and the fertility of public tokenizers on it.

Fertility figures of a text, over its words, each encoded on its own: characters per token
of a sentencepiece vocabulary with byte fallback, the share of its byte-fallback tokens,
the entropy of its token distribution (as a share of the most that so many tokens can
have), and characters per token of a byte-level vocabulary. Per language (or, where that
is null, per script: the one of most letters) the quartiles of each figure over the
group's documents give a band; a document outside a band of its group is rejected. Figures
of short texts scatter more, so below the group's median length the band widens with the
square root of median over own length. Quartiles of few documents scatter too, so a group
of n documents has its room widened by the square root of 1 + ``min_group`` / n: one rule
at every size, and never the bands of other languages.

Quartiles are exact over figures rounded to ``STEPS`` a unit (lengths to a hundredth of
their logarithm): counts per step are aggregated in every task, so neither partitions nor
retries change them, and no task holds a group's documents.

Cases: null and empty texts have zero counts and fail the base rules (n_words < 50); so
they never reach the bands. Very long texts are read whole. Repeated rows count and are
judged each. An empty table gives an empty result. Of extra columns only doc_id, text and
lang are read.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import small, stored, table

SYMBOLS = re.compile(r"[#*$%&|<>]")
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARABIC", "HEBREW", "DEVANAGARI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "THAI")
MIN_WORDS = 50
#: Words of a generation that a task keeps the encodings of, and bytes of such a word at most.
CACHE_WORDS, CACHED_BYTES = 80_000, 40
#: Texts whose words are encoded together.
TEXT_ROWS = 100
#: A band reaches so many times the distance between the quartiles beyond them, and at
#: least so far (the figures' units).
REACH = 3.5
LEAST_REACH = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.12, "chars_per_byte_token": 0.05}
STEPS = 1000
#: Documents of a group whose room is wider by the square root of two.
MIN_GROUP = 50

STATS_SCHEMA = (
    "group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double, chars_per_byte_token double"
)
STATS = [x.split()[0] for x in STATS_SCHEMA.split(", ")]


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most letters of the whole text; ties go to the first of SCRIPTS."""
    letters: Counter = Counter()
    for ch, n in Counter(text).items():
        if ch.isalpha():
            name = unicodedata.name(ch, "")
            letters[next((s for s in SCRIPTS if name.startswith(s)), "OTHER")] += n
    return max((*SCRIPTS, "OTHER"), key=letters.__getitem__) if letters else "NONE"


class Fertility:
    """Token figures of texts."""

    def __init__(self, pieces: str, byte_ranks: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        with open(byte_ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.other = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, tuple[bytes, int]] = {}
        self.older: dict[bytes, tuple[bytes, int]] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encodes what isn't known of the words of some texts, all at once. Those of short
        words are kept, in two generations of bounded size."""
        for w in [w for w in self.known if len(w) > CACHED_BYTES]:
            del self.known[w]
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        missing = {w for words in texts for w in words if w not in self.known}
        again = missing & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = list(missing - again)
        plain = [w.decode() for w in new]
        for w, ids, text in zip(new, self.sp.encode(plain, num_threads=1), plain):
            self.known[w] = array("I", ids).tobytes(), len(self.other.encode_ordinary(text))

    def of(self, words: list[bytes]) -> tuple[int, int, float, int]:
        """Tokens, byte-fallback tokens, entropy (0 to 1) and tokens of the other
        vocabulary, of words that are learnt."""
        found = [self.known[w] for w in words]
        ids = np.frombuffer(b"".join([x for x, _ in found]), np.uint32)
        n, other = len(ids), sum([x for _, x in found])
        if n < 2:
            return n, int(self.is_byte[ids].sum()), 0.0, other
        c = np.unique(ids, return_counts=True)[1]
        return n, int(self.is_byte[ids].sum()), float((math.log(n) - (c * np.log(c)).sum() / n) / math.log(n)), other


def measure(pieces: str, byte_ranks: str):
    """A pandas UDF: counts and figures of a text, grouped by its language or script."""

    @F.pandas_udf(STATS_SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        fertility = Fertility(pieces, byte_ranks)
        for texts, langs in batches:
            out = []
            for at in range(0, len(texts), TEXT_ROWS):
                some = [x or "" for x in texts.iloc[at : at + TEXT_ROWS]]
                all_words = [x.encode().split() for x in some]
                fertility.learn(all_words)
                for text, words, lang in zip(some, all_words, langs.iloc[at : at + TEXT_ROWS]):
                    chars = sum(map(len, words)) if text.isascii() else sum(len(w.decode()) for w in words)
                    n, fallback, entropy, other = fertility.of(words)
                    group = f"lang {lang}" if isinstance(lang, str) else f"script {script_of(text)}"
                    out.append((
                        group, len(words), chars, len(SYMBOLS.findall(text)), repeated_lines(text), repeated_words(words),
                        n, chars / n if n else 0.0, fallback / n if n else 0.0, entropy, chars / other if other else 0.0,
                    ))
            yield pd.DataFrame(out, columns=STATS)

    return run


def quantiles(stats: DataFrame, wanted: list[tuple[str, float]]) -> DataFrame:
    """group, n and a struct q of ``wanted`` (figure, share): the smallest step of the
    figure that so much of the group reaches up to. What is sorted is a count per step."""
    figures = sorted({c for c, _ in wanted})
    step = lambda c: F.round(F.log(F.greatest(F.col(c), F.lit(1))) * 100) if c == "n_tokens" else F.round(F.col(c) * STEPS)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), step(c).cast("long").alias("at")) for c in figures]))
    counts = stats.select("group", pairs.alias("p")).groupBy("group", "p.figure", "p.at").agg(F.count("*").alias("c"))
    by = Window.partitionBy("group", "figure")
    upto = F.sum("c").over(by.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.select("group", "figure", "at", upto.alias("upto"), F.sum("c").over(by).alias("n"))
    found = [F.min(F.when((F.col("figure") == c) & (F.col("upto") >= F.col("n") * q), F.col("at"))) for c, q in wanted]
    back = lambda c, x: F.exp(x / 100) if c == "n_tokens" else x / F.lit(float(STEPS))
    return rows.groupBy("group").agg(F.max("n").alias("n"), *[back(c, x).alias(f"{c}_{int(q * 100)}") for (c, q), x in zip(wanted, found)])


def bands(stats: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """A row per group with low and high ends and the room beside them, from its documents
    that pass the base rules."""
    wanted = [("n_tokens", 0.5), *((c, q) for c in LEAST_REACH for q in (0.25, 0.75))]
    groups = quantiles(stats.where(~base_failed()), wanted)
    few = F.sqrt(1 + F.lit(float(min_group)) / F.col("n"))
    ends = []
    for c in LEAST_REACH:
        low, high = F.col(f"{c}_25"), F.col(f"{c}_75")
        room = F.greatest(F.lit(reach) * (high - low), F.lit(LEAST_REACH[c]))
        ends += [low.alias(f"{c}_low"), high.alias(f"{c}_high"), (room * few).alias(f"{c}_room")]
    return groups.select("group", "n", F.col("n_tokens_50").alias("typical"), *ends)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """Stats with base_failed, kept and reason. ``limits`` has a row per language or
    script; every document that passes the base rules has one."""
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col("typical") / F.greatest(F.col("n_tokens"), F.lit(1))))
    inside = F.lit(True)
    reason = F.when(base_failed(), "base")
    for c in LEAST_REACH:
        room = F.col(f"{c}_room") * wider
        ok = F.coalesce(F.col(c).between(F.col(f"{c}_low") - room, F.col(f"{c}_high") + room), F.lit(True))
        inside = inside & ok
        reason = reason.when(~ok, c)
    return (
        stats.join(small(stored(limits.drop("n"), "bands")), "group", "left")
        .withColumns({"base_failed": base_failed(), "reason": reason})
        .withColumn("kept", ~F.col("base_failed") & inside)
    )


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def rate(docs: DataFrame, models: tuple[str, str] | None = None) -> DataFrame:
    """Counts, figures and verdict of every document (doc_id, text, lang)."""
    figures = measure(*(models or default_models()))("text", "lang")
    stats = stored(docs.select("doc_id", "text", "lang").withColumn("_stats", figures).select("doc_id", "_stats.*"), "fertility")
    return judge(stats, bands(stats))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate(table(spark, sf_dir, "documents"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason",
        "chars_per_token", "byte_share", "entropy", "chars_per_byte_token",
    )


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their columns. The texts are written once
    beside their figures, so that rows are judged where they lie, without a join."""
    both = stored(docs.select(F.struct(*docs.columns).alias("_row"), measure(*default_models())("text", "lang").alias("_stats")), "fertility")
    limits = bands(both.select("_stats.*"))
    kept = judge(both.select("_row", "_stats.*"), limits).where("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
