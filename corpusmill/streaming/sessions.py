"""Session state over streams of turns."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.functions import text as T

STATE = "starts array<long>, ends array<long>, words long, roles array<string>, first_turns array<long>, active array<string>, active_turn long"
OUTPUT = "conv_id long, turn_count long, last_turn long, words long, roles string, active string"


def _seen(starts: list[int], ends: list[int], turn: int) -> bool:
    """Adds ``turn`` to the sorted runs of known turns; whether it was known."""
    i = bisect_right(starts, turn)
    if i and turn <= ends[i - 1]:
        return True
    before, after = bool(i) and ends[i - 1] == turn - 1, i < len(starts) and starts[i] == turn + 1
    if before and after:
        ends[i - 1] = ends[i]
        del starts[i], ends[i]
    elif before:
        ends[i - 1] = turn
    elif after:
        starts[i] = turn
    else:
        starts.insert(i, turn)
        ends.insert(i, turn)
    return False


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends, words, names, first_turns, active, active_turn = state.get if state.exists else ([], [], 0, [], [], [], -1)
    starts, ends, active = list(starts), list(ends), list(active)
    roles = dict(zip(names, first_turns))
    for batch in batches:
        for turn, role, said, named in zip(batch["turn"], batch["role"], batch["n_words"], batch["named"]):
            turn = int(turn)
            if _seen(starts, ends, turn):
                continue
            words += int(said)
            if role is not None:
                roles[role] = min(turn, roles.get(role, turn))
            if len(named) and turn > active_turn:
                active, active_turn = [str(x) for x in named], turn
    state.update((starts, ends, words, list(roles), list(roles.values()), active, active_turn))
    count, spoken = sum(e - s + 1 for s, e in zip(starts, ends)), ",".join(sorted(roles, key=lambda r: roles[r]))
    yield pd.DataFrame([(key[0], count, ends[-1], words, spoken, "|".join(sorted(active)))], columns=["conv_id", "turn_count", "last_turn", "words", "roles", "active"])


def folded_stream(turns: DataFrame) -> DataFrame:
    """The state of every conversation (conv_id, turn, role, text) that a micro-batch
    touches, as the batch fold has it: turns, words, speakers in order of appearance, and
    the entities of the last turn that names any. Turns may come late and in any order: the
    state holds what is known of them as runs of turn numbers, so each counts once. Of one
    turn sent with different texts the first to come stays; rows without a number are left
    out."""
    no_names = F.array().cast("array<string>")
    said = F.when(F.col("text").isNull(), 0).otherwise(F.size(T.words(F.col("text")))).alias("n_words")
    rows = turns.where("turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", said, F.coalesce(T.entity_candidates(F.col("text")), no_names).alias("named"))
    return rows.groupBy("conv_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) counted in windows; later ones than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
