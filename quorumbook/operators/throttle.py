"""The wrong-code throttle over a log of attempts.

It is an ordered walk over one device's attempts with three numbers of state.
Spark shuffles by device and sorts; the walk streams through the sorted
partition, never holding a device's attempts together, and passes over blocked
stretches in bulk.

The attempts of a heavy device are cut into chunks of time that are walked in
parallel.  For that each chunk is first turned into a table from the states in
which it may be entered to those in which it is left.  Few states need to be
considered: whatever the state at the start, a chunk soon reaches an attempt
that starts a new window, and from there on the past does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumbook.functions.rules import MAX_WRONG_CODES, THROTTLE_SECONDS
from quorumbook.plans.skew import ROWS_PER_TASK, heavy_keys, is_heavy

SPAN = THROTTLE_SECONDS * 1_000_000
# A chunk spans at least two windows, so no window or block outlasts it unnoticed.
_MIN_CHUNK = 2 * SPAN
_OUTCOMES = np.array(["not_counted", "temporarily_blocked", "invalid_code", "locked_now", "ok"], dtype=object)
_UNCOUNTED, _BLOCKED, _WRONG, _LOCKED, _OK = range(5)

State = tuple[int, int, int]
EMPTY: State = (0, -1, -1)
_STATE = "attempts int, started bigint, blocked_until bigint"
_STATE_COLUMNS = ["attempts", "started", "blocked_until"]


class Throttle:
    """Wrong-code counter of one device."""

    __slots__ = ("attempts", "started", "blocked_until")

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.attempts, self.started, self.blocked_until = 0, None, None

    def load(self, state: State) -> None:
        self.attempts = state[0]
        self.started, self.blocked_until = (None if v < 0 else v for v in state[1:])

    def state(self) -> State:
        return self.attempts, -1 if self.started is None else self.started, (
            -1 if self.blocked_until is None else self.blocked_until)

    def blocks(self, now: int) -> bool:
        return self.blocked_until is not None and self.blocked_until > now

    def renews(self, now: int) -> bool:
        """Whether a wrong code now would start a new window."""
        return self.started is None or self.started < now - SPAN

    def wrong(self, now: int) -> bool:
        """Count a wrong code; true when it locks the device."""
        if self.renews(now):
            self.attempts, self.started = 1, now
        else:
            self.attempts += 1
        locked = self.attempts >= MAX_WRONG_CODES
        self.blocked_until = now + SPAN if locked else None
        return locked


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcome of each attempt; rows come sorted, each chunk with the state it is entered in."""
    key, throttle = None, Throttle()
    for batch in batches:
        size = len(batch)
        if not size:
            continue
        device, chunk, at = (batch[c].to_numpy() for c in ("device_id", "chunk", "at"))
        counts, right = batch["counts"].to_numpy(dtype=bool), batch["code_ok"].to_numpy(dtype=bool)
        entry = [batch[c].to_numpy() for c in _STATE_COLUMNS]
        changes = np.flatnonzero((device[1:] != device[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        edges = np.concatenate(([0], changes, [size])).tolist()
        outcome = np.full(size, _BLOCKED, dtype=np.int8)
        left = np.full(size, -1, dtype=np.int32)
        for first, end in zip(edges[:-1], edges[1:]):
            here = (device[first], chunk[first])
            if here != key:
                key = here
                throttle.load(tuple(int(column[first]) for column in entry))
            i = first
            while i < end:
                now = int(at[i])
                if throttle.blocks(now):
                    i += int(np.searchsorted(at[i:end], throttle.blocked_until, side="left"))
                    continue
                if not counts[i]:
                    outcome[i] = _UNCOUNTED
                elif right[i]:
                    outcome[i] = _OK
                    throttle.clear()
                elif throttle.wrong(now):
                    outcome[i] = _LOCKED
                else:
                    outcome[i], left[i] = _WRONG, MAX_WRONG_CODES - throttle.attempts
                i += 1
        yield batch.drop(columns=["chunk", *_STATE_COLUMNS]).assign(outcome=_OUTCOMES[outcome], attempts_left=left)


# Chunks of heavy devices ------------------------------------------------------

def _settled(state: State, next_start: int) -> State:
    """The state as it matters from the start of the next chunk on."""
    attempts, started, blocked = state
    if started < next_start - SPAN and blocked <= next_start:
        return EMPTY
    if 0 <= blocked and started < blocked - SPAN:
        # The window is over before the block is: where it began no longer matters.
        return MAX_WRONG_CODES, blocked - SPAN - 1, blocked
    return state


def _counted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Times and rightness of the attempts that can change the state, in order."""
    rows = rows[rows["counts"]].sort_values(["at", "seq"])
    return rows["at"].to_numpy(), rows["code_ok"].to_numpy(dtype=bool)


def _run_until_renewed(throttle: Throttle, at: np.ndarray, right: np.ndarray, i: int) -> int:
    """Walk on until the state is as if a walk began at the returned position."""
    while i < len(at):
        now = int(at[i])
        if throttle.blocks(now):
            i += int(np.searchsorted(at[i:], throttle.blocked_until, side="left"))
        elif right[i]:
            return i + 1
        elif throttle.renews(now):
            return i
        else:
            throttle.wrong(now)
            i += 1
    return -1


def _exits(at: np.ndarray, right: np.ndarray, next_start: int) -> list[State]:
    """State at the end of the chunk for a walk that begins empty at each position."""
    exits: list[State] = [EMPTY] * (len(at) + 1)
    throttle = Throttle()
    for i in range(len(at) - 1, -1, -1):
        throttle.clear()
        if right[i]:
            exits[i] = exits[i + 1]
            continue
        throttle.wrong(int(at[i]))
        renewed = _run_until_renewed(throttle, at, right, i + 1)
        exits[i] = exits[renewed] if renewed >= 0 else _settled(throttle.state(), next_start)
    return exits


def _possible_entries(width: int):
    """States in which the chunk after this one may be entered."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        device, chunk = key
        at, right = _counted(rows)
        states = sorted(set(_exits(at, right, (chunk + 1) * width)) | {EMPTY})
        return pd.DataFrame(
            [(device, chunk + 1, *state) for state in states],
            columns=["device_id", "chunk", *_STATE_COLUMNS],
        )
    return run


def _transitions(width: int):
    """Exit state of a chunk for each possible entry state."""
    columns = ["device_id", "chunk", *_STATE_COLUMNS, "to_attempts", "to_started", "to_blocked"]

    def run(key: tuple, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=columns)
        device, chunk = key
        next_start = (chunk + 1) * width
        at, right = _counted(rows)
        exits = _exits(at, right, next_start)
        states = set(zip(*(entries[c].tolist() for c in _STATE_COLUMNS))) | {EMPTY}
        table, throttle = [], Throttle()
        for state in states:
            throttle.load(state)
            renewed = _run_until_renewed(throttle, at, right, 0)
            left = exits[renewed] if renewed >= 0 else _settled(throttle.state(), next_start)
            table.append((device, chunk, *state, *left))
        return pd.DataFrame(table, columns=columns)
    return run


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which each chunk is entered, following the tables from chunk to chunk."""
    device, chunk, state, after = None, None, EMPTY, EMPTY
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            if row.device_id != device:
                device, chunk, state, after = row.device_id, row.chunk, EMPTY, EMPTY
            elif row.chunk != chunk:
                # A chunk without attempts outlasts every window and block.
                state = after if row.chunk == chunk + 1 else EMPTY
                chunk = row.chunk
            if (row.attempts, row.started, row.blocked_until) == state:
                after = (row.to_attempts, row.to_started, row.to_blocked)
                found.append((device, chunk, *state))
        yield pd.DataFrame(found, columns=["device_id", "chunk", *_STATE_COLUMNS])


def _chunk_width(rows: DataFrame, rows_per_task: int) -> int:
    """A multiple of the shortest chunk in which the busiest device has about one task's rows."""
    busiest = rows.groupBy("device_id").agg(
        F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("span")
    ).agg(F.min(F.expr("span / n"))).first()[0]
    return max(int((busiest or 0) * rows_per_task) // _MIN_CHUNK, 1) * _MIN_CHUNK


def _entered_chunks(rows: DataFrame, rows_per_task: int) -> DataFrame:
    """Attempts of heavy devices with their chunk and the state it is entered in."""
    width = _chunk_width(rows, rows_per_task)
    cut = rows.withColumn("chunk", F.expr(f"at div {width}L"))
    keys = ["device_id", "chunk"]
    steps = cut.select(*keys, "at", "seq", "counts", "code_ok")
    entries = steps.groupBy(*keys).applyInPandas(_possible_entries(width), f"device_id bigint, chunk bigint, {_STATE}")
    tables = steps.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(
        _transitions(width),
        f"device_id bigint, chunk bigint, {_STATE}, to_attempts int, to_started bigint, to_blocked bigint",
    )
    entered = tables.repartition("device_id").sortWithinPartitions(*keys).mapInPandas(
        _follow, f"device_id bigint, chunk bigint, {_STATE}"
    )
    return cut.join(entered, keys)


def heavy_devices(attempts: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> list:
    return heavy_keys(attempts, "device_id", rows_per_task)


def walk_attempts(rows: DataFrame, heavy: Sequence, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``outcome`` and ``attempts_left`` to attempts by the throttle alone.

    Rows hold ``device_id``, ``seq``, ``at`` in microseconds, ``counts`` (whether
    the code is compared at all), ``code_ok`` and any further columns without
    nulls.  An attempt that does not count is still blocked by a block.
    """
    whole = ["0L as chunk", "0 as attempts", "-1L as started", "-1L as blocked_until"]
    if not heavy:
        spread = rows.selectExpr("*", *whole)
    else:
        hot = is_heavy(F.col("device_id"), heavy)
        spread = rows.where(~hot).selectExpr("*", *whole).unionByName(_entered_chunks(rows.where(hot), rows_per_task))
    ordered = spread.repartition("device_id", "chunk").sortWithinPartitions("device_id", "chunk", "at", "seq")
    left = [c for c in ordered.columns if c not in ("chunk", *_STATE_COLUMNS)]
    schema = T.StructType([ordered.schema[c] for c in left])
    return ordered.mapInPandas(_walk, schema.add("outcome", "string").add("attempts_left", "integer"))


def claim_throttle(
    attempts: DataFrame, heavy: Sequence | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Outcome of every code attempt by the throttle alone; a right code clears the counter.

    ``heavy`` names the devices with too many attempts for one task; by default
    they are looked for, which counts the attempts.
    """
    heavy = heavy_devices(attempts, rows_per_task) if heavy is None else heavy
    rows = attempts.selectExpr("device_id", "seq", "unix_micros(ts) as at", "format_ok as counts", "code_ok")
    return walk_attempts(rows, heavy, rows_per_task).selectExpr(
        "device_id", "seq", "timestamp_micros(at) as ts",
        "if(outcome = 'not_counted', 'invalid_code_format', outcome) as outcome",
        "if(attempts_left < 0, null, attempts_left) as attempts_left",
        "case when outcome = 'invalid_code' then concat('attempts left: ', cast(attempts_left as string)) end as detail",
    )
