"""The wrong-code throttle as keyed state with an expiry timer.

Reading and writing state, and making a pandas frame, costs the same for one attempt as for many.  Devices with
neighbouring ids (``neighbours``) can share one entry of state, one timer and one frame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumbook.functions.rules import MAX_WRONG_CODES
from quorumbook.operators.throttle import SPAN, State, Throttle
from quorumbook.plans.groups import first_of_group, require_power_of_two

RESULT = "device_id bigint, seq bigint, at bigint, outcome string, attempts_left int"
JUDGED = f"{RESULT}, reason string"
#: Device and state of each device that has one, as a JSON list of lists.
_STATE = "devices string, timer bigint"
_NEVER = -1


def _expiry(state: State) -> int:
    """The millisecond, strictly after the window and the block, in which a state is over."""
    return max(state[1] + SPAN, state[2]) // 1000 + 1


class ThrottleProcessor(StatefulProcessor):
    """State of the devices of one group: wrong codes, start of their window, end of the block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("throttle", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # nothing has passed in the first micro-batch
        refused = batch["at"].isna() | (batch["at"] <= passed if passed > 0 else False)
        if refused.any():
            yield self._rejected(key, batch[refused])
            batch = batch[~refused].astype({"at": "int64"})
            if batch.empty:
                return
        states, timer = self._stored()
        throttles: dict[int | None, Throttle] = {}
        outcomes, left = [], []
        devices = _devices(key, batch)
        for device, at, well_formed, right in zip(
                devices, batch["at"].tolist(), batch["format_ok"].tolist(), batch["code_ok"].tolist()):
            throttle = throttles.get(device)
            if throttle is None:
                throttles[device] = throttle = Throttle()
                if device in states:
                    throttle.load(states[device])
            remaining = None
            if throttle.blocks(at):
                outcome = "temporarily_blocked"
            elif not well_formed:
                outcome = "invalid_code_format"
            elif right:
                outcome = "ok"
                throttle.clear()
            elif throttle.wrong(at):
                outcome = "locked_now"
            else:
                outcome, remaining = "invalid_code", MAX_WRONG_CODES - throttle.attempts
            outcomes.append(outcome)
            left.append(remaining)
        for device, throttle in throttles.items():
            states.pop(device, None)
            if throttle.started is not None:
                states[device] = throttle.state()
        self._store(states, timer)
        yield pd.DataFrame({
            "device_id": devices, "seq": batch["seq"].to_numpy(), "at": batch["at"].to_numpy(), "outcome": outcomes,
            "attempts_left": pd.array(left, dtype="Int32"), "reason": pd.array([None] * len(batch), dtype="string"),
        })

    def _rejected(self, key, refused: pd.DataFrame) -> pd.DataFrame:
        """Attempts without a time or older than the watermark, whose state may be forgotten."""
        return pd.DataFrame({
            "device_id": _devices(key, refused), "seq": refused["seq"].to_numpy(), "at": refused["at"].astype("Int64").array,
            "outcome": pd.array([None] * len(refused), dtype="string"),
            "attempts_left": pd.array([None] * len(refused), dtype="Int32"),
            "reason": refused["at"].isna().map({True: "no_time", False: "late"}).tolist(),
        })

    def _stored(self) -> tuple[dict, int]:
        listed, timer = self._state.get() or ("[]", _NEVER)
        return {device: tuple(state) for device, *state in json.loads(listed)}, timer

    def _store(self, states: dict, timer: int) -> None:
        if not states:
            self._state.clear()
            return
        least = min(map(_expiry, states.values()))
        if least != timer:
            self._handle.registerTimer(least)
        self._state.update((json.dumps([[device, *state] for device, state in states.items()]), least))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        states, timer = self._stored()
        # A timer that has passed is no more; one that is still to come stays.
        self._store({d: s for d, s in states.items() if _expiry(s) > now}, timer if timer > now else _NEVER)
        return iter([])

    def close(self) -> None:
        pass


def _devices(key, batch: pd.DataFrame) -> list[int | None]:
    return [None] * len(batch) if key[0] is None or pd.isna(key[0]) else batch["device"].tolist()


def require_state_store(spark: SparkSession) -> None:
    """Timers and typed state need the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def judge_attempts(attempts: DataFrame, delay: str = "0 seconds", neighbours: int = 1) -> DataFrame:
    """Each attempt as it arrives, with its outcome or the reason why it is rejected.

    Attempts of one batch are taken in time order; those that the watermark has passed are ``late``,
    those without a time ``no_time``.  ``neighbours``, a power of two, is how many device ids share an entry of state; it
    changes the cost and never the result.
    """
    require_power_of_two(neighbours)
    require_state_store(attempts.sparkSession)
    rows = attempts.select("device_id", "seq", "ts", "format_ok", "code_ok").withWatermark("ts", delay)
    # Without the column of the watermark Spark drops no row before the processor sees it.
    rows = rows.selectExpr(
        first_of_group("device_id", neighbours), "device_id as device", "seq", "unix_micros(ts) as at", "format_ok", "code_ok")
    return rows.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=ThrottleProcessor(), outputStructType=JUDGED, outputMode="Append", timeMode="EventTime"
    )


def stream_throttle(attempts: DataFrame, delay: str = "0 seconds", neighbours: int = 1) -> DataFrame:
    """Outcome of each attempt that comes in time; the others are in ``throttle_rejects``."""
    return judge_attempts(attempts, delay, neighbours).where("reason is null").drop("reason")


def throttle_rejects(attempts: DataFrame, delay: str = "0 seconds", neighbours: int = 1) -> DataFrame:
    """The attempts that cannot be judged: device_id, seq, at, reason."""
    return judge_attempts(attempts, delay, neighbours).where("reason is not null").select("device_id", "seq", "at", "reason")
