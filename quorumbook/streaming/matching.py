"""Votes matched with their proposals on two streams.

Both logs are one stream, packed by groups of neighbouring proposals (``streaming.packed``),
and the rows of a group are matched as arrays.  State holds what a row still to come may
match: a proposal for the longest time in which it can be voted on, a vote until no earlier
proposal can come; a vote without a proposal comes out then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumbook.functions.rules import VOTING_SECONDS
from quorumbook.plans.groups import first_of_group, require_power_of_two
from quorumbook.streaming.packed import Layout, packed, unpacked
from quorumbook.streaming.throttle import require_state_store

_MATCHED = [
    "id", "proposal_id", "voter_id", "voted_at", "opened_at", "required_votes", "case_id is not null as matched",
]
#: A vote (with its voter) or a proposal (with its deadline and votes).
_EITHER = Layout("case_id bigint, id bigint, at bigint, voter_id bigint, deadline bigint, required_votes int")
_OUT = Layout("id bigint, proposal_id bigint, voter_id bigint, voted_at bigint, opened_at bigint, required_votes int, "
              "matched boolean")
_OUT_DDL = ", ".join(f"{name} {kind}" for name, kind in _OUT.columns)
_VOTES = np.dtype(_EITHER.dtype.descr + [("was_matched", "?")])
#: Votes that state holds together: with how many proposals they were compared, and the time of the oldest.
_CHUNK = np.dtype([("id", "i8"), ("met", "i8"), ("oldest", "i8")])
#: Votes of a group that are taken at a time, and pairs that are compared.
_AT_ONCE = 100_000
_NEVER = -(2**62)


class MatchProcessor(StatefulProcessor):
    """Matches the votes on the proposals of one group."""

    def __init__(self, longest_seconds: int = VOTING_SECONDS, at_once: int = _AT_ONCE):
        self._longest, self._at_once = longest_seconds * 1_000_000, at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("held", "made binary, chunks binary, timer bigint")
        self._votes = handle.getMapState("votes", "chunk bigint", "votes binary")

    def _held(self) -> tuple[np.ndarray, np.ndarray, int]:
        made, chunks, timer = self._state.get() or (b"", b"", _NEVER)
        return np.frombuffer(bytes(made), _EITHER.dtype), np.frombuffer(bytes(chunks), _CHUNK).copy(), timer

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        made, chunks, timer = self._held()
        chunks["met"] = len(made)
        portion, size = [], 0
        for row in rows:
            if row.kind == "propose":
                made = np.concatenate([made, self._in_time(_EITHER.read(row.rows), now)])
                continue
            portion.append(row.rows)
            size += len(row.rows) // _EITHER.dtype.itemsize
            if size >= self._at_once:
                chunks = yield from self._keep(portion, made, chunks, now)
                portion, size = [], 0
        chunks = yield from self._keep(portion, made, chunks, now)
        yield from self._store(made, chunks, timer, now)

    def _keep(self, portion: list[bytes], made: np.ndarray, chunks: np.ndarray, now: int):
        """New votes, matched with the proposals that are there so far, as a chunk of the state."""
        new = self._in_time(_EITHER.read(*portion), now)
        if not len(new):
            return chunks
        votes = np.zeros(len(new), _VOTES)
        for name in _EITHER.dtype.names:
            votes[name] = new[name]
        yield from self._matches(made, votes)
        chunk = np.zeros(1, _CHUNK)
        chunk["id"], chunk["met"], chunk["oldest"] = chunks["id"].max(initial=-1) + 1, len(made), votes["at"].min()
        self._votes.updateValue((int(chunk["id"][0]),), (votes.tobytes(),))
        return np.concatenate([chunks, chunk])

    @staticmethod
    def _in_time(rows: np.ndarray, now: int) -> np.ndarray:
        """Without the rows that the watermark has passed, and those without a time, which match nothing."""
        rows = rows[~_EITHER.is_null(rows, "at")]
        return rows[rows["at"] > now] if now > 0 else rows

    def _matches(self, made: np.ndarray, votes: np.ndarray) -> Iterator[Row]:
        """Every pair of a vote and a proposal that was open at its time."""
        if not len(made) or not len(votes):
            return
        made = made[np.argsort(made["case_id"], kind="stable")]
        low, high = (np.searchsorted(made["case_id"], votes["case_id"], side) for side in ("left", "right"))
        count = high - low
        vote = np.repeat(np.arange(len(votes)), count)
        place = np.arange(len(vote)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        case, at = made[place], votes["at"][vote]
        known = ~(_EITHER.is_null(case, "deadline") | _EITHER.is_null(case, "case_id") | _EITHER.is_null(votes, "case_id")[vote])
        fits = known & (at >= case["at"]) & (at <= case["deadline"]) & (at <= case["at"] + self._longest)
        votes["was_matched"][vote[fits]] = True
        if fits.any():
            yield self._out(votes[vote[fits]], case[fits])

    @staticmethod
    def _out(votes: np.ndarray, case: np.ndarray | None) -> Row:
        out = np.zeros(len(votes), _OUT.dtype)
        for name, column in (("id", "id"), ("proposal_id", "case_id"), ("voter_id", "voter_id"), ("voted_at", "at")):
            _OUT.put(out, name, votes[column], _EITHER.is_null(votes, column))
        if case is None:
            for name in ("opened_at", "required_votes"):
                _OUT.put(out, name, 0, True)
        else:
            _OUT.put(out, "opened_at", case["at"])
            _OUT.put(out, "required_votes", case["required_votes"], _EITHER.is_null(case, "required_votes"))
        _OUT.put(out, "matched", case is not None)
        return Row(rows=out.tobytes())

    def _store(self, made: np.ndarray, chunks: np.ndarray, timer: int, now: int) -> Iterator[Row]:
        """Match chunks of votes with the proposals that came after them, and let go of what nothing can match any more.

        A vote that had no match comes out then.
        """
        for place, (number, met, oldest) in enumerate(chunks.tolist()):
            if met == len(made) and oldest > now:
                continue
            votes = np.frombuffer(bytes(self._votes.getValue((number,))[0]), _VOTES).copy()
            yield from self._matches(made[met:], votes)
            over = votes["at"] <= now if now > 0 else np.zeros(len(votes), bool)
            alone = votes[over & ~votes["was_matched"]]
            if len(alone):
                yield self._out(alone, None)
            votes = votes[~over]
            if len(votes):
                chunks["oldest"][place] = votes["at"].min()
                self._votes.updateValue((number,), (votes.tobytes(),))
            else:
                chunks["oldest"][place] = _NEVER
                self._votes.removeKey((number,))
        chunks = chunks[chunks["oldest"] != _NEVER]
        made = made[made["at"] + self._longest > now]
        if not len(made) and not len(chunks):
            self._state.clear()
            return
        least = min(chunks["oldest"].min(initial=2**62), (made["at"] + self._longest).min(initial=2**62))
        least = -(-int(least) // 1000)
        if least != timer:
            self._handle.registerTimer(least)
        self._state.update((made.tobytes(), chunks.tobytes(), least))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        made, chunks, timer = self._held()
        chunks["met"] = len(made)
        # A timer that has passed is no more; one that is still to come stays.
        yield from self._store(made, chunks, timer if timer * 1000 > now else _NEVER, now)

    def close(self) -> None:
        pass


def match_votes(
    proposals: DataFrame, votes: DataFrame, delay: str = "0 seconds", longest_seconds: int = VOTING_SECONDS,
    neighbours: int = 1,
) -> DataFrame:
    """Each vote with the proposal that was open at its time.

    Both watermarks and the two-minute bound tell when old rows can be forgotten; a
    vote without an open proposal comes out, unmatched, once none can arrive; what is
    still held when a log ends comes from ``remaining_matches``.

    ``neighbours``, a power of two, is how many ids share an entry of state; it changes the cost and never the result.
    """
    require_power_of_two(neighbours)
    require_state_store(votes.sparkSession)
    group = first_of_group("case_id", neighbours).rsplit(" as ", 1)[0]
    made = proposals.withWatermark("created_at", delay).selectExpr(
        "'propose' as kind", "id as case_id", "cast(null as bigint) as id", "unix_micros(created_at) as at",
        "cast(null as bigint) as voter_id", "unix_micros(deadline) as deadline",
        "cast(required_votes as int) as required_votes")
    cast = votes.withWatermark("created_at", delay).selectExpr(
        "'vote' as kind", "proposal_id as case_id", "id", "unix_micros(created_at) as at", "voter_id",
        "cast(null as bigint) as deadline", "cast(null as int) as required_votes")
    rows = made.unionByName(cast).selectExpr(f"{group} as proposal_id", "*")
    log = packed(rows, _EITHER, "proposal_id", "kind").groupBy("proposal_id").transformWithState(
        statefulProcessor=MatchProcessor(longest_seconds), outputStructType="rows binary", outputMode="Append",
        timeMode="EventTime")
    return unpacked(log, _OUT, _OUT_DDL).selectExpr(
        "id", "proposal_id", "voter_id", "timestamp_micros(voted_at) as voted_at",
        "timestamp_micros(opened_at) as opened_at", "cast(required_votes as smallint) as required_votes", "matched")


def remaining_matches(streamed: DataFrame, proposals: DataFrame, votes: DataFrame) -> DataFrame:
    """The votes that a stream which has ended did not give out, matched as a batch.

    These are votes without a proposal after which no newer one came, and votes
    that were later than the delay; the latter can be told by their time.
    """
    rest = votes.join(streamed.select("id"), "id", "left_anti")
    made = proposals.select(
        F.col("id").alias("case_id"), "required_votes", F.col("created_at").alias("opened_at"), "deadline"
    )
    cast = rest.select("id", "proposal_id", "voter_id", F.col("created_at").alias("voted_at"))
    in_time = (F.col("proposal_id") == F.col("case_id")) & F.col("voted_at").between(F.col("opened_at"), F.col("deadline"))
    return cast.join(made, in_time, "left_outer").selectExpr(*_MATCHED)
