"""The life of a proposal as keyed state with an event-time timer.

A proposal's state is what its outcome can depend on: its terms, the first valid
withdrawal, and of each voter the first valid vote.  Only as many of the earliest
voters as the proposal asks for (eight at most) can ever decide it, so the list is cut
there and state is of a fixed size, whatever the number of votes on one proposal.
Commands that come before their proposal wait in a list of their own.

One timer waits for the next moment at which something is decided: the vote that
reaches the threshold, a withdrawal before any vote, or the first instant past the
deadline.  When the watermark gets there nothing earlier can arrive, the outcome comes
out and the state is dropped; nothing is read or written per batch but the proposals
that batch is about.

With a ``lateness`` the state stays for that long and a command that comes late
corrects the outcome: the row given out is taken back (``change`` -1) and the new one
follows.  Later than that, or without a time, a command is rejected with a reason.

What passes between Spark and Python costs time per row, and reading and writing state a
call to the JVM, whatever it holds.  Proposals with neighbouring ids (``neighbours``) can
share one entry and one timer: ids handed out in the order of time are open together, and
a group is a bounded number of cases.  Their commands come packed (``streaming.packed``),
the cases of a group are an array, and the rules are applied to all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumbook.functions.rules import MAX_REQUIRED_VOTES
from quorumbook.plans.groups import first_of_group, require_power_of_two
from quorumbook.operators.players import with_active_flag
from quorumbook.streaming.packed import Layout, packed, starts_of, unpacked
from quorumbook.streaming.throttle import require_state_store

CASE_LOG = (
    "id bigint, change int, status string, vote_count int, approved_by bigint, approved_at bigint, withdrawn_at bigint, "
    "player_id bigint, delta int, event_at bigint, command_kind string, command_id bigint, actor_id bigint, "
    "created_at bigint, reason string"
)
_COMMAND = Layout(
    "case_id bigint, id bigint, actor_id bigint, target_id bigint, amount int, is_penalty boolean, required_votes int, "
    "at bigint, deadline bigint, active boolean")
_LABELS = ("status", "command_kind", "reason")
_LOG = Layout(", ".join(part for part in CASE_LOG.split(", ") if not part.startswith(_LABELS)))
_PACKED_LOG = "status string, command_kind string, reason string, rows binary"
_LOG_ROW = Row("status", "command_kind", "reason", "rows")
_STATUS = [None, "withdrawn", "approved", "failed"]
_WITHDRAWN, _APPROVED, _FAILED = 1, 2, 3
_NOTHING = -(2**62)
#: A case as its state stores it: its terms, the earliest votes in order (``count`` of them) and the outcome given out.
_CASE = np.dtype([
    ("id", "i8"), ("target_id", "i8"), ("proposed_by", "i8"), ("amount", "i4"), ("required_votes", "i4"),
    ("created_at", "i8"), ("deadline", "i8"), ("is_penalty", "?"), ("no_target", "?"), ("no_proposer", "?"),
    ("no_amount", "?"), ("no_deadline", "?"), ("shown_status", "u1"), ("count", "u1"), ("shown_count", "u1"),
    ("withdrawn_at", "i8"), ("times", "i8", MAX_REQUIRED_VOTES), ("voters", "i8", MAX_REQUIRED_VOTES),
    ("shown_by", "i8"), ("shown_at", "i8"), ("shown_withdrawn", "i8"), ("timer", "i8"),
])
#: Until when commands wait for a proposal.
_WAITING = np.dtype([("id", "i8"), ("at", "i8")])
_GROUP = "cases binary, waiting binary, timer bigint"
#: Commands of a group that are taken at a time.
_AT_ONCE = 100_000


def _latest(waiting: np.ndarray) -> np.ndarray:
    """One row per proposal, with the latest time."""
    ordered = waiting[np.lexsort((waiting["at"], waiting["id"]))]
    return ordered[np.append(starts_of(ordered, ["id"])[1:], len(ordered)) - 1] if len(ordered) else ordered


class _Group:
    """The cases of one key in the order of their ids, and what waits for a proposal."""

    def __init__(self, key: int | None, stored: tuple | None, lateness: int, now: int):
        cases, waiting, self.timer = stored or (b"", b"", _NOTHING)
        self.key, self._lateness, self.now = key, lateness, now
        self.cases = np.frombuffer(bytes(cases), _CASE).copy()
        self.waiting = np.frombuffer(bytes(waiting), _WAITING)
        #: Ids of proposals that came, and commands that found none, by kind.
        self.came: list[np.ndarray] = []
        self.early: list[tuple[str, np.ndarray]] = []

    def _found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids among the cases, and which are there."""
        have = np.ascontiguousarray(self.cases["id"])
        if not len(have):
            return np.zeros(len(ids), int), np.zeros(len(ids), bool)
        place = np.minimum(np.searchsorted(have, ids), len(have) - 1)
        return place, have[place] == ids

    def take(self, portion: dict[str, list[bytes]]) -> Iterator[Row]:
        """Commands that have just come; proposals go first, so that fewer commands have to wait for theirs."""
        for kind in sorted(portion, key=lambda k: k != "propose"):
            rows = _COMMAND.read(*portion[kind])
            timeless = _COMMAND.is_null(rows, "at")
            late = ~timeless & (rows["at"] <= self.now - self._lateness) if self.now > 0 else np.zeros(len(rows), bool)
            for reason, refused in (("no_time", timeless), ("late", late)):
                yield from self.rejected(kind, rows[refused], reason)
            rows = rows[~(timeless | late)]
            if kind == "propose":
                self._open(rows)
            else:
                rest = self.give(kind, rows)
                if len(rest):
                    self.early.append((kind, rest))

    def _open(self, rows: np.ndarray) -> None:
        """Of several proposals with one id the first counts."""
        self.came.append(np.unique(rows["case_id"]))
        rows = rows[np.unique(rows["case_id"], return_index=True)[1]]
        rows = rows[~self._found(rows["case_id"])[1]]
        new = np.zeros(len(rows), _CASE)
        new["id"], new["proposed_by"], new["created_at"] = rows["case_id"], rows["actor_id"], rows["at"]
        for name in ("target_id", "amount", "required_votes", "deadline", "is_penalty"):
            new[name] = rows[name]
        for name, column in (("no_target", "target_id"), ("no_proposer", "actor_id"), ("no_amount", "amount"),
                             ("no_deadline", "deadline")):
            new[name] = _COMMAND.is_null(rows, column)
        for name in ("withdrawn_at", "shown_by", "shown_at", "shown_withdrawn", "timer"):
            new[name] = _NOTHING
        both = np.concatenate([self.cases, new])
        self.cases = both[np.argsort(both["id"], kind="stable")]

    def give(self, kind: str, rows: np.ndarray) -> np.ndarray:
        """Commands to their cases; what the rules refuse leaves no trace.  Returns those without a case."""
        place, known = self._found(rows["case_id"])
        rest, rows, place = rows[~known], rows[known], place[known]
        case = self.cases[place]
        valid = rows["active"] & (rows["at"] >= case["created_at"]) & (case["no_deadline"] | (rows["at"] <= case["deadline"]))
        by_proposer = ~case["no_proposer"] & (rows["actor_id"] == case["proposed_by"])
        if kind == "withdraw":
            valid &= by_proposer
            first = self.cases["withdrawn_at"].copy()
            first[first == _NOTHING] = np.iinfo("i8").max
            np.minimum.at(first, place[valid], rows["at"][valid])
            first[first == np.iinfo("i8").max] = _NOTHING
            self.cases["withdrawn_at"] = first
        else:
            valid &= ~by_proposer & (case["no_target"] | (rows["actor_id"] != case["target_id"]))
            valid &= (case["required_votes"] >= 1) & (case["required_votes"] <= MAX_REQUIRED_VOTES)
            if valid.any():
                self._vote(place[valid], rows["at"][valid], rows["actor_id"][valid])
        return rest

    def _vote(self, place: np.ndarray, at: np.ndarray, voter: np.ndarray) -> None:
        """Of each voter the first vote, and of the voters as many of the earliest as a case asks for."""
        touched = np.unique(place)
        held = self.cases[touched]
        filled = np.arange(MAX_REQUIRED_VOTES) < held["count"][:, None]
        place = np.concatenate([np.repeat(touched, held["count"]), place])
        at, voter = np.concatenate([held["times"][filled], at]), np.concatenate([held["voters"][filled], voter])
        order = np.lexsort((at, voter, place))
        place, at, voter = place[order], at[order], voter[order]
        first = np.ones(len(place), bool)
        first[1:] = (place[1:] != place[:-1]) | (voter[1:] != voter[:-1])
        place, at, voter = place[first], at[first], voter[first]
        order = np.lexsort((voter, at, place))
        place, at, voter = place[order], at[order], voter[order]
        begin = np.searchsorted(place, touched)
        rank = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
        kept = rank < self.cases["required_votes"][place]
        place, rank = place[kept], rank[kept]
        self.cases["times"][place, rank], self.cases["voters"][place, rank] = at[kept], voter[kept]
        self.cases["count"][touched] = np.bincount(np.searchsorted(touched, place), minlength=len(touched))

    def wait(self, kept: list[tuple[str, np.ndarray]]) -> list[tuple[str, bytes]]:
        """Note until when commands wait; returns them as the list of them stores them."""
        for _, rows in kept:
            more = np.zeros(len(rows), _WAITING)
            more["id"], more["at"] = rows["case_id"], rows["at"]
            self.waiting = _latest(np.concatenate([self.waiting, more]))
        return [(kind, rows.tobytes()) for kind, rows in kept if len(rows)]

    def settle(self) -> Iterator[Row]:
        """Outcomes that hold by now and were not given out, those given out that hold no more; decided cases go."""
        cases, now = self.cases, self.now
        if not len(cases):
            return
        needed, count = cases["required_votes"], cases["count"].astype("i4")
        withdrawn = (cases["withdrawn_at"] != _NOTHING) & ((count == 0) | (cases["withdrawn_at"] <= cases["times"][:, 0]))
        approved = ~withdrawn & (needed > 0) & (count == needed)
        last = np.maximum(count - 1, 0)
        row = np.arange(len(cases))
        approved_at = np.where(approved, cases["times"][row, last], _NOTHING)
        approved_by = np.where(approved, cases["voters"][row, last], _NOTHING)
        withdrawn_at = np.where(withdrawn, cases["withdrawn_at"], _NOTHING)
        # The deadline is inclusive; the watermark counts milliseconds.
        over = np.where(cases["no_deadline"], _NOTHING, (cases["deadline"] // 1000 + 1) * 1000)
        at = np.where(withdrawn, withdrawn_at, np.where(approved, approved_at, over))
        decided = (at != _NOTHING) & (at <= now)
        status = np.where(decided, np.where(withdrawn, _WITHDRAWN, np.where(approved, _APPROVED, _FAILED)), 0)
        figures = [np.where(decided, x, e) for x, e in (
            (np.where(withdrawn, 0, count), 0), (approved_by, _NOTHING), (approved_at, _NOTHING), (withdrawn_at, _NOTHING))]
        shown = ["shown_count", "shown_by", "shown_at", "shown_withdrawn"]
        changed = status != cases["shown_status"]
        for name, new in zip(shown, figures):
            changed |= cases[name] != new
        back = changed & (cases["shown_status"] != 0)
        yield from self._outcomes(cases[back], -1, cases["shown_status"][back], [cases[name][back] for name in shown])
        given = changed & decided
        yield from self._outcomes(cases[given], 1, status[given], [x[given] for x in figures])
        cases["shown_status"] = status
        for name, new in zip(shown, figures):
            cases[name] = new
        end = np.where(cases["no_deadline"], _NOTHING, (cases["deadline"] + self._lateness) // 1000 + 1)
        gone = decided & (np.bool_(not self._lateness) | (end != _NOTHING) & (end * 1000 <= now))
        cases["timer"] = np.where(decided, end, np.where(at == _NOTHING, _NOTHING, -(-at // 1000)))
        self.cases = cases[~gone]

    def _outcomes(self, cases: np.ndarray, change: int, status: np.ndarray, figures: list[np.ndarray]) -> Iterator[Row]:
        for code in np.unique(status):
            of = status == code
            some, (votes, by, at, undone) = cases[of], [x[of] for x in figures]
            out = np.zeros(len(some), _LOG.dtype)
            _LOG.put(out, "id", some["id"], self.key is None)
            _LOG.put(out, "change", change)
            _LOG.put(out, "vote_count", votes)
            for name, values in (("approved_by", by), ("approved_at", at), ("withdrawn_at", undone)):
                _LOG.put(out, name, values, values == _NOTHING)
            penalty = some["is_penalty"]
            if code == _APPROVED:
                event = (some["target_id"], some["no_target"], np.where(penalty, some["amount"], -1),
                         penalty & some["no_amount"], at, at == _NOTHING)
            else:
                none = ~penalty if code == _FAILED else np.ones(len(some), bool)
                event = (some["proposed_by"], none | some["no_proposer"], some["amount"], none | some["no_amount"],
                         some["deadline"], none | some["no_deadline"])
            for name, values, null in zip(("player_id", "delta", "event_at"), event[::2], event[1::2]):
                _LOG.put(out, name, values, null)
            for name in ("command_id", "actor_id", "created_at"):
                _LOG.put(out, name, 0, True)
            yield _LOG_ROW(_STATUS[code], None, None, out.tobytes())

    def rejected(self, kind: str, rows: np.ndarray, reason: str) -> Iterator[Row]:
        if not len(rows):
            return
        out = np.zeros(len(rows), _LOG.dtype)
        for name, _ in _LOG.columns:
            _LOG.put(out, name, 0, True)
        _LOG.put(out, "id", rows["case_id"], self.key is None)
        _LOG.put(out, "change", 0)
        for name, column in (("command_id", "id"), ("actor_id", "actor_id"), ("created_at", "at")):
            _LOG.put(out, name, rows[column], _COMMAND.is_null(rows, column))
        yield _LOG_ROW(None, kind, reason, out.tobytes())

    def next_timer(self) -> int:
        moments = self.cases["timer"][self.cases["timer"] != _NOTHING].tolist()
        moments += ((self.waiting["at"] + self._lateness) // 1000 + 1).tolist()
        return min(moments, default=_NOTHING)


class CaseProcessor(StatefulProcessor):
    """Follows the proposals of one group."""

    def __init__(self, lateness_seconds: int = 0, at_once: int = _AT_ONCE):
        self._lateness, self._at_once = lateness_seconds * 1_000_000, at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("case", _GROUP)
        self._early = handle.getListState("early", "kind string, commands binary")

    def _group(self, key, timerValues) -> _Group:
        return _Group(key[0], self._state.get(), self._lateness, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        group = self._group(key, timerValues)
        portion: dict[str, list[bytes]] = {}
        size = 0
        for row in rows:
            portion.setdefault(row.kind, []).append(row.rows)
            size += len(row.rows) // _COMMAND.dtype.itemsize
            if size >= self._at_once:
                yield from group.take(portion)
                portion, size = {}, 0
                if sum(len(r) for _, r in group.early) >= self._at_once:
                    self._wait(group)
        yield from group.take(portion)
        # What came before its proposal, in an earlier batch or in this one.
        if group.came and len(group.waiting) and np.isin(group.waiting["id"], np.concatenate(group.came)).any():
            kept = [(kind, group.give(kind, _COMMAND.read(commands))) for kind, commands in self._early.get()]
            self._wait_only_for(group, kept)
        self._wait(group)
        yield from group.settle()
        self._store(group)

    def _wait(self, group: _Group) -> None:
        """Give commands to their proposals, where those have come by now, and store the others."""
        kept = group.wait([(kind, group.give(kind, rows)) for kind, rows in group.early])
        group.early = []
        if kept:
            self._early.appendList(kept)

    def _wait_only_for(self, group: _Group, kept: list[tuple[str, np.ndarray]]) -> None:
        group.waiting = group.waiting[:0]
        stored = group.wait(kept)
        self._early.put(stored) if stored else self._early.clear()

    def _store(self, group: _Group) -> None:
        least = group.next_timer()
        if least not in (group.timer, _NOTHING):
            self._handle.registerTimer(least)
        if not len(group.cases) and not len(group.waiting):
            self._state.clear()
            return
        self._state.update((group.cases.tobytes(), group.waiting.tobytes(), least))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        group = self._group(key, timerValues)
        yield from group.settle()
        passed = group.now - self._lateness
        if (group.waiting["at"] <= passed).any():
            kept = []
            for kind, commands in self._early.get():
                rows = _COMMAND.read(commands)
                yield from group.rejected(kind, rows[rows["at"] <= passed], "no_open_proposal")
                kept.append((kind, rows[rows["at"] > passed]))
            self._wait_only_for(group, kept)
        # A timer that has passed is no more; one that is still to come stays.
        group.timer = group.timer if group.timer * 1000 > group.now else _NOTHING
        self._store(group)

    def close(self) -> None:
        pass


def follow_cases(
    commands: DataFrame, players: DataFrame, delay: str = "0 seconds", lateness_seconds: int = 0, neighbours: int = 1
) -> DataFrame:
    """Outcomes (``change`` 1, or -1 where one is taken back) and rejects (0) of a command stream, as ``CASE_LOG``.

    ``neighbours``, a power of two, is how many ids share an entry of state; it changes the cost and never the result.
    """
    require_power_of_two(neighbours)
    require_state_store(commands.sparkSession)
    rows = commands.withWatermark("created_at", delay).where("kind <> 'tick'")
    # Without the column of the watermark Spark drops no row before the processor sees it.
    rows = with_active_flag(rows, players, "actor_id", "active").selectExpr(
        first_of_group("proposal_id", neighbours), "proposal_id as case_id", "kind", "id", "actor_id", "target_id",
        "cast(amount as int) as amount", "coalesce(proposal_type = 'penalty', false) as is_penalty",
        "cast(required_votes as int) as required_votes", "unix_micros(created_at) as at",
        "unix_micros(deadline) as deadline", "active")
    log = packed(rows, _COMMAND, "proposal_id", "kind").groupBy("proposal_id").transformWithState(
        statefulProcessor=CaseProcessor(lateness_seconds), outputStructType=_PACKED_LOG, outputMode="Append",
        timeMode="EventTime")
    return unpacked(log, _LOG, CASE_LOG)


def outcomes(log: DataFrame) -> DataFrame:
    """The outcomes that stand: of rows given out and taken back, what is left over."""
    columns = ["id", "status", "vote_count", "approved_by", "approved_at", "withdrawn_at"]
    return log.where("change <> 0").groupBy(*columns).agg(F.sum("change").alias("_standing")).where(
        "_standing > 0").select(*columns)


def event_log(log: DataFrame) -> DataFrame:
    """Score events given out and taken back: player_id, change, delta, event_at (microseconds), proposal_id."""
    return log.where("player_id is not null").selectExpr(
        "player_id", "change", "delta", "event_at", "id as proposal_id")


def case_rejects(log: DataFrame) -> DataFrame:
    return log.where("change = 0").selectExpr(
        "command_kind as kind", "command_id as id", "id as proposal_id", "actor_id", "created_at", "reason")
