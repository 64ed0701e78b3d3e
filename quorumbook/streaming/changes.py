"""The view over a change feed, kept current per proposal.

State holds the newest version of a proposal, the versions of its votes and the view
row last given out.  When a change or the passing of a deadline alters that row, it
is taken back and the new one follows, so whoever adds up the log of ``change`` has
the view of the moment and the score events of the moment.

Versions decide, not the order of arrival, so changes may come late, twice or in any
order.

Reading and writing state costs a call to the JVM, whatever it holds.  Proposals with
neighbouring ids (``neighbours``) can share one value and one timer, and their votes lie
in pages, found by the vote's id: a batch reads and writes each page that its changes are
in once.  Pages are split when there are more than ``PAGE_VOTES`` votes for each, so work
per change does not grow with the votes a proposal has, and one page at a time is in memory.
For the same reason changes come as pandas frames, whose columns are converted at once.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumbook.plans.groups import first_of_group, require_power_of_two
from quorumbook.streaming.throttle import require_state_store

VIEW_LOG = ("id bigint, version bigint, change int, status string, vote_count int, player_id bigint, delta int, "
            "event_at bigint")
_LOG_TYPES = {name: {"bigint": "Int64", "int": "Int32", "string": "string"}[kind]
              for name, kind in (part.split(" ") for part in VIEW_LOG.split(", "))}
# The cases as a JSON list of lists: of nested state Spark would look at every number by itself, in Python.
_GROUP = "cases string, timer bigint, pages int, held bigint"
_TERMS = ["target_id", "proposed_by", "amount", "proposal_type", "status", "approved_at", "deadline"]
_INPUT = ["case_id", "is_vote", "there", "id", "lsn", "terms"]
_NEVER = -(2**62)
#: Votes for which there is one page, on average.
PAGE_VOTES = 512
#: Votes that are taken from a batch before they go to their pages.
_AT_ONCE = 10_000
_VOTE = 4  # numbers of a page per vote: proposal, id, lsn, whether it is there


@dataclass
class _Case:
    """One proposal as its state stores it; times are microseconds."""

    lsn: int = _NEVER
    alive: bool = False
    gone: int = _NEVER
    target_id: int | None = None
    proposed_by: int | None = None
    amount: int | None = None
    proposal_type: str | None = None
    status: str | None = None
    approved_at: int | None = None
    deadline: int | None = None
    votes: int = 0
    version: int = 0
    shown: bool = False
    shown_status: str | None = None
    shown_votes: int | None = None
    shown_player: int | None = None
    shown_delta: int | None = None
    shown_at: int | None = None

    def view(self, now: int) -> tuple | None:
        """Status, votes and score event at an instant; nothing for a proposal that is not there."""
        if not self.alive:
            return None
        status = self.status
        if status not in ("approved", "withdrawn"):
            status = "failed" if self.deadline is not None and now > self.deadline else "open"
        if status == "approved" or status == "failed" and self.proposal_type == "penalty":
            player, at = (self.target_id, self.approved_at) if status == "approved" else (self.proposed_by, self.deadline)
            return status, self.votes, player, self.amount if self.proposal_type == "penalty" else -1, at
        return status, self.votes, None, None, None

    def last(self) -> tuple | None:
        shown = (self.shown_status, self.shown_votes, self.shown_player, self.shown_delta, self.shown_at)
        return shown if self.shown else None


class _Group:
    """The proposals of one key, the timer that waits for them and how many pages hold how many votes."""

    def __init__(self, stored: tuple | None):
        listed, self.timer, self.pages, self.held = stored or ("[]", _NEVER, 1, 0)
        self.cases = {c[0]: _Case(*c[1:]) for c in json.loads(listed)}

    def stored(self, timer: int) -> tuple:
        listed = [[proposal, *vars(case).values()] for proposal, case in self.cases.items()]
        return json.dumps(listed), timer, self.pages, self.held


def _page_of(vote: int, pages: int) -> int:
    """The page of a vote among a power of two of them; twice as many split each page in two."""
    return (vote * 0x9E3779B97F4A7C15 >> 32) & (pages - 1)


class ChangeProcessor(StatefulProcessor):
    """Keeps the view rows of the proposals of one group."""

    def __init__(self, page_votes: int = PAGE_VOTES):
        self._page_votes = page_votes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("case", _GROUP)
        self._pages = handle.getMapState("votes", "page int", "votes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = _Group(self._state.get())
        cases, touched, gone = group.cases, {}, set()
        votes: dict[tuple[int, int], tuple[int, bool]] = {}
        for batch in rows:
            for proposal, is_vote, there, number, lsn, terms in zip(*(batch[c].tolist() for c in _INPUT)):
                case = touched.get(proposal)
                if case is None:
                    touched[proposal] = case = cases.setdefault(proposal, _Case())
                if is_vote:
                    known = votes.get((proposal, number))
                    if lsn >= case.gone and (known is None or known[0] < lsn):
                        votes[proposal, number] = lsn, there
                        if len(votes) == _AT_ONCE:
                            self._keep(group, votes, set())
                            votes = {}
                    continue
                if not there and lsn > case.gone:
                    case.gone = lsn
                    gone.add(proposal)
                if lsn > case.lsn:
                    case.lsn, case.alive = lsn, there
                    if there:
                        given = json.loads(terms)
                        for name in _TERMS:
                            setattr(case, name, given.get(name))
        self._keep(group, votes, gone)
        now = timerValues.getCurrentWatermarkInMs() * 1000
        yield from _log(row for proposal, case in touched.items() for row in self._settle(proposal, case, now))
        self._store(group)

    def _keep(self, group: _Group, votes: dict, gone: set) -> None:
        """New versions of votes to their pages; votes from before a deletion go with it.

        That is so also where a newer version of the proposal came first, or the vote came late.
        """
        by_page: dict[int, list] = {}
        for (proposal, number), version in votes.items():
            by_page.setdefault(_page_of(number, group.pages), []).append((proposal, number, version))
        for page in range(group.pages) if gone and group.held else by_page:
            self._change_page(group, page, by_page.get(page, []), gone)
        while group.held > group.pages * self._page_votes:
            self._split_pages(group)

    def _read_page(self, group: _Group, page: int) -> array:
        held = self._pages.getValue((page,)) if group.held else None
        return array("q", bytes(held[0]) if held else b"")

    def _change_page(self, group: _Group, page: int, new: list, gone: set) -> None:
        cases, flat = group.cases, self._read_page(group, page)
        held = {}
        for proposal, number, lsn, there in zip(*(flat[k::_VOTE] for k in range(_VOTE))):
            if proposal in gone and lsn < cases[proposal].gone:
                cases[proposal].votes -= there
            else:
                held[proposal, number] = lsn, there
        changed = len(held) * _VOTE < len(flat)
        for proposal, number, (lsn, there) in new:
            case, known = cases[proposal], held.get((proposal, number), (_NEVER, False))
            if lsn >= case.gone and lsn > known[0]:
                case.votes += there - known[1]
                held[proposal, number] = lsn, there
                changed = True
        if changed:
            group.held += len(held) - len(flat) // _VOTE
            self._write_page(page, array("q", [x for k, v in held.items() for x in (*k, *v)]), bool(flat))

    def _write_page(self, page: int, flat: array, was: bool) -> None:
        if flat:
            self._pages.updateValue((page,), (flat.tobytes(),))
        elif was:
            self._pages.removeKey((page,))

    def _split_pages(self, group: _Group) -> None:
        for page in range(group.pages):
            flat = self._read_page(group, page)
            parts = {page: array("q"), page + group.pages: array("q")}
            for at in range(0, len(flat), _VOTE):
                parts[_page_of(flat[at + 1], 2 * group.pages)] += flat[at:at + _VOTE]
            for part, numbers in parts.items():
                self._write_page(part, numbers, part == page and bool(flat))
        group.pages *= 2

    def _settle(self, proposal: int, case: _Case, now: int) -> Iterator[tuple]:
        new, old = case.view(now), case.last()
        if new != old:
            case.version += 1
            for change, view in ((-1, old), (1, new)):
                if view is not None:
                    yield proposal, case.version, change, *view
            case.shown = new is not None
            case.shown_status, case.shown_votes, case.shown_player, case.shown_delta, case.shown_at = new or (None,) * 5

    def _store(self, group: _Group) -> None:
        # Strictly after the deadline, which is inclusive.
        moments = [c.deadline // 1000 + 1 for c in group.cases.values()
                   if c.shown and c.shown_status == "open" and c.deadline is not None]
        least = min(moments, default=_NEVER)
        if least not in (group.timer, _NEVER):
            self._handle.registerTimer(least)
        self._state.update(group.stored(least))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        group, now = _Group(self._state.get()), timerValues.getCurrentWatermarkInMs() * 1000
        passed = [(p, c) for p, c in group.cases.items()
                  if c.shown and c.shown_status == "open" and c.deadline is not None and now > c.deadline]
        yield from _log(row for proposal, case in passed for row in self._settle(proposal, case, now))
        # A timer that has passed is no more; one that is still to come stays.
        group.timer = group.timer if group.timer * 1000 > now else _NEVER
        self._store(group)

    def close(self) -> None:
        pass


def _log(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    columns = list(zip(*rows))
    if columns:
        yield pd.DataFrame({n: pd.array(c, dtype=kind) for (n, kind), c in zip(_LOG_TYPES.items(), columns)})


def follow_changes(
    changes: DataFrame, delay: str = "0 seconds", neighbours: int = 1, page_votes: int = PAGE_VOTES
) -> DataFrame:
    """The log of view rows given out and taken back (``VIEW_LOG``); changes without a key, number or proposal are left out.

    ``changed_at`` moves the clock by which deadlines pass; it decides nothing else.  ``neighbours``, a power of two, is
    how many ids share an entry of state and ``page_votes`` how many votes; both change the cost and never the result.
    """
    require_power_of_two(neighbours)
    require_state_store(changes.sparkSession)
    rows = changes.withWatermark("changed_at", delay).where("id is not null and lsn is not null").selectExpr(
        "if(source = 'proposals', id, proposal_id) as proposal_id", "coalesce(source = 'votes', false) as is_vote",
        "coalesce(op <> 'delete', true) as there", "id", "lsn", "cast(amount as int) as amount", "unix_micros(approved_at) as approved_at",
        "unix_micros(deadline) as deadline", "target_id", "proposed_by", "proposal_type", "status",
    ).where("proposal_id is not null")
    # Only what has no nulls keeps its type in pandas: the terms of a proposal are a text.
    terms = F.when(~F.col("is_vote") & F.col("there"), F.to_json(F.struct(*_TERMS)))
    rows = rows.withColumn("terms", terms).selectExpr(
        first_of_group("proposal_id", neighbours), "proposal_id as case_id", *_INPUT[1:])
    return rows.groupBy("proposal_id").transformWithStateInPandas(
        statefulProcessor=ChangeProcessor(page_votes), outputStructType=VIEW_LOG, outputMode="Append", timeMode="EventTime")
