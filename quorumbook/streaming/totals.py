"""Floored totals per player that late events correct.

The floor at zero makes the order of events matter, so an event that comes late changes
every total after it.  A player's events are kept in segments of time, each with its
events in order and with two numbers that sum it up: its sum and its lowest prefix sum.
An event given out or taken back touches one segment; the total follows from the
segments' numbers, one after the other, without a look at other events.

A segment that has grown too long is cut in two.  Rows are taken in bounded portions, so
the memory of a task is that of a portion, one segment and the list of segments.

Reading and writing state costs a call to the JVM, whatever it holds, and most players have
few events.  Players with neighbouring ids (``neighbours``) can share their segments: events
lie in the order of player and time, a page may hold those of many players, and a player of
many events has many pages.  Events and totals pass packed (``streaming.packed``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumbook.operators.scores import leaderboard
from quorumbook.plans.groups import first_of_group, require_power_of_two
from quorumbook.plans.numbering import ranks_of_counts
from quorumbook.streaming.packed import Layout, packed, starts_of, unpacked
from quorumbook.streaming.throttle import require_state_store

TOTAL_LOG = "player_id bigint, version bigint, total int, previous int"
HISTOGRAM_LOG = "total int, version bigint, players bigint"
#: Events of a segment, of which twice as many are cut in two, and rows taken at a time.
SEGMENT_EVENTS, PORTION_ROWS = 1024, 20_000
_INDEX = ("version bigint, next bigint, total bigint, ids array<bigint>, times array<bigint>, cases array<bigint>, "
          "deltas array<bigint>, sums array<bigint>, lows array<bigint>")
_SEGMENT = "times array<bigint>, cases array<bigint>, deltas array<bigint>, counts array<bigint>"

_CHANGE = Layout("player bigint, event_at bigint, case_id bigint, delta bigint, change bigint")
_TOTAL = Layout(TOTAL_LOG)
_EVENT = np.dtype([(name, "i8") for name in ("player", "event_at", "case_id", "delta", "change")])
_ORDER = ["player", "event_at", "case_id", "delta"]
#: A page: its first event, its first and last player, and what sums up the events of these two.
_PAGE = np.dtype([(name, "i8") for name in (
    "id", *_ORDER, "size", "head", "head_sum", "head_low", "tail", "tail_sum", "tail_low")])
_STRETCH = np.dtype([(name, "i8") for name in ("player", "sum", "low")])
_PLAYER = np.dtype([(name, "i8") for name in ("player", "version", "total")])

Event = tuple[int, int, int]


def summed(events: list[tuple[Event, int]]) -> tuple[int, int]:
    """Sum and lowest prefix sum of events in order, each so many times; an empty stretch changes nothing."""
    total, low = 0, 0
    for (_, _, delta), n in events:
        total += delta * max(n, 0)
        low = min(low, total)
    return total, low


@dataclass
class _Index:
    """The segments of a player in order: number, first event, sum, lowest prefix sum."""

    version: int = 0
    next: int = 0
    total: int = 0
    ids: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    cases: list[int] = field(default_factory=list)
    deltas: list[int] = field(default_factory=list)
    sums: list[int] = field(default_factory=list)
    lows: list[int] = field(default_factory=list)

    def folded(self) -> int:
        total = 0
        for change, low in zip(self.sums, self.lows):
            total = change + max(total, -low)
        return total


class TotalProcessor(StatefulProcessor):
    """Keeps the total of one player."""

    def __init__(self, segment_events: int = SEGMENT_EVENTS, portion_rows: int = PORTION_ROWS):
        self._size, self._portion = segment_events, portion_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("index", _INDEX)
        self._segments = handle.getMapState("segments", "id bigint", _SEGMENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self._state.get()
        index = _Index(*stored[:3], *map(list, stored[3:])) if stored else _Index()
        portion: Counter[Event] = Counter()
        taken = 0
        for row in rows:
            portion[row.event_at, row.proposal_id, row.delta] += row.change
            taken += 1
            if taken % self._portion == 0:
                self._apply(index, portion)
                portion.clear()
        self._apply(index, portion)
        total = index.folded()
        if total != index.total or stored is None:
            previous = None if stored is None else index.total
            index.version, index.total = index.version + 1, total
            yield Row(player_id=key[0], version=index.version, total=total, previous=previous)
        self._state.update((index.version, index.next, index.total, index.ids, index.times, index.cases, index.deltas,
                            index.sums, index.lows))

    def _apply(self, index: _Index, portion: Counter[Event]) -> None:
        changes = sorted((event, n) for event, n in portion.items() if n)
        if changes and not index.ids:
            self._insert(index, 0, [])
        starts = list(zip(index.times, index.cases, index.deltas))
        groups: dict[int, list] = {}
        for event, n in changes:  # the first segment reaches back without end
            groups.setdefault(max(bisect_right(starts, event) - 1, 0), []).append((event, n))
        for place in sorted(groups, reverse=True):  # cuts move what comes after them only
            self._change(index, place, groups[place])

    def _change(self, index: _Index, place: int, changes: list[tuple[Event, int]]) -> None:
        held = self._segments.getValue((index.ids[place],))
        # A count below zero is an event taken back before it was given out; it waits for its like.
        counts = Counter({(a, c, d): n for a, c, d, n in zip(*held)}) if held else Counter()
        for event, n in changes:
            counts[event] += n
        events = sorted((event, n) for event, n in counts.items() if n)
        step = self._size if len(events) > 2 * self._size else max(len(events), 1)
        parts = [events[i:i + step] for i in range(0, len(events), step)] or [events]
        for offset, part in enumerate(parts):
            if offset:
                self._insert(index, place + offset, part)
            self._store(index, place + offset, part)

    def _insert(self, index: _Index, place: int, part: list[tuple[Event, int]]) -> None:
        first = part[0][0] if part else (-(2**63), -(2**63), 0)
        columns = (index.ids, index.times, index.cases, index.deltas, index.sums, index.lows)
        for column, value in zip(columns, (index.next, *first, 0, 0)):
            column.insert(place, value)
        index.next += 1

    def _store(self, index: _Index, place: int, part: list[tuple[Event, int]]) -> None:
        index.sums[place], index.lows[place] = summed(part)
        columns = list(zip(*[(*event, n) for event, n in part])) or [()] * 4
        self._segments.updateValue((index.ids[place],), tuple(map(list, columns)))

    def close(self) -> None:
        pass


def _merged(events: np.ndarray) -> np.ndarray:
    """Events in order, each once with its count; below zero it was taken back before it was given out and waits."""
    events = events[np.lexsort([events[name] for name in reversed(_ORDER)])]
    if not len(events):
        return events
    starts = starts_of(events, _ORDER)
    once = events[starts]
    once["change"] = np.add.reduceat(events["change"], starts)
    return once[once["change"] != 0]


def _stretches(events: np.ndarray) -> np.ndarray:
    """Sum and lowest prefix sum of each player's events, which are in order."""
    starts = starts_of(events, ["player"])
    out = np.zeros(len(starts), _STRETCH)
    if len(starts):
        counted = events["delta"] * np.maximum(events["change"], 0)
        run = np.cumsum(counted)
        before = run[starts] - counted[starts]
        out["player"], out["sum"] = events["player"][starts], np.add.reduceat(counted, starts)
        out["low"] = np.minimum(np.minimum.reduceat(run, starts) - before, 0)
    return out


class PlayersProcessor(StatefulProcessor):
    """Keeps the totals of the players of one group."""

    def __init__(self, page_events: int = SEGMENT_EVENTS, portion_rows: int = PORTION_ROWS):
        self._size, self._portion = page_events, portion_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("players", "players binary, pages binary")
        self._events = handle.getMapState("pages", "id bigint", "events binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        players, pages = (bytes(x) for x in self._state.get() or (b"", b""))
        self._players, self._pages = np.frombuffer(players, _PLAYER).copy(), np.frombuffer(pages, _PAGE).copy()
        #: The stretches of the pages that this batch wrote.
        self._written: dict[int, np.ndarray] = {}
        came, portion, size = [], [], 0
        for row in rows:
            portion.append(row.rows)
            size += len(row.rows) // _CHANGE.dtype.itemsize
            if size >= self._portion:
                came.append(self._apply(portion))
                portion, size = [], 0
        came.append(self._apply(portion))
        changed = self._changed(np.unique(np.concatenate(came)))
        if len(changed):
            yield Row(rows=changed.tobytes())
        self._state.update((self._players.tobytes(), self._pages.tobytes()))

    def _apply(self, portion: list[bytes]) -> np.ndarray:
        """Events to their pages; returns the players."""
        rows = _CHANGE.read(*portion)
        changes = np.empty(len(rows), _EVENT)
        for name in _EVENT.names:
            changes[name] = rows[name]
        players = np.unique(changes["player"])
        changes = _merged(changes)
        if len(changes) and not len(self._pages):
            self._pages = np.zeros(1, _PAGE)
            for name in _ORDER:  # the first page reaches back without end
                self._pages[name] = np.iinfo("i8").min
        # Pages and events sorted together, of equal ones the page first: an event is in the last page before it.
        order = np.lexsort([
            np.repeat([0, 1], [len(self._pages), len(changes)]),
            *[np.concatenate([self._pages[name], changes[name]]) for name in reversed(_ORDER)]])
        is_page = order < len(self._pages)
        place = (np.cumsum(is_page) - 1)[~is_page]
        bounds = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        for low, high in reversed(list(zip(bounds, bounds[1:]))):  # cuts move what comes after them only
            self._change(int(place[low]), changes[low:high])
        return players

    def _change(self, place: int, changes: np.ndarray) -> None:
        held = self._events.getValue((int(self._pages["id"][place]),)) if self._pages["size"][place] else None
        events = _merged(np.concatenate([np.frombuffer(bytes(held[0]), _EVENT), changes]) if held else changes)
        step = self._size if len(events) > 2 * self._size else max(len(events), 1)
        parts = [events[i:i + step] for i in range(0, len(events), step)] or [events]
        pages = np.zeros(len(parts), _PAGE)
        pages["id"] = self._pages["id"].max() + np.arange(len(parts))
        pages[0] = self._pages[place]
        for number, part in enumerate(parts):
            self._write(pages[number], part, number > 0)
        self._pages = np.concatenate([self._pages[:place], pages, self._pages[place + 1:]])

    def _write(self, page: np.void, part: np.ndarray, is_new: bool) -> None:
        if is_new:
            for name in _ORDER:
                page[name] = part[name][0]
        page["size"] = len(part)
        self._written[int(page["id"])] = stretches = _stretches(part)
        if len(part):
            for end, at in (("head", 0), ("tail", -1)):
                page[end], page[f"{end}_sum"], page[f"{end}_low"] = stretches[at]
        self._events.updateValue((int(page["id"]),), (part.tobytes(),))

    def _known(self, page: np.void) -> np.ndarray:
        """The stretches of a page's first and last player, or of all where this batch wrote it."""
        if int(page["id"]) in self._written or not page["size"]:
            return self._written.get(int(page["id"]), np.zeros(0, _STRETCH))
        ends = np.zeros(1 if page["head"] == page["tail"] else 2, _STRETCH)
        ends[-1] = tuple(page[name] for name in ("tail", "tail_sum", "tail_low"))
        ends[0] = tuple(page[name] for name in ("head", "head_sum", "head_low"))
        return ends

    def _changed(self, came: np.ndarray) -> np.ndarray:
        """The totals of players that came for the first time, or whose total is another one."""
        stretches = np.concatenate([np.zeros(0, _STRETCH), *map(self._known, self._pages)])
        stretches = stretches[np.isin(stretches["player"], came)]
        starts = starts_of(stretches, ["player"])
        totals = np.zeros(len(came), "i8")
        place = np.searchsorted(came, stretches["player"][starts])
        totals[place] = stretches["sum"][starts] + np.maximum(0, -stretches["low"][starts])
        more = np.diff(np.append(starts, len(stretches)))
        for at, start, n in zip(place[more > 1].tolist(), starts[more > 1].tolist(), more[more > 1].tolist()):
            total = int(totals[at])
            for _, change, low in stretches[start + 1:start + n].tolist():
                total = change + max(total, -low)
            totals[at] = total
        known = np.isin(came, self._players["player"])
        new = np.zeros(int((~known).sum()), _PLAYER)
        new["player"] = came[~known]
        self._players = np.concatenate([self._players, new])
        self._players = self._players[np.argsort(self._players["player"], kind="stable")]
        place = np.searchsorted(self._players["player"], came)
        previous = self._players["total"][place]
        changed = ~known | (previous != totals)
        place = place[changed]
        self._players["version"][place] += 1
        self._players["total"][place] = totals[changed]
        out = np.zeros(len(place), _TOTAL.dtype)
        _TOTAL.put(out, "player_id", came[changed])
        _TOTAL.put(out, "version", self._players["version"][place])
        _TOTAL.put(out, "total", totals[changed])
        _TOTAL.put(out, "previous", previous[changed], ~known[changed])
        return out

    def close(self) -> None:
        pass


class HistogramProcessor(StatefulProcessor):
    """Counts the players of one total."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("players", "version bigint, players bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, players = self._state.get() or (0, 0)
        change = sum(row.change for row in rows)
        if change:
            self._state.update((version + 1, players + change))
            yield Row(total=key[0], version=version + 1, players=players + change)

    def close(self) -> None:
        pass


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Players more or fewer per total in each batch of rows, so that few rows meet in one total's task."""
    for batch in batches:
        changes = Counter(batch.column("total").to_pylist())
        changes.subtract(batch.column("previous").drop_null().to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(changes.keys(), pa.int32()), pa.array(changes.values(), pa.int64())], names=["total", "change"])


def follow_histogram(totals: DataFrame, players: DataFrame) -> DataFrame:
    """How many active players have each total, whenever that changes (``HISTOGRAM_LOG``), by differences."""
    require_state_store(totals.sparkSession)
    shown = players.where("is_active").select(F.col("id").alias("player_id"))
    changes = totals.join(shown, "player_id", "left_semi").select("total", "previous").mapInArrow(
        _differences, "total int, change bigint")
    return changes.groupBy("total").transformWithState(
        statefulProcessor=HistogramProcessor(), outputStructType=HISTOGRAM_LOG, outputMode="Append", timeMode="None")


def ranked_totals(totals_log: DataFrame, histogram_log: DataFrame, players: DataFrame) -> DataFrame:
    """The board with competition ranks and leaders, ranks read from the histogram alone.

    Active players without events are those whom no total counts; they have zero.
    """
    counts = histogram_log.groupBy("total").agg(F.max_by("players", "version").alias("rows"))
    everybody = players.where("is_active").agg(F.lit(0).alias("total"), F.count("*").alias("rows"))
    seen = counts.agg(F.lit(0).alias("total"), (-F.coalesce(F.sum("rows"), F.lit(0))).alias("rows"))
    whole = counts.unionByName(everybody).unionByName(seen).groupBy("total").agg(F.sum("rows").alias("rows")).where(
        "rows > 0")
    board = leaderboard(players, latest_totals(totals_log))
    return board.join(ranks_of_counts(whole, "total"), "total").select(
        "rank", "id", "display_name", "total", ((F.col("rank") == 1) & (F.col("total") > 0)).alias("is_leader"))


def follow_totals(
    events: DataFrame, segment_events: int = SEGMENT_EVENTS, portion_rows: int = PORTION_ROWS, neighbours: int = 1
) -> DataFrame:
    """The totals of players whenever they change (``TOTAL_LOG``), from events given out and taken back in any order.

    ``neighbours``, a power of two, is how many ids share an entry of state; it changes the cost and never the result.
    """
    require_power_of_two(neighbours)
    require_state_store(events.sparkSession)
    rows = events.where("player_id is not null")
    if neighbours == 1:
        rows = rows.select("player_id", "change", "delta", "event_at", "proposal_id")
        return rows.groupBy("player_id").transformWithState(
            statefulProcessor=TotalProcessor(segment_events, portion_rows), outputStructType=TOTAL_LOG,
            outputMode="Append", timeMode="None")
    rows = rows.selectExpr(
        first_of_group("player_id", neighbours), "player_id as player", "event_at", "proposal_id as case_id",
        "cast(delta as bigint) as delta", "cast(change as bigint) as change")
    log = packed(rows, _CHANGE, "player_id").groupBy("player_id").transformWithState(
        statefulProcessor=PlayersProcessor(segment_events, portion_rows), outputStructType="rows binary",
        outputMode="Append", timeMode="None")
    return unpacked(log, _TOTAL, TOTAL_LOG)


def latest_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("player_id").agg(F.max_by("total", "version").alias("total"))
