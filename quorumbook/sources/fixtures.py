"""Ledger tables derived from the TPC-H-like test tables (see FIXTURES.md)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumbook.functions.timing import MICROS_OF_NTZ
from quorumbook.sources.schemas import TEST_TABLES

# Fixed values of the derivation: 2026-01-01 and 2024-01-01, UTC, in seconds since 1970.
BASE_SECONDS = 1_767_225_600
EVENTS_SECONDS = 1_704_067_200
SECONDS_PER_ORDER = 7


def at_second(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(BASE_SECONDS).cast("bigint") + seconds)


def _at(seconds: str) -> str:
    """SQL for the instant so many seconds after the base."""
    return f"timestamp_seconds({BASE_SECONDS}L + {seconds})"


_PROPOSAL = "(l_orderkey - l_orderkey % 2)"
_CREATED = _at("o_orderkey * 7")
_DEADLINE = _at("o_orderkey * 7 + 120")
_NEEDED = "case when {kind} = 'pardon' then 8S when o_orderkey % 3 = 0 then 2S when o_orderkey % 3 = 1 then 4S else 8S end"


def votes_from_lines(lines: DataFrame, players: int) -> DataFrame:
    return lines.selectExpr(
        "xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber) as id",
        f"{_PROPOSAL} as proposal_id",
        f"(l_partkey + l_suppkey) % {players} as voter_id",
        f"{_at(f'{_PROPOSAL} * 7 + cast(l_quantity * 3 as bigint)')} as created_at",
    )


def proposals_from_orders(orders: DataFrame, players: int) -> DataFrame:
    kind = "case when o_orderpriority = '5-LOW' then 'pardon' else 'penalty' end"
    return orders.selectExpr(
        "o_orderkey as id",
        f"(o_custkey + 1 + o_orderkey % 97) % {players} as target_id",
        "o_custkey as proposed_by",
        "concat('Order ', o_orderkey) as description",
        "cast(if(o_orderpriority = '5-LOW', 1, 1 + o_orderkey % 3) as smallint) as amount",
        "'pending' as status",
        "cast(null as bigint) as approved_by",
        "cast(null as timestamp) as approved_at",
        "cast(null as timestamp) as withdrawn_at",
        f"{_CREATED} as created_at",
        f"{kind} as proposal_type",
        f"{_NEEDED.format(kind=f'({kind})')} as required_votes",
        f"{_DEADLINE} as deadline",
    )


def withdrawals_from_orders(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderstatus = 'P' and o_orderkey % 5 = 0").selectExpr(
        "o_orderkey as id",
        "o_orderkey as proposal_id",
        "o_custkey as actor_id",
        f"{_at('o_orderkey * 7 + o_orderkey % 150 + 1')} as created_at",
    )


def attempts_from_events(events: DataFrame, players: int) -> DataFrame:
    offset = f"({MICROS_OF_NTZ.format(column='ts')} - {EVENTS_SECONDS}000000L)"
    return events.selectExpr(
        "user_id as device_id",
        "event_id as seq",
        f"timestamp_micros({BASE_SECONDS}000000L + {offset} div 240) as ts",
        f"(user_id + event_id % 3) % {players} as player_id",
        "event_type <> 'view' as format_ok",
        "event_type = 'signup' as code_ok",
    )


@dataclass(frozen=True)
class Fixtures:
    """Lazy ledger tables over one folder of test tables."""

    spark: SparkSession
    folder: str

    @cached_property
    def _read(self) -> dict[str, DataFrame]:
        return {}

    def raw(self, name: str) -> DataFrame:
        """One of the given tables, with its declared schema."""
        if name not in self._read:
            reader = self.spark.read.schema(TEST_TABLES[name])
            self._read[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    @cached_property
    def player_count(self) -> int:
        return self.raw("customer").count()

    @cached_property
    def as_of(self) -> Column:
        last = self.raw("orders").agg(F.max("o_orderkey")).first()[0] or 0
        return at_second(F.lit(last * SECONDS_PER_ORDER))

    @property
    def players(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as id",
            "c_name as display_name",
            "c_acctbal >= 0 as is_active",
            f"{_at('0')} as created_at",
            "if(c_custkey % 3 <> 0, c_custkey, null) as claimed_user_id",
            f"if(c_custkey % 3 <> 0, {_at('c_custkey')}, null) as claimed_at",
            "c_custkey % 7 <> 0 as has_code",
        )

    @property
    def unclaimed_players(self) -> DataFrame:
        """The players before anybody has claimed a device."""
        return self.players.withColumns({
            "claimed_user_id": F.lit(None).cast("bigint"),
            "claimed_at": F.lit(None).cast("timestamp"),
        })

    @property
    def proposals(self) -> DataFrame:
        return proposals_from_orders(self.raw("orders"), self.player_count)

    @property
    def votes(self) -> DataFrame:
        return votes_from_lines(self.raw("lineitem"), self.player_count)

    @property
    def withdrawals(self) -> DataFrame:
        return withdrawals_from_orders(self.raw("orders"))

    @property
    def claim_attempts(self) -> DataFrame:
        return attempts_from_events(self.raw("events"), self.player_count)

    @property
    def untold_commands(self) -> DataFrame:
        """The commands without their text, which is that of a document (``doc_id``)."""
        return self.raw("orders").selectExpr(
            "o_orderkey as id",
            "o_custkey as actor_id",
            f"(o_custkey + o_orderkey % 97) % {self.player_count} as target_id",
            f"o_orderkey % {self.raw('documents').count()} as doc_id",
            "cast(o_orderkey % 5 as int) as amount",
            "if(o_orderpriority = '5-LOW', 'pardon', 'penalty') as proposal_type",
            f"{_CREATED} as created_at",
        )

    def with_description(self, commands: DataFrame) -> DataFrame:
        """Commands with the text of their document in place of its id."""
        texts = self.raw("documents").select("doc_id", "text")
        columns = ["if(id % 11 = 0, substring(text, 1, 2), text) as description" if c == "doc_id" else c
                   for c in commands.columns]
        return commands.join(texts, "doc_id", "left").selectExpr(*columns)

    @property
    def proposal_commands(self) -> DataFrame:
        return self.with_description(self.untold_commands)

    @property
    def stored_proposals(self) -> DataFrame:
        """Proposals as a table with stored states, some of them from before voting."""
        kind = "if(o_orderpriority = '5-LOW', 'pardon', 'penalty')"
        legacy = "o_orderkey % 4 = 0"
        return self.raw("orders").selectExpr(
            "o_orderkey as id",
            f"(o_custkey + 1 + o_orderkey % 97) % {self.player_count} as target_id",
            "o_custkey as proposed_by",
            "concat('Order ', o_orderkey) as description",
            f"""cast(case when o_orderkey % 12 = 0 then null when {kind} = 'pardon' and not ({legacy}) then 1
                else 1 + o_orderkey % 3 end as smallint) as amount""",
            "case o_orderstatus when 'F' then 'approved' when 'P' then 'withdrawn' else 'pending' end as status",
            f"if(o_orderstatus = 'F', (o_custkey + 101 + o_orderkey % 7) % {self.player_count}, null) as approved_by",
            f"if(o_orderstatus = 'F', {_at('o_orderkey * 7 + 60')}, null) as approved_at",
            f"if(o_orderstatus = 'P', {_at('o_orderkey * 7 + 30')}, null) as withdrawn_at",
            f"{_CREATED} as created_at",
            f"if({legacy}, null, {kind}) as proposal_type",
            f"if({legacy}, null, {_NEEDED.format(kind=kind)}) as required_votes",
            f"if({legacy}, null, {_DEADLINE}) as deadline",
        )

    @property
    def changes(self) -> DataFrame:
        """Proposals made, decided, corrected and deleted; votes cast and taken back."""
        kind = "if(o_orderpriority = '5-LOW', 'pardon', 'penalty')"
        amount = f"if({kind} = 'pardon', 1, 1 + o_orderkey % 3)"
        corrected = f"if({kind} = 'pardon', 1, 1 + (o_orderkey + 1) % 3)"
        decided = "case o_orderstatus when 'F' then 'approved' when 'P' then 'withdrawn' else 'pending' end"
        steps = [  # operation, order within an instant, seconds after creation, which orders, status, amount
            ("insert", 0, 0, "true", "'pending'", amount),
            ("update", 3, 60, "o_orderstatus <> 'O'", decided, amount),
            ("update", 4, 90, "o_orderkey % 10 = 3", decided, corrected),
            ("delete", 5, 200, "o_orderkey % 9 = 4", "null", "null"),
        ]
        made = [
            self.raw("orders").where(which).selectExpr(
                "'proposals' as source", f"'{op}' as op", "o_orderkey as id", "o_orderkey as proposal_id",
                f"(o_orderkey * 7 + {after}) * 8 + {rank} as lsn", f"{_at(f'o_orderkey * 7 + {after}')} as changed_at",
                f"(o_custkey + 1 + o_orderkey % 97) % {self.player_count} as target_id", "o_custkey as proposed_by",
                f"cast({amount_} as smallint) as amount", f"{kind} as proposal_type", f"cast({status} as string) as status",
                f"if({status} = 'approved', {_at('o_orderkey * 7 + 60')}, null) as approved_at", f"{_DEADLINE} as deadline",
                "cast(null as bigint) as voter_id")
            for op, rank, after, which, status, amount_ in steps
        ]
        cast = [
            self.votes.where(which).selectExpr(
                "'votes' as source", f"'{op}' as op", "id", "proposal_id",
                f"(unix_seconds(created_at) - {BASE_SECONDS} + {after}) * 8 + {rank} as lsn",
                f"created_at + interval {after} seconds as changed_at", "voter_id")
            for op, rank, after, which in (("insert", 1, 0, "true"), ("delete", 2, 100, "voter_id % 7 = 0"))
        ]
        log = made[0]
        for part in (*made[1:], *cast):
            log = log.unionByName(part, allowMissingColumns=True)
        return log

    @property
    def players_at_start(self) -> DataFrame:
        """Players without those whom the organiser adds later."""
        return self.unclaimed_players.where("id % 10 <> 9").withColumns({
            "claimed_user_id": F.expr("if(id % 8 = 0, id + 1, null)"),
        })

    @property
    def organiser_log(self) -> DataFrame:
        """Players added, given a new code and taken out, between the claim attempts of the other events."""
        player = f"(user_id + event_id % 3) % {self.player_count}"
        names = self.raw("customer").selectExpr("c_custkey as _id", "c_name as display_name")
        return self.raw("events").where("event_type = 'error'").selectExpr(
            "event_id as seq", f"timestamp_micros({MICROS_OF_NTZ.format(column='ts')}) as changed_at", f"{player} as _id",
            "case when event_id % 8 = 1 then 'deactivate' when event_id % 2 = 0 then 'reset' else 'insert' end as op",
            "lpad(cast(event_id % 100 as string), 2, '0') as code",
        ).join(names, "_id").selectExpr(
            "seq", "changed_at", "op", "if(op = 'deactivate', null, code) as code", "display_name",
            "if(op = 'insert', _id, null) as new_id")

    @property
    def attempts_between(self) -> DataFrame:
        return attempts_from_events(self.raw("events").where("event_type <> 'error'"), self.player_count)

    @property
    def player_changes(self) -> DataFrame:
        """Operator log of inserts and deactivations, several per player name."""
        return self.raw("events").selectExpr(
            "event_id as seq",
            "concat('Player ', user_id) as display_name",
            "event_type <> 'error' as is_active",
            f"timestamp_micros({MICROS_OF_NTZ.format(column='ts')}) as changed_at",
        )
