"""Declared schemas of the ledger tables.  Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_LONG, _TEXT, _TIME, _FLAG, _SHORT = (
    T.LongType(), T.StringType(), T.TimestampType(), T.BooleanType(), T.ShortType(),
)

PLAYERS = _schema(
    ("id", _LONG, False), ("display_name", _TEXT, False), ("is_active", _FLAG, False),
    ("created_at", _TIME, False), ("claimed_user_id", _LONG, True), ("claimed_at", _TIME, True),
    ("has_code", _FLAG, True),
)

PROPOSALS = _schema(
    ("id", _LONG, False), ("target_id", _LONG, False), ("proposed_by", _LONG, False),
    ("description", _TEXT, False), ("amount", _SHORT, False), ("status", _TEXT, False),
    ("approved_by", _LONG, True), ("approved_at", _TIME, True), ("withdrawn_at", _TIME, True),
    ("created_at", _TIME, False), ("proposal_type", _TEXT, False),
    ("required_votes", _SHORT, False), ("deadline", _TIME, False),
)

VOTES = _schema(
    ("id", _LONG, False), ("proposal_id", _LONG, False), ("voter_id", _LONG, False),
    ("created_at", _TIME, False),
)

WITHDRAWALS = _schema(
    ("id", _LONG, False), ("proposal_id", _LONG, False), ("actor_id", _LONG, False),
    ("created_at", _TIME, False),
)

PROPOSAL_COMMANDS = _schema(
    ("id", _LONG, False), ("actor_id", _LONG, True), ("target_id", _LONG, True),
    ("description", _TEXT, True), ("amount", T.IntegerType(), True), ("proposal_type", _TEXT, False),
    ("created_at", _TIME, False),
)

CLAIM_ATTEMPTS = _schema(
    ("device_id", _LONG, False), ("seq", _LONG, False), ("ts", _TIME, False),
    ("player_id", _LONG, True), ("format_ok", _FLAG, False), ("code_ok", _FLAG, False),
)

PLAYER_CHANGES = _schema(
    ("seq", _LONG, False), ("display_name", _TEXT, False), ("is_active", _FLAG, False),
    ("changed_at", _TIME, False),
)

CHANGES = _schema(
    ("source", _TEXT, False), ("op", _TEXT, False), ("id", _LONG, True), ("proposal_id", _LONG, True),
    ("lsn", _LONG, False), ("changed_at", _TIME, True), ("target_id", _LONG, True), ("proposed_by", _LONG, True),
    ("amount", _SHORT, True), ("proposal_type", _TEXT, True), ("status", _TEXT, True), ("approved_at", _TIME, True),
    ("deadline", _TIME, True), ("voter_id", _LONG, True),
)

# The given test tables that are read, as DDL.
TEST_TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
