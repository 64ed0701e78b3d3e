"""Small ledger tables from Python rows."""

from __future__ import annotations

from model import at

SMALL = "/root/testdata/sf0.001"

PROPOSALS = ("id bigint, target_id bigint, proposed_by bigint, description string, amount smallint, status string, "
             "approved_by bigint, approved_at timestamp, withdrawn_at timestamp, created_at timestamp, "
             "proposal_type string, required_votes smallint, deadline timestamp")


def players(spark, n, active):
    rows = [(i, f"P{i}", i in active, None, True) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, display_name string, is_active boolean, claimed_user_id bigint, "
                                       "has_code boolean")


def proposals(spark, table):
    rows = [
        (i, p["target"], p["proposer"], "text", p["amount"], "pending", None, None, None, at(p["created"]), p["kind"],
         p["needed"], at(p["deadline"])) for i, p in table.items()
    ]
    return spark.createDataFrame(rows, PROPOSALS)


def votes(spark, rows):
    return spark.createDataFrame([(i, p, v, at(s)) for i, p, v, s in rows],
                                 "id bigint, proposal_id bigint, voter_id bigint, created_at timestamp")


def withdrawals(spark, rows):
    return spark.createDataFrame([(i, p, v, at(s)) for i, p, v, s in rows],
                                 "id bigint, proposal_id bigint, actor_id bigint, created_at timestamp")


def seconds(moment):
    return None if moment is None else round((moment.timestamp() - at(0).timestamp()))
