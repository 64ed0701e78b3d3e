"""A change log of every kind, folded to the tables and the view it leads to.

A row of the log inserts, updates or deletes one proposal or one vote; ``lsn`` orders
the changes.  Deleting a proposal takes its votes along.  Redelivered and disordered
rows change nothing: the newest version of a key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumbook.functions.rules import derived_status
from quorumbook.plans.skew import broadcast_if_small

PROPOSAL_FIELDS = ["target_id", "proposed_by", "amount", "proposal_type", "status", "approved_at", "deadline"]
VIEW = "id bigint, status string, vote_count int, player_id bigint, delta int, event_at timestamp"


def _newest(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The last version of every key; combined before the shuffle, so a key of many versions is one row."""
    version = F.max_by(F.struct("op", "lsn", *fields), "lsn").alias("v")
    return changes.groupBy("id").agg(version).select("id", "v.*")


def tables_after(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The proposals, and the votes on them, that are there after all changes."""
    cases = changes.where("source = 'proposals' and id is not null")
    kept = _newest(cases, PROPOSAL_FIELDS).where("op <> 'delete'").drop("op", "lsn")
    gone = cases.where("op = 'delete'").groupBy(F.col("id").alias("proposal_id")).agg(F.max("lsn").alias("gone"))
    votes = _newest(changes.where("source = 'votes' and id is not null"), ["proposal_id", "voter_id"]).where(
        "op <> 'delete' and proposal_id is not null")
    votes = votes.join(broadcast_if_small(gone), "proposal_id", "left").where("gone is null or lsn > gone")
    return kept, votes.select("id", "proposal_id", "voter_id")


def view_after(changes: DataFrame, as_of: Column) -> DataFrame:
    """Status, votes and score event of every proposal that is there after all changes (``VIEW``)."""
    proposals, votes = tables_after(changes)
    counts = votes.groupBy(F.col("proposal_id").alias("id")).agg(F.count("*").cast("int").alias("vote_count"))
    status = proposals.join(counts, "id", "left").withColumn(
        "status", derived_status(F.col("status"), F.col("deadline"), as_of))
    counts_for = "status = 'approved' or status = 'failed' and proposal_type = 'penalty'"
    return status.selectExpr(
        "id", "status", "coalesce(vote_count, 0) as vote_count",
        f"case when {counts_for} then if(status = 'approved', target_id, proposed_by) end as player_id",
        f"case when {counts_for} then if(proposal_type = 'penalty', cast(amount as int), -1) end as delta",
        f"case when {counts_for} then if(status = 'approved', approved_at, deadline) end as event_at",
    )


def standing_rows(log: DataFrame) -> DataFrame:
    """What a log of rows given out (``change`` 1) and taken back (-1) leaves standing."""
    columns = [c for c in log.columns if c not in ("change", "version")]
    return log.groupBy(*columns).agg(F.sum("change").alias("_standing")).where("_standing > 0").select(*columns)
