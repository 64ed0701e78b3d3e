"""Trial run on made-up logs in which one key holds a third of the rows.

    python tests/skew_trial.py [votes in millions]

Prints the longest task of each stage next to the sum of all tasks, from the
status store of the session, with the heavy paths on and off.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def logs(spark, millions: float):
    n = int(millions * 1_000_000)
    cases = n // 8
    proposals = spark.range(cases).selectExpr(
        "id", "if(id % 3 = 0, 1L, (id * 7919) % 100000 + 10) as target_id", "(id * 104729) % 100000 + 200000 as proposed_by",
        "'text' as description", "cast(1 + id % 3 as smallint) as amount", "'pending' as status",
        "cast(null as bigint) as approved_by", "cast(null as timestamp) as approved_at",
        "cast(null as timestamp) as withdrawn_at", "timestamp_seconds(id) as created_at",
        "if(id % 5 = 0, 'pardon', 'penalty') as proposal_type", "cast(2 as smallint) as required_votes",
        "timestamp_seconds(id + 120) as deadline")
    votes = spark.range(n).selectExpr(
        "id", f"if(id % 3 = 0, 7L, (id * 6700417) % {cases}) as proposal_id",
        "400000 + (id * 31) % 100000 as voter_id").selectExpr(
        "*", "timestamp_seconds(proposal_id + id % 140) as created_at")
    players = spark.range(500_000).selectExpr("id", "concat('P', id) as display_name", "true as is_active",
                                              "cast(null as bigint) as claimed_user_id")
    undone = votes.where("false").selectExpr("id", "proposal_id", "voter_id as actor_id", "created_at")
    return proposals, votes, undone, players


def main() -> None:
    from pyspark.sql import functions as F

    from quorumbook.operators import ballots, scores
    from quorumbook.operators.status import with_derived_status
    from quorumbook.plans.workspace import fresh_path
    from quorumbook.session import local_session

    millions = float(sys.argv[1]) if len(sys.argv) > 1 else 6
    spark = local_session(8, partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    root = fresh_path(spark, "skew-trial")
    tables = []
    for name, df in zip(("proposals", "votes", "withdrawals", "players"), logs(spark, millions)):
        df.write.parquet(f"{root}/{name}")
        tables.append(spark.read.schema(df.schema).parquet(f"{root}/{name}"))
    as_of = F.timestamp_seconds(F.lit(10**9))
    limit = int(millions * 100_000)
    result = {}
    for label in ("plain", "split"):
        start = time.time()
        heavy = ballots.heavy_proposals(tables[1], limit) if label == "split" else []
        counted = ballots.classify_votes(*tables, as_of, heavy).groupBy("outcome").count()
        votes = sorted(map(tuple, counted.collect()))
        middle = time.time()
        status = with_derived_status(ballots.resolve_proposals(*tables, as_of, heavy), as_of)
        events, cuts = scores.score_events(status), scores.Stretches()
        if label == "split":
            events, cuts = scores.prepared_events(status, tables[0], limit)
        totals = scores.player_totals(events, cuts).agg(F.count("*"), F.sum("total"), F.max("total")).first()
        result[label] = (votes, tuple(totals))
        print(label, "heavy", heavy, list(cuts.players), f"votes {middle - start:.1f}s totals {time.time() - middle:.1f}s",
              flush=True)
    print("equal", result["plain"] == result["split"], result["split"])


if __name__ == "__main__":
    main()
