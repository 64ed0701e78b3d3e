"""The physical plans that the operators are meant to have."""

import re

from pyspark.sql import functions as F

from frames import SMALL
from quorumbook.catalog.queries import REGISTRY
from quorumbook.operators import ballots, scores
from quorumbook.plans.skew import heavy_keys, partitions_for
from quorumbook.sources.fixtures import Fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def large(spark):
    """No broadcast by size, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def usual(spark):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scoring_shuffles_each_log_once(spark):
    fx = Fixtures(spark, SMALL)
    resolved = ballots.resolve_proposals(fx.proposals, fx.votes, fx.withdrawals, fx.players, fx.as_of)
    totals = scores.player_totals(scores.score_events(resolved.withColumn("status", F.lit("approved"))))
    text = plan(totals)
    # The command log, the proposals and the events; small sides are broadcast.
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text and "Pandas" not in text


def test_scoring_of_large_tables(spark):
    large(spark)
    try:
        text = plan(REGISTRY["leaderboard"](spark, SMALL))
        # Log by actor for the activity check, log by proposal, proposals twice,
        # events by player, players twice.
        assert len(re.findall(r"Exchange hashpartitioning", text)) <= 7
        assert "Broadcast" not in text and "CartesianProduct" not in text
    finally:
        usual(spark)


def test_classification_shuffles_the_log_once(spark):
    df = REGISTRY["classify_votes"](spark, SMALL)
    df.collect()
    text = plan(df)
    final = text[:text.index("Initial Plan")]
    assert re.search(r"ReusedExchange .*, Exchange hashpartitioning\(proposal_id.*REPARTITION_BY_COL", final)


def test_tasks_of_the_log_do_not_grow_with_it(spark, monkeypatch):
    fx = Fixtures(spark, SMALL)
    assert partitions_for(spark.range(100), 25) == [] and partitions_for(spark.range(101), 20) == [6]
    first = ballots.under_first_rules(fx.proposals)

    def run():
        return ballots.resolve_proposals(first, fx.votes, fx.withdrawals, fx.players, fx.as_of).select(
            "id", "status", "approved_by", "approved_at", "withdrawn_at", "vote_count")

    want = run()
    monkeypatch.setattr(ballots, "partitions_for", lambda votes: partitions_for(votes, votes.count() // 9 + 1))
    assert "hashpartitioning(proposal_id" in plan(run()) and re.search(r", 9\), REPARTITION_BY_NUM", plan(run()))
    assert sorted(map(str, run().collect())) == sorted(map(str, want.collect()))


def test_only_needed_columns_are_read(spark):
    text = plan(REGISTRY["leaderboard"](spark, SMALL))
    assert "l_quantity" in text and "l_shipdate" not in text and "l_extendedprice" not in text
    assert "o_totalprice" not in text
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(c_acctbal,0.0\)", text)


def test_heavy_proposals_meet_a_broadcast_and_are_cut_before_the_shuffle(spark):
    large(spark)
    try:
        fx = Fixtures(spark, SMALL)
        decided = ballots.decisions(fx.proposals, fx.votes, fx.withdrawals, fx.players, fx.as_of, heavy=(2, 4))
        text = plan(decided)
        assert text.count("BroadcastHashJoin") == 1
        assert re.search(r"WindowGroupLimit .* Partial", text)
    finally:
        usual(spark)


def test_top_feed_is_a_bounded_sort(spark):
    assert "TakeOrderedAndProject" in plan(REGISTRY["recent_feed"](spark, SMALL))


def test_heavy_keys_are_found(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 7L, id) as key")
    assert heavy_keys(df, "key", 5_000) == [7]
    assert heavy_keys(df, "key", 100_000) == []


def test_texts_of_audited_proposals_go_to_one_shuffle(spark):
    from quorumbook.catalog.queries import _audited
    from quorumbook.sources.fixtures import Fixtures

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = _audited(Fixtures(spark, "/root/testdata/sf0.001")).where("length(description) < 3").select("id")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("doc_id" in line for line in shuffles) == 2 and len(shuffles) == 4
