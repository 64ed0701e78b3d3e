"""Throttle and claim resolution against literal replays."""

import random

import pytest
from pyspark.sql import functions as F

import model
from quorumbook.operators import claims, throttle
from quorumbook.operators.codes import apply_codes, assign_codes
from quorumbook.sources.fixtures import Fixtures
from frames import SMALL

MINUTE = 60_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "device_id bigint, seq bigint, at bigint, format_ok boolean, code_ok boolean") \
        .withColumn("ts", F.timestamp_micros("at")).drop("at")


def random_attempts(seed, hot=False, busy=1.0, right=0.05):
    """Attempts over five hours; a busy log keeps devices locked all the time."""
    rng = random.Random(seed)
    rows = []
    for seq in range(int(600 * busy)):
        device = 0 if hot and rng.random() < 0.5 else rng.randrange(1, 8)
        now = rng.choice([rng.randrange(0, 300 * MINUTE), rng.randrange(300) * MINUTE])
        rows.append((device, seq, now, rng.random() > 0.15, rng.random() < right))
    return rows


@pytest.mark.parametrize("seed, heavy, busy, right", [
    (1, (), 1, 0.05), (2, (0,), 1, 0.05), (3, (0, 4), 1, 0.05), (4, (0, 1, 2), 0.1, 0), (5, (0, 5), 4, 0),
    (6, (0, 5), 4, 0.3), (7, tuple(range(8)), 0.3, 0.1),
])
def test_throttle(spark, seed, heavy, busy, right):
    rows = random_attempts(seed, bool(heavy), busy, right)
    got = throttle.claim_throttle(frame(spark, rows), heavy, rows_per_task=10).collect()
    assert {r["seq"]: r["outcome"] for r in got} == model.throttle(rows)
    assert len(got) == len(rows)


def test_chunks_of_one_device_at_shared_instants(spark):
    rng = random.Random(9)
    # Everything on quarter hours: five at one instant lock again when the block ends.
    rows = [(0, seq, rng.randrange(40) * 15 * MINUTE, True, rng.random() < 0.02) for seq in range(500)]
    got = throttle.claim_throttle(frame(spark, rows), (0,), rows_per_task=10).collect()
    assert {r["seq"]: r["outcome"] for r in got} == model.throttle(rows)


def outcomes(spark, minutes, well_formed=None):
    rows = [(1, i, int(m * MINUTE), True if well_formed is None else well_formed[i], False)
            for i, m in enumerate(minutes)]
    return [r["outcome"] for r in throttle.claim_throttle(frame(spark, rows)).orderBy("seq").collect()]


def test_fifth_wrong_code_locks_for_fifteen_minutes(spark):
    got = outcomes(spark, [0, 1, 2, 3, 4, 18 + 59 / 60, 19])
    assert got == ["invalid_code"] * 4 + ["locked_now", "temporarily_blocked", "invalid_code"]


def test_window_edge_still_counts(spark):
    rows = [(1, 0, 0, True, False), (1, 1, 15 * MINUTE, True, False)]
    got = throttle.claim_throttle(frame(spark, rows)).orderBy("seq").collect()
    assert [r["attempts_left"] for r in got] == [4, 3]


def test_five_at_one_instant_lock_again_at_once(spark):
    assert outcomes(spark, [0, 0, 0, 0, 0, 15])[-2:] == ["locked_now", "locked_now"]


def test_malformed_code_is_not_counted(spark):
    got = outcomes(spark, [0, 1, 2, 3, 4, 5], [True, True, False, True, True, True])
    assert got == ["invalid_code", "invalid_code", "invalid_code_format", "invalid_code", "invalid_code", "locked_now"]


def players_frame(spark, players):
    rows = [(i, f"P{i}", v["active"], v["owner"], v["has_code"]) for i, v in players.items()]
    return spark.createDataFrame(rows, "id bigint, display_name string, is_active boolean, claimed_user_id bigint, "
                                       "has_code boolean")


@pytest.mark.parametrize("seed, heavy", [(1, ()), (2, (0,)), (3, (0, 100, 4))])
def test_claim_resolution_on_random_attempts(spark, seed, heavy):
    rng = random.Random(seed)
    players = {i: dict(active=i % 6 != 5, has_code=i % 7 != 6, owner=100 if i == 3 else None) for i in range(12)}
    rows = []
    for seq in range(400):
        device = rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 7, 100])
        rows.append((device, seq, seq * 20_000_000, rng.randrange(14), rng.random() > 0.1, rng.random() < 0.08))
    attempts = spark.createDataFrame(
        rows, "device_id bigint, seq bigint, at bigint, player_id bigint, format_ok boolean, code_ok boolean"
    ).withColumn("ts", F.timestamp_micros("at"))
    got = {r["seq"]: r["outcome"] for r in claims.resolve_claims(attempts, players_frame(spark, players), heavy).collect()}
    assert got == model.claims(rows, players)


def test_claim_resolution_on_the_test_tables(spark):
    fx = Fixtures(spark, SMALL)
    attempts, players = fx.claim_attempts, fx.unclaimed_players
    rows = [(r["device_id"], r["seq"], r["at"], r["player_id"], r["format_ok"], r["code_ok"])
            for r in attempts.withColumn("at", F.unix_micros("ts")).collect()]
    known = {r["id"]: dict(active=r["is_active"], has_code=r["has_code"], owner=None) for r in players.collect()}
    got = {r["seq"]: r["outcome"] for r in claims.resolve_claims(attempts, players).collect()}
    assert got == model.claims(rows, known)


def test_codes_are_unique_and_refused_beyond_the_width(spark):
    players = players_frame(spark, {i: dict(active=i != 4, has_code=False, owner=50 + i) for i in range(101)})
    got = assign_codes(players, "seed", 2)
    codes = [r["code"] for r in got.collect()]
    assert len(set(codes)) == 100 and all(len(c) == 2 and c.isdigit() for c in codes)
    after = {r["id"]: (r["code"], r["claimed_user_id"]) for r in
             apply_codes(players.withColumn("claimed_at", F.lit(None).cast("timestamp")), got).collect()}
    assert after[4] == (None, 54) and after[5][1] is None
    everybody = players.withColumn("is_active", F.lit(True))
    with pytest.raises(ValueError):
        assign_codes(everybody, "seed", 2)
