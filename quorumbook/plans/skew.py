"""Finding heavy keys and splitting their rows.

A key is heavy when one task could not comfortably hold its rows.  Detection
reads one column; it steers the physical plan and never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 4_000_000
ROWS_PER_PARTITION = 1_000_000
BROADCAST_ROWS = 500_000


def heavy_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> list:
    """The keys that exceed the rows of one task.

    A table that fits one task has none.  In others the rows of each key are counted,
    combined before the shuffle; there are at most rows / ``rows_per_task`` heavy keys.
    """
    if df.count() <= rows_per_task:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("item")).agg(F.count("*").alias("n"))
    return [row["item"] for row in counts.where(F.col("n") > rows_per_task).select("item").collect()]


def partitions_for(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> list[int]:
    """What to give to ``repartition`` before the keys so that what a task holds does not grow with the table.

    Nothing, which leaves the number to the session's settings, as long as these give no task more than
    ``rows_per_partition`` rows on average.
    """
    wanted = -(-df.count() // rows_per_partition)
    return [wanted] if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def is_heavy(key: Column, heavy: Sequence) -> Column:
    return F.coalesce(key.isin(list(heavy)), F.lit(False))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count shows that the rows fit; otherwise leave the plan to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


def order_bounds(df: DataFrame, column: str, pieces: int) -> list[int]:
    """Distinct boundaries that cut ``df`` into about equal ranges of ``column``."""
    shares = [i / pieces for i in range(1, pieces)]
    row = df.agg(F.percentile_approx(column, shares, 10 * pieces).alias("bounds")).first()
    return sorted(set(row["bounds"] or []))


def _count_below(value: Column, bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < value))


def piece_of(value: Column, bounds: Sequence[int]) -> Column:
    """How many boundaries lie below ``value``: an order-preserving piece number.

    Boundaries are looked up in two steps of about the square root of their number.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [list(bounds[i:i + step]) for i in range(0, len(bounds), step)]
    lasts = F.array(*[F.lit(g[-1]).cast("bigint") for g in groups[:-1]]).cast("array<bigint>")
    group = _count_below(value, lasts)
    table = F.array(*[F.array(*[F.lit(b).cast("bigint") for b in g]) for g in groups])
    return group * step + _count_below(value, F.get(table, group))
