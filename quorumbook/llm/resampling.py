"""Importance resampling towards a target distribution of hashed word n-grams.

Every text becomes the list of the buckets of its features, written once.  Counts
per bucket over all documents and over all target texts give each bucket a gain,
an array of as many numbers as there are buckets, by which the lists are scored.
Noise from a hash of seed and id turns the greatest scores into a sample without
replacement.

The cutoff is found by bisection: exact counts over the written scores narrow
score, then id among rows of the cutoff's score, then row among rows of one id.
A count job asks for several thresholds at once.  The drawn rows are dealt by
range and numbered inside their range; the sizes of the ranges are added up.

Defined results: a null text has no feature and weight 0; an id that is null
hashes as an empty one and comes after all others among equal scores; rows that
repeat an id and a score are told apart by the place where they were written; an
empty table gives no rows; with an empty target all texts are judged alike by
smoothing.  Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumbook.llm.tables import written

BUCKETS = 10_000
LEAST_WORDS = 20
#: Thresholds counted by one job of the bisection.
PROBES = 15
ROWS_PER_RANGE = 1_000_000

#: Words are runs of ASCII digits, ASCII letters and non-ASCII characters; in UTF-8 the latter are bytes from 0x80.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_SCORE_UNIT = 1000


def feature_buckets(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of up to ``longest`` words."""
    words = _WORDS(text.encode().lower()) if text else []  # lower() of bytes changes A-Z only
    found = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
    for n in range(2, longest + 1):
        runs = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
    return len(words), (np.concatenate(found) % buckets).astype(np.int32)


def hashed_features(
    texts: DataFrame, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per text: doc_id, n_words, buckets (one entry per feature, repeats included)."""
    import pyarrow as pa

    kind = texts.schema[id_col].dataType.simpleString()
    texts = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = [], []
            for text in batch.column("text"):
                n, found = feature_buckets(text.as_py(), longest, buckets)
                counts.append(n)
                lists.append(found)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *lists])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "n_words", "buckets"])

    return texts.mapInArrow(hashed, f"doc_id {kind}, n_words bigint, buckets array<int>")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; at most ``buckets`` rows come to the driver."""
    counted = features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Floored thousandths of the log ratio of the smoothed frequencies, in doubles."""
    buckets, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return [
        math.floor(_SCORE_UNIT * math.log(
            (float(t) + 1) * (all_corpus + buckets) / ((float(s) + 1) * (all_target + buckets))))
        for s, t in zip(corpus, target)
    ]


def _gumbel(id_text: Column, seed: int | str) -> Column:
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-_SCORE_UNIT * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("bigint")


def scored(features: DataFrame, gains: list[int], seed: int | str) -> DataFrame:
    """Weight (floored mean gain) and score of every text; ``row`` tells rows apart once they are written."""
    gain = F.lit(",".join(map(str, gains)))  # one literal: an array literal costs a call per entry
    table = F.split(gain, ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.get(table, b))
    n = F.size("buckets").cast("bigint")
    return (
        features.select("doc_id", "n_words", n.alias("n_features"), total.alias("total"))
        .withColumn("weight", F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)"))
        .withColumn("score", F.col("weight") + _gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed))
        .select("doc_id", "n_words", "n_features", "weight", "score", F.monotonically_increasing_id().alias("row"))
    )


def _least_reaching(rows: DataFrame, value: Column, wanted: int, probes: int = PROBES) -> tuple[int, int]:
    """The least v for which at least ``wanted`` rows have ``value`` <= v, and how many rows lie below it.

    Counts of whole jobs decide, each over several thresholds between the bounds known so far.
    """
    values = rows.select(value.alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0  # rows under low
    while low < high:
        step = max((high - low) // (probes + 1), 1)
        cuts = list(range(low, high, step))[:probes + 1]
        counts = values.agg(*[F.count_if(F.col("v") <= cut).alias(str(i)) for i, cut in enumerate(cuts)]).first()
        for cut, n in zip(cuts, counts):
            if n >= wanted:
                high = cut
                break
            low, below = cut + 1, n
    return low, below


def _drawn(scores: DataFrame, eligible: Column, wanted: int) -> Column:
    """Condition that exactly ``wanted`` of the eligible rows meet: those with the greatest scores."""
    order = [-F.col("score"), F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), F.col("row")]
    if not wanted:
        return F.lit(False)
    rows, tied, before = scores.where(eligible), eligible, F.lit(False)
    for value in order:
        cut, below = _least_reaching(rows, value, wanted)
        wanted -= below
        before = before | (tied & (value < cut))
        tied = tied & (value == cut)
        rows = rows.where(value == cut)
        if rows.count() == wanted:
            break
    return before | tied


def _ranked(rows: DataFrame, rows_per_range: int) -> DataFrame:
    """Number the rows by falling score, then id, then place: within ranges, plus the sizes of the ranges before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = rows.count() // rows_per_range + 1
    dealt = written(
        rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "resampled-ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))  # one row per range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("local", local).join(F.broadcast(starts), "range").withColumn(
        "rank", (F.col("start") + F.col("local")).cast("bigint")).drop("range", "local", "start")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int | str = 2024, longest: int = 1,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Every document with its weight, score and, if drawn, its rank: doc_id, n_words, n_features, weight, score, rank.

    ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    features = written(hashed_features(docs, longest, buckets, id_col, text_col), "resampling-features")
    wanted = hashed_features(target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text")), longest, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scores = written(scored(features, gains, seed), "resampling-scores")
    eligible = F.col("n_words") >= least_words
    drawn = _drawn(scores, eligible, percent * scores.where(eligible).count() // 100)
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scores.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return _ranked(scores.where(drawn), rows_per_range).select(*columns).unionByName(rest.select(*columns))
