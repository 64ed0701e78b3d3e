import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from odd_rows import ODD_ROWS
from pyspark.sql import functions as F

from quorumbook.llm import resampling
from quorumbook.llm.resampling import resample


def features(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def by_hand(rows, target, percent, seed, longest, buckets, least_words):
    """Every (doc_id, n_features, weight, score) with its rank, ranked over a plain sort."""
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, longest)[1])
    s, t = counts(text for _, text in rows), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, found = features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
                 for b in (zlib.crc32(f.encode()) % buckets for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score, len(words) >= least_words))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    ranks = Counter()
    drawn = [(*x[:4], k + 1) for k, x in enumerate(able[:percent * len(able) // 100])]
    ranks.update(d[:4] for d in drawn)
    left = []
    for x in out:
        if ranks[x[:4]]:
            ranks[x[:4]] -= 1
        else:
            left.append((*x[:4], None))
    return drawn, left


def resampled(df, target, **options):
    rows = resample(df, target, **options).collect()
    result = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows]
    return sorted((r for r in result if r[4]), key=lambda r: r[4]), [r for r in result if r[4] is None]


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "one TWO three"), (2, None), (3, "Zwölf äpfel, one")], "item_id bigint, text string")


@pytest.mark.parametrize("percent,longest,least,rows_per_range", [(50, 2, 2, 2), (100, 3, 0, 10**6), (0, 1, 0, 9)])
def test_odd_rows_equal_the_rule(odd, target, percent, longest, least, rows_per_range):
    texts = [r.text for r in target.collect()]
    want = by_hand([(r[0], r[1]) for r in ODD_ROWS], texts, percent, "s", longest, 97, least)
    got = resampled(odd, target, percent=percent, seed="s", longest=longest, buckets=97, least_words=least,
                    rows_per_range=rows_per_range)
    assert got[0] == want[0]
    assert sorted(got[1], key=str) == sorted(want[1], key=str)


def test_many_rows_and_repeated_rows_at_the_cutoff(spark, documents, target):
    rows = [(i % 400, f"one two {i % 7} number {i % 400}") for i in range(1200)]  # every row three times, or nearly so
    texts = [r.text for r in target.collect()]
    for percent in (33,):
        want = by_hand(rows, texts, percent, 7, 1, 50, 1)
        got = resampled(documents(rows), target, percent=percent, seed=7, buckets=50, least_words=1, rows_per_range=40)
        assert got[0] == want[0] and sorted(got[1], key=str) == sorted(want[1], key=str)


@pytest.mark.parametrize("probes", [1, 15])
def test_bisection_finds_the_least_value(spark, probes):
    values = [-7, -7, -7, 0, 3, 3, 10**12, 10**12 + 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for wanted in (1, 3, 4, 8):
        cut = sorted(values)[wanted - 1]
        assert resampling._least_reaching(df, F.col("v"), wanted, probes) == (cut, sum(v < cut for v in values))


def test_empty_tables(empty, odd, target):
    assert resample(empty, target).collect() == []
    none = resample(odd, target.where("false"), percent=50, least_words=0)
    assert {r["rank"] for r in none.collect()} == {None, *range(1, len(ODD_ROWS) // 2 + 1)}
