import random
import re

import numpy as np
from odd_rows import ODD_ROWS

from quorumbook.llm import near_dedup
from quorumbook.llm.components import connected
from quorumbook.llm.near_dedup import keep_one_of_each, near_components, shingle_set, signature


def sets_of(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(zip(*(found[k:] for k in range(words)))) if len(found) >= words else frozenset([tuple(found)])


def brute(rows, words, percent=80):
    """Components by comparing all pairs."""
    rows = [(i, sets_of(t, words)) for i, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            one, two = rows[a][1], rows[b][1]
            if one and two and rows[a][0] is not None and rows[b][0] is not None:
                shared = len(one & two)
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if i is not None else None) for k, (i, s) in enumerate(rows)), key=str)


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def near_rows(seed, groups=6, size=25):
    """Groups around a base text, whose members differ from the base in a few words and so from each other in more."""
    rng = random.Random(seed)
    rows, word = [], lambda: "".join(rng.choices("abcdef", k=4))
    for g in range(groups):
        base = [word() for _ in range(60)]
        for _ in range(size):
            own = list(base)
            for at in rng.sample(range(60), rng.randint(0, 6)):
                own[at] = word()
            rows.append((len(rows), " ".join(own), "en", f"s{g}"))
    return rows


def test_components_equal_brute_force(documents):
    rows = near_rows(1) + [(1000 + i, t) for i, (_, t, *_) in enumerate(ODD_ROWS) if i != 10]
    assert result(near_components(documents(rows), words=2)) == brute(rows, 2)


def test_small_chunks_change_nothing(documents):
    rows = near_rows(2, groups=2, size=40)
    assert result(near_components(documents(rows), words=1, shingles_per_chunk=100)) == brute(rows, 1)


def test_odd_rows(odd):
    assert result(near_components(odd, words=5)) == brute(ODD_ROWS, 5)


def test_one_of_each_group_stays(documents):
    rows = near_rows(3, groups=3)
    kept = keep_one_of_each(documents(rows), words=2)
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 2)})


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    agree = (signature(np.unique(a), 2000) == signature(np.unique(b), 2000)).mean()
    assert abs(agree - 300 / 500) < 0.06


def test_permutations_are_one_to_one():
    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4099)
    assert len(np.unique(near_dedup._scatter(x.copy()))) == len(x)
    assert len(np.unique(near_dedup._shuffle(x.copy()))) == len(x)


def test_shingles_of_words():
    assert len(shingle_set("A b a B a", 2)) == 2 and len(shingle_set("a", 5)) == 1 and not len(shingle_set(" \n", 5))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in connected(links).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 200: 100}


def test_empty_table(empty):
    assert near_components(empty).collect() == [] and keep_one_of_each(empty).collect() == []
