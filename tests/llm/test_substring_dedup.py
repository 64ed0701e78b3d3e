import random
from collections import Counter

import numpy as np
from odd_rows import ODD_ROWS
from pyspark.sql import functions as F

from quorumbook.llm import substring_dedup
from quorumbook.llm.bwt import repeated_starts
from quorumbook.llm.substring_dedup import gram_hashes, remove_repeated


def brute(rows, length):
    bodies = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[p:p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for (doc_id, *_), b in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        out.append((doc_id, len(b), [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2])],
                    bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.a, s.b) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def repeating(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("ab é", k=rng.randint(20, 60))) for _ in range(4)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = []
    for i in range(n):
        text = "".join(rng.choices("abcdefgh", k=rng.randint(0, 50)))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(passages)[rng.randint(0, 4):] + "".join(rng.choices("abcdefgh", k=rng.randint(0, 9)))
        rows.append((i, text, "en", "s"))
    return rows + [(900, rows[3][1]), (901, "xyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxy"), (902, None)]


def test_removed_bytes_equal_brute_force(documents):
    rows = repeating(1)
    assert result(remove_repeated(documents(rows), length=16, gram=5)) == brute(rows, 16)


def test_names_that_are_dealt_again_change_nothing(documents):
    rows = repeating(2)
    dealt = remove_repeated(documents(rows), length=16, gram=4, batch_bytes=50, group_bytes=120)
    assert result(dealt) == brute(rows, 16)


def test_odd_rows(odd):
    rows = [r if r[0] != 7 else (7, r[1]) for r in ODD_ROWS]
    assert result(remove_repeated(odd, length=20, gram=8)) == brute(rows, 20)


def test_expansion_equals_counting():
    rng = random.Random(3)
    for _ in range(300):
        length, letters = rng.choice([2, 3, 5, 9, 16]), rng.choice([1, 2, 3, 200])
        bodies = [bytes(rng.randrange(letters) for _ in range(rng.choice([0, 1, length, 2 * length, 40])))
                  for _ in range(rng.randint(1, 6))]
        seen = Counter(b[p:p + length] for b in bodies for p in range(len(b) - length + 1))
        for b, mask in zip(bodies, repeated_starts(bodies, length)):
            assert list(mask) == [seen[b[p:p + length]] > 1 for p in range(len(b) - length + 1)]


def test_equal_pieces_have_equal_hashes():
    body = bytes(random.Random(4).choices(b"ab", k=400))
    for gram in (1, 3, 8, 13, 64):
        h = gram_hashes(body, gram, 0)
        assert len(h) == 400 - gram + 1
        by = {}
        for p, x in enumerate(h.tolist()):
            assert by.setdefault(x, body[p:p + gram]) == body[p:p + gram]
        assert len(by) == len({body[p:p + gram] for p in range(len(h))})


def test_empty_table(empty):
    assert remove_repeated(empty, length=20, gram=8).collect() == []


def edges(seed, passage, n=80):
    """One passage between bytes of each text's own."""
    rng = random.Random(seed)
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(n)]
    return [(i, t[:30] + passage + t[30:], "en", "s") for i, t in enumerate(own)]


def test_no_batch_exceeds_its_bound(documents, monkeypatch):
    rows = edges(5, "THE LINE UNDER EVERY PAGE") + [(500 + i, "z" * (17 + i)) for i in range(30)] + [
        (600 + i, "xyz" * (9 + i)) for i in range(30)]
    volumes, batched = [0], substring_dedup._batched

    def watched(bodies, *rest):
        volumes.extend(r["sum"] for r in bodies.selectExpr("key", "octet_length(body) + 1 as size").groupBy("key").agg(
            F.sum("size").alias("sum")).collect())
        return batched(bodies, *rest)

    monkeypatch.setattr(substring_dedup, "_batched", watched)
    dealt = remove_repeated(documents(rows), length=16, gram=4, batch_bytes=200, group_bytes=400)
    assert result(dealt) == brute(rows, 16)
    assert max(volumes) <= 400


def test_counted_strings_equal_brute_force(documents, monkeypatch):
    rows = repeating(6) + edges(7, "the line under every page", 20) + edges(7, "the line under every page", 5)
    monkeypatch.setattr(substring_dedup, "DEALS", 0)
    assert result(remove_repeated(documents(rows), length=16, gram=4, batch_bytes=50, group_bytes=60)) == brute(rows, 16)
