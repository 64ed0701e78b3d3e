import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quorumbook.llm.exact_dedup import drop_copies, exact_groups
from odd_rows import ODD_ROWS


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_groups_equal_brute_force(odd):
    assert result(exact_groups(odd)) == brute(ODD_ROWS)


def test_texts_that_share_a_hash_stay_apart(odd):
    weak = exact_groups(odd, hash_of=lambda text: (F.length(text) % 2).cast("string").cast("binary"))
    assert result(weak) == brute(ODD_ROWS)


def test_every_text_stays_once_with_all_columns(odd):
    kept = drop_copies(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    texts = {re.sub(r"\s+", " ", t or "") for _, t in rows}
    assert texts == {re.sub(r"\s+", " ", t or "") for _, t, *_ in ODD_ROWS}
    assert (None, "one of no id") in rows and (2, ODD_ROWS[1][1]) not in rows


def test_empty_table(empty):
    assert exact_groups(empty).collect() == [] and drop_copies(empty).collect() == []
