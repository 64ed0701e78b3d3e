import zlib
from collections import Counter

from odd_rows import ODD_ROWS

from quorumbook.llm.sharding import stratified_shards


def test_rows_law_slots_and_checksums(odd):
    rows = stratified_shards(odd, shards=5, rows_per_piece=3).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD_ROWS if i is not None)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s, n in sizes.items() for k in range(n)}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_every_shard_has_the_mixture_and_pieces_change_nothing(documents):
    df = documents([(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)])
    whole = {r.doc_id: (r.shard, r.slot) for r in stratified_shards(df).collect()}
    cut = {r.doc_id: (r.shard, r.slot) for r in stratified_shards(df, rows_per_piece=7).collect()}
    assert whole == cut
    source = {r.doc_id: r.source for r in df.collect()}
    of, each = Counter(source.values()), Counter((source[i], s) for i, (s, _) in whole.items())
    assert all(abs(each[s, k] - n / 8) <= 2 for s, n in of.items() for k in range(8))


def test_empty_table(empty):
    assert stratified_shards(empty).collect() == []
