import base64
import gzip
import hashlib
import uuid
import zlib

import pytest
from pyarrow import fs

from quorumbook.llm.tables import shared_folder
from quorumbook.llm.warc import _inflated, normalise_archives, read_archives, read_index, records_of, write_archives

PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/\r\nx", ""),
         (5, "http://é/ ü", "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>"), (6, "http://a/6", "long " * 300_000),
         (None, "http://a/none", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (7, "http://a/7", "\r\n\r\n")]


def expected(pages):
    best = {}
    for i, _, html in pages:
        if i is not None:
            best[html or ""] = max(i, best.get(html or "", i))
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        response = i == best.get(html or "")
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if response else "revisit", None if response else best[html or ""], body if response else None))
    return sorted(out, key=str)


def archived(spark, pages, **options):
    source, target = shared_folder(spark, "test-stream"), shared_folder(spark, "test-normal")
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, digest string")
    write_archives(df, source, **options)
    assert sum(r.records for r in normalise_archives(spark, source, target).collect()) == len(pages)
    return target


@pytest.mark.parametrize("per_file", [1, 4, 1000])
def test_round_trip(spark, per_file):
    target = archived(spark, PAGES, records_per_file=per_file)
    rows = read_archives(spark, target).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in rows), key=str) == expected(PAGES)


def test_index_points_at_whole_members(spark):
    target = archived(spark, PAGES)
    system, root = fs.FileSystem.from_uri(target)
    for name, rows in _by_archive(read_index(spark, target).collect()).items():
        whole = system.open_input_file(f"{root}/{name}").read()
        at = 0
        for r in rows:
            assert r.offset == at
            (head, _), = records_of([zlib.decompress(whole[at:at + r.length], 31)])
            assert head["warc-record-id"] == r.record_id and head["warc-type"] == r.record_type
            at += r.length
        assert at == len(whole) and len(list(records_of([gzip.decompress(whole)]))) == len(rows)


def _by_archive(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.archive, r.offset)):
        out.setdefault(r.archive, []).append(r)
    return out


def test_small_payloads_are_no_revisits(spark):
    rows = read_archives(spark, archived(spark, PAGES, least_bytes=1000)).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_a_stream_that_breaks_off_is_an_error():
    data = gzip.compress(b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 2)
    assert len(list(records_of(_inflated(data + data)))) == 4
    with pytest.raises(ValueError):
        list(records_of(_inflated(data[:-12])))
    with pytest.raises(ValueError):
        list(records_of([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabcd"]))


def test_empty_table(spark):
    assert read_archives(spark, archived(spark, [])).collect() == []


def test_names_are_fresh(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x") and uuid.UUID(hex=shared_folder(spark, "x")[-32:])
