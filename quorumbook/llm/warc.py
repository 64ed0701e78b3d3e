"""WARC archives of pages: written monolithic, normalised to one gzip member per record, read by offset.

* ``write_archives`` lets Spark write one text line per record with gzip over the
  whole file; the line separator is the blank lines that end a record.
* ``normalise_archives`` inflates each file once from front to back, writes every
  record again as a gzip member of its own and, beside the archive, an index of
  offsets and lengths (JSON lines).
* ``read_archives`` seeks to each indexed member and inflates that member alone.

A file holds at most ``RECORDS_PER_FILE`` records and is the unit of work of a
task.  Files get a temporary name and are moved when complete, so a repeated task
replaces its own output.  Everything lies in the folder that the cluster shares.

Of equal payloads (by SHA-1, the identity that the format itself uses) the record
with the largest id is the response and the others revisit it.

Defined results: a null html is an empty payload; without an id a record yields
to any with one; rows that repeat the id of a response are responses too; line
breaks inside a url are dropped, a null url becomes the record's own name; an
empty table gives empty archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_FILE = 2000
#: Bytes of normalised archives that one task reads.
SPLIT_BYTES = 4 << 20
LEVEL = 6
_END = "\r\n\r\n"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_ID = "urn:page:"
_CHUNK = 1 << 20
INDEX_SCHEMA = "archive string, offset bigint, length bigint, record_id string, record_type string, uri string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, forty bits at a time."""
    digest = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), *_BASE32)


def resolve_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """Rows with page_id, url, html (never null), digest, size, refers_to (null for a response)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).select(
        "*", F.octet_length("html").cast("bigint").alias("size"), payload_digest(F.col("html").cast("binary")).alias("digest")
    )
    chosen = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("chosen"))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("chosen")), None).otherwise(F.col("chosen"))
    return rows.join(chosen, "digest", "left").withColumn("refers_to", refers).drop("chosen")


def _record(date: str) -> Column:
    """A record without its closing blank lines."""
    name = F.concat(F.lit(_ID), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), name)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    line = "\r\n"
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Refers-To: <{_ID}"), F.col("refers_to").cast("string"), F.lit(
            ">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(_END), block,
    )


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write the pages as archives, each one gzip stream."""
    rows = resolve_revisits(pages, id_col, url_col, html_col, least_bytes).select(_record(date).alias("value"))
    rows.write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(folder)


def _inflated(content: bytes) -> Iterator[bytes]:
    while content:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            part = stream.decompress(content, _CHUNK)
            content = stream.unconsumed_tail
            if part:
                yield part
            elif not stream.eof and not content:
                raise ValueError("the archive ends inside a gzip stream")
        content = stream.unused_data


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records_of(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record of an inflated stream."""
    held, end = bytearray(), _END.encode()
    for part in parts:
        held += part
        at = 0
        while (split := held.find(end, at)) >= 0:
            head = _headers(bytes(held[at:split]))
            stop = split + 4 + int(head["content-length"]) + 4
            if len(held) < stop:
                break
            yield head, bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


def normalise_archives(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every archive in ``source`` to ``target`` with its index; returns archive and number of records."""
    import pyarrow as pa

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
                lines, offset = [], 0
                made = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(made, compression=None) as out:
                    for head, record in records_of(_inflated(content.as_py())):
                        member = zlib.compressobj(level, zlib.DEFLATED, 31)
                        data = member.compress(record) + member.flush()
                        out.write(data)
                        lines.append(json.dumps({
                            "archive": name, "offset": offset, "length": len(data), "record_id": head["warc-record-id"],
                            "record_type": head["warc-type"], "uri": head["warc-target-uri"],
                        }))
                        offset += len(data)
                with system.open_output_stream(f"{made}.index", compression=None) as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                system.move(f"{made}.index", f"{root}/{name}.index")
                system.move(made, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64())],
                                                 names=["archive", "records"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    return files.select("path", "content").mapInArrow(rewrite, "archive string, records bigint")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", "*.index").json(folder)


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit).

    A task reads about ``split_bytes`` of archives, by the index; long archives are read by several tasks.
    """
    import pyarrow as pa

    def number(name: str | None) -> int | None:
        bare = (name or "").strip("<>").removeprefix(_ID)
        return int(bare) if bare else None

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = pa.schema(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        name, file, rows, held = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    name, file = archive, system.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                (head, record), = records_of([zlib.decompress(file.read(length), 31)])
                block = record[record.index(b"\r\n\r\n") + 4:-4]
                http, _, payload = block.partition(b"\r\n\r\n")
                if head["warc-type"] == "response":
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    payload, size = None, int(_headers(http)["content-length"])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                rows.append((number(head["warc-record-id"]), size, digest, head["warc-type"],
                             number(head.get("warc-refers-to")), payload))
                held += len(payload or b"")
                if held > _CHUNK:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], kinds)

    index = read_index(spark, folder).select("archive", "offset", "length")
    # Sized by the archives, not by the index: an index row is small, what it points to is not.
    size = index.agg(F.sum("length")).first()[0] or 0
    part = F.floor(F.col("offset") / split_bytes)
    parts = index.repartition(int(size // split_bytes) + 1, "archive", part)
    return parts.sortWithinPartitions("archive", "offset").mapInArrow(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
              "payload binary")
