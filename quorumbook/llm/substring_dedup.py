"""Removal of every byte covered by a long string that also starts elsewhere.

The suffixes of a corpus do not fit one task, so strings are dealt by content
first.  Of all ``GRAM``-byte pieces of a string of ``length`` bytes the one with the
least hash names the string; equal strings have equal names.  Neighbouring strings
with one name form a segment, so a text is moved as about three overlapping copies
of itself at most, and of that only segments whose name occurs again.

Equal segments are one, marked as repeated.  The different segments of a name, many
names at a time, make a bounded batch: its Burrows-Wheeler transform is expanded
breadth first by backward extension until common prefixes reach ``length``
(``bwt.repeated_starts``).  A name whose segments exceed a batch is dealt again within
the name by another hash of longer pieces, as strings at the edge of a passage share
nearly all short ones.  What still exceeds a batch after ``DEALS`` deals is counted
string by string: 128-bit digests meet in an aggregate, so no task holds a name.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing;
overlapping occurrences count, strings are judged on the input, and no string
reaches across documents; equal texts are treated equally, so rows that repeat lose
everything that is long enough; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumbook.llm.bwt import repeated_starts
from quorumbook.llm.filters import bit_filter, passes, place_of
from quorumbook.llm.tables import written

LENGTH = 200
GRAM = 64
#: Sizes of the filters of repeated names and of texts that are looked up again; full ones only cost time.
FILTER_BITS = 1 << 24
#: Bytes of a batch; names with more are dealt again, up to so many times, and then counted.
BATCH_BYTES = 2_000_000
GROUP_BYTES = 4_000_000
DEALS = 3
_ODD = 0x9E3779B97F4A7C15
_ID = "key bigint, c1 bigint, c2 bigint"
_RUNS = "array<struct<a:int,b:int>>"
#: Rows of one Arrow batch where a segment makes many.
_ROWS = 50_000


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(body: bytes, gram: int, seed: int) -> np.ndarray:
    """A hash of every ``gram`` consecutive bytes."""
    if len(body) < gram:
        return np.zeros(0, np.uint64)
    h = one = _byte_values(seed)[np.frombuffer(body, np.uint8)]
    have = 1
    while have < gram:
        step = min(have, gram - have)  # the next bytes are hashed already, for any number up to ``have``
        if step < have:
            tail = _span(one, step)
        else:
            tail = h
        count = len(body) - have - step + 1
        h = h[:count] * np.uint64(pow(_ODD, step, 1 << 64)) + tail[have:have + count]
        have += step
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _span(one: np.ndarray, size: int) -> np.ndarray:
    count = len(one) - size + 1
    h = np.zeros(count, np.uint64)
    for k in range(size):
        h = h * np.uint64(_ODD) + one[k:k + count]
    return h


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:have - width], h[width - have:]) if width > have else h


def segments(body: bytes, length: int, gram: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and sizes of the segments, and whether a segment has its least piece more than once."""
    if len(body) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    h = gram_hashes(body, gram, seed)
    least = _least_of(h, length - gram + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.append(starts[1:], len(least)) - starts + length - 1
    names = least[starts]
    again = np.array([np.count_nonzero(h[s:s + n - gram + 1] == v) > 1 for s, n, v in zip(
        starts.tolist(), sizes.tolist(), names)], bool)
    return names.view(np.int64), starts, sizes, again


def _digests(body: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[s:s + n]) for s, n in zip(
        starts.tolist(), sizes.tolist())), np.int64).reshape(-1, 2)


def _names(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The name of every segment, twice if its least piece occurs in it twice."""
    import pyarrow as pa

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for text in batch.column(0):
                names, _, _, again = segments(text.as_py().encode(), length, gram, 0)
                found += [names, names[again]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["key"])

    return texts.select("text").mapInArrow(name, "key bigint")


def _occurrences(texts: DataFrame, repeated: np.ndarray, length: int, gram: int) -> DataFrame:
    """Segments with a repeated name: key, c1, c2 (digest), start, size, again and the digest of their text."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(repeated)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column(0)):
                body = text.as_py().encode()
                names, starts, sizes, again = segments(body, length, gram, 0)
                if len(names):
                    parts.append((names, starts, sizes, again))
                    rows.append((i, body))
            if not rows:
                continue
            counts = [len(p[0]) for p in parts]
            places = shared.value, _places(np.concatenate([p[0] for p in parts]))
            hit = np.split(passes(*places), np.cumsum(counts)[:-1])
            row, digest, kept = [], [np.zeros((0, 2), np.int64)], []
            for (i, body), (names, starts, sizes, again), h in zip(rows, parts, hit):
                digest.append(_digests(body, starts[h], sizes[h]))
                kept.append((names[h], starts[h], sizes[h], again[h]))
                row.append(np.full(h.sum(), i))
            digest, row = np.concatenate(digest), np.concatenate(row)
            names, starts, sizes, again = (np.concatenate(x) for x in zip(*kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(starts.astype(np.int32)),
                 pa.array(sizes.astype(np.int32)), pa.array(again), batch.column(1).take(pa.array(row))],
                names=["key", "c1", "c2", "start", "size", "again", "digest"])

    return texts.select("text", "digest").mapInArrow(
        locate, f"{_ID}, start int, size int, again boolean, digest binary")


def _places(names: np.ndarray) -> np.ndarray:
    """Where a name lies in the filter: its own bits, which are mixed already."""
    return names & (FILTER_BITS - 1)


def _name_filter(names: DataFrame) -> np.ndarray:
    place = F.col("key").bitwiseAND(FILTER_BITS - 1)
    held = names.groupBy("key").count().where("count > 1").select(
        F.shiftright(place, 6).cast("int").alias("word"), F.col("key").bitwiseAND(63).cast("int").alias("bit")).groupBy(
        "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("held")).toArrow()  # at most FILTER_BITS / 64 rows
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[held.column("word").to_numpy()] = held.column("held").to_numpy()
    return words


def _cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted segments (digest, start, size, ...); only texts that may have any are moved."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(bit_filter(wanted, ["digest"], FILTER_BITS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(passes(shared.value, batch.column(2).to_numpy()))
            yield batch.select(["text", "digest"]).filter(hit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, parts = batch.column(0)[i].as_py().encode(), batch.column(1)[i].values
                at = [(s, s + n) for s, n in zip(parts.field("start").to_pylist(), parts.field("size").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [parts.field("key"), parts.field("c1"), parts.field("c2"), parts.field("many"),
                     pa.array([body[a:b] for a, b in at], pa.binary())], names=["key", "c1", "c2", "many", "body"])

    held = texts.select("text", "digest", place_of(["digest"], FILTER_BITS).alias("place")).mapInArrow(
        keep, "text string, digest binary")
    parts = wanted.groupBy("digest").agg(F.collect_list(F.struct("key", "c1", "c2", "many", "start", "size")).alias("parts"))
    once = held.groupBy("digest").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    return once.join(parts, "digest").select("text", "parts").mapInArrow(cut, f"{_ID}, many boolean, body binary")


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _batched(bodies: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """Repeated starts of each segment as runs, batch by batch of whole names."""
    import pyarrow as pa

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = [], 0, 0

        def solved() -> pa.RecordBatch:
            masks = repeated_starts([h[4] for h in held], length)
            runs = [_runs(m | h[3]) for m, h in zip(masks, held)]
            return pa.RecordBatch.from_arrays(
                [pa.array([h[k] for h in held], pa.int64()) for k in range(3)] + [pa.array(
                    [[{"a": a, "b": b} for a, b in r] for r in runs],
                    pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["key", "c1", "c2", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and row[0] != held[-1][0] and size >= batch_bytes:
                    yield solved()
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield solved()

    return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(expand, f"{_ID}, runs {_RUNS}")


def _dealt_again(bodies: DataFrame, length: int, gram: int, seed: int) -> DataFrame:
    """Segments of segments by another hash: their own identity, their parent's, place, size and bytes."""
    import pyarrow as pa

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, c1, c2, many, body in zip(*(batch.column(k).to_pylist() for k in range(5))):
                names, starts, sizes, again = segments(body, length, gram, seed)
                with np.errstate(over="ignore"):
                    names = (names ^ np.int64(key)) * np.int64(0x5851F42D4C957F2D)
                digest, n = _digests(body, starts, sizes), len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.full(n, key)),
                     pa.array(np.full(n, c1)), pa.array(np.full(n, c2)), pa.array(np.full(n, many)),
                     pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(again),
                     pa.array([body[s:s + z] for s, z in zip(starts.tolist(), sizes.tolist())], pa.binary())],
                    names=["key", "c1", "c2", "up", "u1", "u2", "many", "start", "size", "again", "body"])

    return bodies.mapInArrow(
        deal, f"{_ID}, up bigint, u1 bigint, u2 bigint, many boolean, start int, size int, again boolean, body binary")


def _classified(found: DataFrame, length: int, *firsts) -> tuple[DataFrame, DataFrame]:
    """Equal segments as one: those settled by a copy (with runs) and those that need a closer look."""
    classes = written(found.groupBy("key", "c1", "c2").agg(
        F.count("*").alias("n"), F.first("size").alias("size"), F.max("again").alias("again"), *firsts), "segment-classes")
    names = classes.groupBy("key").agg(
        F.count("*").alias("different"), F.sum(F.col("size").cast("bigint") + 1).alias("volume"))
    placed = classes.join(names, "key")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - (length - 1)).alias("b")))
    settled = placed.where("different = 1 AND n > 1").select("key", "c1", "c2", whole.cast(_RUNS).alias("runs"))
    return settled, placed.where("different > 1 OR (n = 1 AND again)").withColumn("many", F.col("n") > 1)


def _longer(gram: int, length: int) -> int:
    """The pieces of the next deal: half of what they lack of a whole string is added."""
    return gram + (length - gram + 1) // 2


def _strings(bodies: DataFrame, length: int) -> DataFrame:
    """Every different string of a segment as its digest (s1, s2): how often it starts and, if once, where.

    What repeats inside the segment is settled there and comes as rows of ``runs`` without a digest.
    """
    import pyarrow as pa
    import xxhash

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "c1", "c2", "s1", "s2", "times", "start", "runs"]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for key, c1, c2, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                starts = range(len(body) - length + 1)
                found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[p:p + length]) for p in starts), np.int64)
                found = found.view([("s1", np.int64), ("s2", np.int64)])
                unlike, first, of, times = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
                runs = [{"a": a, "b": b} for a, b in _runs(times[of] > 1)]
                none = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v]) for v in (key, c1, c2)] + [none] * 3 + [none.cast(pa.int32()), pa.array([runs], kind)], names=names)
                for at in range(0, len(first), _ROWS):
                    part = slice(at, at + _ROWS)
                    n = len(first[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, v)) for v in (key, c1, c2)] + [
                            pa.array(unlike["s1"][part]), pa.array(unlike["s2"][part]), pa.array(times[part]),
                            pa.array(first[part].astype(np.int32), mask=times[part] > 1), pa.nulls(n, kind)], names=names)

    return bodies.select("key", "c1", "c2", "body").mapInArrow(
        digest, f"{_ID}, s1 bigint, s2 bigint, times bigint, start int, runs {_RUNS}")


def _counted(bodies: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts by counting strings, for names of any volume."""
    strings = written(_strings(bodies, length), "strings")
    repeated = strings.where("s1 is not null").groupBy("key", "s1", "s2").agg(F.sum("times").alias("total")).where("total > 1")
    single = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + 1).alias("b"))).cast(_RUNS)
    elsewhere = strings.where("start is not null").join(repeated, ["key", "s1", "s2"]).select("key", "c1", "c2", single.alias("runs"))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("body") - (length - 1)).alias("b"))).cast(_RUNS)
    inside = strings.where("size(runs) > 0").select("key", "c1", "c2", "runs")
    return elsewhere.unionByName(inside).unionByName(bodies.where("many").select("key", "c1", "c2", whole.alias("runs")))


def _solved(bodies: DataFrame, length: int, gram: int, batch_bytes: int, group_bytes: int, deal: int) -> DataFrame:
    """Runs of repeated starts of all segments, in one or more rows each; bodies: key, c1, c2, many, body, volume (of
    the name)."""
    small = bodies.where(F.col("volume") <= group_bytes)
    solved = _batched(small.select("key", "c1", "c2", "many", "body"), length, batch_bytes)
    large = bodies.where(F.col("volume") > group_bytes).select("key", "c1", "c2", "many", "body")
    if large.isEmpty():
        return solved
    gram = _longer(gram, length)
    if deal > DEALS or gram >= length:
        return solved.unionByName(_counted(large, length))
    parts = written(_dealt_again(large, length, gram, deal), "dealt-again")
    settled, open_ = _classified(parts, length, F.first("body").alias("body"))
    inner = settled.unionByName(
        _solved(open_.select("key", "c1", "c2", "many", "body", "volume"), length, gram, batch_bytes, group_bytes, deal + 1))
    upward = parts.select("key", "c1", "c2", "up", "u1", "u2", "start").join(inner, ["key", "c1", "c2"])
    moved = upward.select(F.col("up").alias("key"), F.col("u1").alias("c1"), F.col("u2").alias("c2"), F.explode(
        F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b"))
                    )).alias("run"))
    # A segment that occurs more than once is repeated as a whole, whatever its parts say.
    marked = large.where("many").select("key", "c1", "c2", F.struct(
        F.lit(0).alias("a"), (F.octet_length("body") - (length - 1)).alias("b")).alias("run"))
    return solved.unionByName(moved.unionByName(marked).groupBy("key", "c1", "c2").agg(
        F.collect_list("run").cast(_RUNS).alias("runs")))


def repeated_spans(
    texts: DataFrame, length: int, gram: int, batch_bytes: int = BATCH_BYTES, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """(digest, spans): the maximal covered byte ranges of each text that has any; texts: text, digest."""
    import pyarrow as pa

    repeated = _name_filter(_names(texts, length, gram))
    found = written(_occurrences(texts, repeated, length, gram), "segments")
    settled, open_ = _classified(found, length, F.min(F.struct("digest", "start")).alias("where"))
    wanted = written(open_.select("key", "c1", "c2", "many", "size", "volume", "where.digest", "where.start"), "open-segments")
    bodies = written(_cut(texts, wanted).join(wanted.select("key", "volume").distinct(), "key"), "segment-bytes")
    runs = settled.unionByName(_solved(bodies, length, gram, batch_bytes, group_bytes, 1))
    covered = found.select("key", "c1", "c2", "digest", "start").join(runs, ["key", "c1", "c2"]).select(
        "digest", F.explode(F.transform("runs", lambda r: F.struct(
            (r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start") + (length - 1)).alias("b")))).alias("span"))
    spans = covered.groupBy("digest").agg(F.collect_set("span").alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            merged = []
            for spans in batch.column(1):
                parts = spans.values
                a, b = parts.field("a").to_numpy(), parts.field("b").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                merged.append([{"a": x, "b": y} for x, y in zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, kind)], names=["digest", "spans"])

    return spans.mapInArrow(merge, f"digest binary, spans {_RUNS}")


def remove_repeated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (byte ranges removed), kept (the remaining bytes)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    spans = written(repeated_spans(texts, length, min(gram, length), batch_bytes, group_bytes), "spans")
    body, size = F.col("text").cast("binary"), F.octet_length("text")
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["b"]))
    ends = F.concat(F.transform("spans", lambda s: s["a"]), F.array(size))
    parts = F.zip_with(begins, ends, lambda a, b: F.substring(body, a + 1, b - a).cast("string"))
    return texts.join(spans, "digest", "left").select(
        "doc_id", size.cast("bigint").alias("n_bytes"),
        F.coalesce("spans", F.array().cast(_RUNS)).alias("spans"),
        F.when(F.col("spans").isNull(), body).otherwise(F.array_join(parts, "").cast("binary")).alias("kept"))
