"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document is its set of word shingles.  Two permutations of the 32-bit numbers
make the whole signature: the first scatters the shingles, the second, shifted
circularly by one step more for each coordinate, gives the value whose minimum is
that coordinate.  ``ROWS`` coordinates form a band; sets that agree in a band are
candidates, and a pair at the threshold misses all ``BANDS`` bands with a chance
of 6 in 10^8.  Links are confirmed on the full sets.

Groups of any size are handled without all their pairs.  Equal sets are one class
from the start.  In each bucket every class is first compared with the least one
only; these links join nearly all that belongs together.  What is left are buckets
whose classes lie in several components: there, and only there, each class outside
the largest component is compared with all classes of other components, in chunks
of bounded size past which the others stream.  So no link between classes of
different components goes unseen, and a group of copies costs about as much as
its members.

Defined results: words are separated by ASCII white space and lower-cased in A-Z;
a text with fewer words than a shingle has its whole sequence as one; a text
without words, or none, has an empty set and no link; a row without an id has
no component and stays; rows that repeat an id are judged by their own text; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumbook.llm.components import connected
from quorumbook.llm.filters import bit_filter, passes, place_of
from quorumbook.llm.tables import written

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 42, 5
SHINGLES_PER_CHUNK = 500_000
#: Size of the filter that spares documents without a candidate a second look; a full one only costs time.
FILTER_BITS = 1 << 24
_AT_ONCE = 1 << 14
# Odd multipliers and the step of the shift; any would do.
_A, _B, _C, _D, _STEP = (np.uint32(x) for x in (0x7FEB352D, 0x846CA68B, 0x2C1B3C6D, 0x297A2D39, 0x9E3779B1))
_WORD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    span = min(words, len(hashes))
    count = len(hashes) - span + 1
    mixed = np.full(count, span, np.uint64)
    for k in range(span):
        mixed = (mixed ^ hashes[k:k + count]) * _WORD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * _A
    x = (x ^ (x >> np.uint32(15))) * _B
    return x ^ (x >> np.uint32(16))


def _shuffle(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place; it is shifted circularly by adding to its argument."""
    x ^= x >> np.uint32(15)
    x *= _C
    x ^= x >> np.uint32(12)
    x *= _D
    x ^= x >> np.uint32(15)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of the circulant MinHash signature."""
    start = _scatter((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    shifts = np.arange(coordinates, dtype=np.uint32) * _STEP
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    width = max(1, _AT_ONCE // 64)
    for at in range(0, len(start), width):
        part = _shuffle(start[at:at + width, None] + shifts[None, :])
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, of its number and its coordinates."""
    parts = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _WORD
    for r in range(rows):
        key = (key ^ parts[:, r]) * _WORD
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def linked(shared: int, first: int, second: int, percent: int) -> bool:
    return 100 * shared >= percent * (first + second - shared)


def _signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    import pyarrow as pa

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words)
                sizes.append(len(found))
                digests.append(hashlib.md5(found.tobytes()).digest())
                keys.append(band_keys(found, bands, rows) if len(found) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n", "digest", "keys"])

    return docs.mapInArrow(sign, "doc_id bigint, n bigint, digest binary, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the documents whose id is wanted, without moving any text."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, ["doc_id"], FILTER_BITS))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column(2).to_numpy())))
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [shingle_set(text.as_py(), words).view(np.int64) for text in part.column(1)]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(f) for f in found], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))],
                    names=["doc_id", "n", "shingles"])

    placed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", place_of(["doc_id"], FILTER_BITS).alias("place"))
    sets = placed.mapInArrow(collect, "doc_id bigint, n bigint, shingles array<bigint>")
    return sets.join(wanted, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")


def _cross_links(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between components; ``rows`` sorted by (key, chunk, side), side 0 a chunk, side 1 the rest."""
    import pyarrow as pa

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, chunk, joined = None, [], {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for batch in batches:
            found = []
            keys, chunks, sides, reps, comps = (batch.column(i).to_numpy() for i in range(5))
            lists = batch.column(5)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                if (keys[i], chunks[i]) != where:
                    where, chunk, joined = (keys[i], chunks[i]), [], {}
                mine = flat[offsets[i]:offsets[i + 1]]
                if sides[i] == 0:
                    chunk.append((reps[i], comps[i], mine.copy()))
                    continue
                for rep, comp, other in chunk:
                    low, high = sorted((len(mine), len(other)))
                    if 100 * low < percent * high or root(comp) == root(comps[i]):
                        continue
                    at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                    if linked(int((other[at] == mine).sum()), len(mine), len(other), percent):
                        found.append((reps[i], rep))
                        joined[root(comp)] = root(comps[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                names=["a", "b"])

    return rows.mapInArrow(compare, "a bigint, b bigint")


def near_components(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text", shingles_per_chunk: int = SHINGLES_PER_CHUNK,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(_signatures(docs, words, bands, rows), "signatures")
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")

    keyed = classes.select("rep", "n", F.explode("keys").alias("key"))
    # Buckets with the same members, told by two sums of hashes, are looked at once.
    buckets = keyed.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("n").alias("volume"), F.min("rep").alias("least"),
        F.sum(F.xxhash64("rep").bitwiseAND((1 << 40) - 1)).alias("h1"),
        F.sum(F.xxhash64(F.lit(1), "rep").bitwiseAND((1 << 40) - 1)).alias("h2"),
    ).where("size > 1").groupBy("size", "h1", "h2").agg(
        F.min("key").alias("key"), F.first("least").alias("least"), F.first("volume").alias("volume"))
    members = written(keyed.join(buckets.select("key", "least", "volume"), "key"), "buckets")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(_sets(docs, wanted, words), "shingles")

    # First the least class of each bucket with all others.
    pairs = members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(two, "b").join(one, "a").where(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    shared = F.size(F.array_intersect("sa", "sb"))
    stars = both.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")
    joined = written(connected(stars), "components")

    # Then what the components of a bucket still have to be asked.
    placed = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("n_in"))
    mixed = shares.groupBy("key").agg(
        F.count("*").alias("components"), F.max_by("component", F.struct("n_in", "component")).alias("largest")
    ).where("components > 1").drop("components")
    asked = written(placed.join(mixed, "key"), "mixed-buckets")
    chunks = F.ceil(F.col("volume") / shingles_per_chunk).cast("int")
    held = asked.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("side", F.lit(0))
    passing = asked.where("component <> largest").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("side", F.lit(1))
    columns = ["key", "chunk", "side", "rep", "component"]
    compared = held.select(columns).unionByName(passing.select(columns)).join(sets.select("rep", "shingles"), "rep")
    crossed = _cross_links(
        compared.select(*columns, "shingles").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "side"), percent)
    links = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(crossed)
    final = connected(links).withColumnRenamed("node", "rep")

    of_class = classes.select("digest", "rep").join(final, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    rest = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    found = known.select("doc_id", "n", "digest").join(of_class, "digest").select("doc_id", "n", "component")
    return found.unionByName(rest).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows without an id stay."""
    gone = near_components(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("kept")).select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
