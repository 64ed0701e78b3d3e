"""Nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to unit length, so that the nearest by distance is the nearest
by cosine, and cut into two halves.  Each half has its own codebook of ``CODES``
centroids; a pair of centroids is a cell.  A query walks the pairs in the order of
their summed distance with a heap and opens cells until these hold enough distinct
vectors; the vectors of the open cells are then ranked exactly, in double
precision, on the original components.

Bounds: codebooks are fitted on about ``SAMPLE`` vectors drawn by a hash of the
id; every vector is indexed.  Only the codebooks and the sizes of the
``CODES`` ** 2 cells reach the driver.  ``SHARE`` is how much of the table the
opened cells hold: half suffices for a recall of 0.9 where the vectors have no
structure at all; clustered vectors need far less.

Execution: vectors are dealt by the centroid of their first half and, in chunks of
``ROWS_PER_CHUNK``, by a hash, so a cell that holds a third of all rows is many
chunks.  Each query goes once to each chunk with the list of its open cells there.
A task keeps one chunk in memory while the queries stream past it, and returns at
most k rows per query and chunk.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part, nor do rows without an id;
equal scores go to the smaller id; rows that repeat an id are candidates of their
own, but never of the query with that id; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumbook.llm.tables import written

CODES = 32
SAMPLE = 20_000
SHARE = 0.5
LEAST_CANDIDATES = 2000
ROWS_PER_CHUNK = 4096
_ROUNDS = 12
_UNIT = 1 << 30
#: Scores of the matrix product within this of the k-th are computed again, pair by pair.
_SLACK = 1e-9


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its centroids."""
        cut = self.first.shape[1]
        return _squared(unit[:, :cut], self.first), _squared(unit[:, cut:], self.second)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x ** 2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids ** 2).sum(1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def fit_codebook(x: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds; fewer, if there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    start = np.random.default_rng(seed).choice(len(distinct), min(codes, len(distinct)), replace=False)
    centroids = distinct[start]
    for _ in range(_ROUNDS):
        near = _squared(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=len(centroids))
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def open_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs of centroids by increasing summed distance until their sizes add up to ``wanted``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    opened, held = [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        pair = int(a[i]), int(b[j])
        if sizes[pair]:
            opened.append(pair)
            held += sizes[pair]
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):  # the head of each row enters once, after the head of the row before
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return opened


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    codes: int = CODES, share: float = SHARE, rows_per_chunk: int = ROWS_PER_CHUNK, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row where ``is_query`` (over ``vectors``) holds."""
    import pyarrow as pa

    usable = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    result = "query_id bigint, rank int, vec_id bigint, score double"
    lengths = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], result)
    dim, total = lengths["n"], lengths["count"]
    usable = usable.where(F.size("vector") == dim)

    part = F.pmod(F.xxhash64("vec_id"), F.lit(_UNIT)) < min(_UNIT, -(-sample * _UNIT // total))
    drawn = usable.where(part).select("vector").limit(2 * sample).toPandas()["vector"]
    if not len(drawn):
        drawn = usable.select("vector").limit(1).toPandas()["vector"]
    units = _unit(np.stack(drawn))
    cut = max(1, dim // 2)
    books = Codebooks(fit_codebook(units[:, :cut], codes, 1), fit_codebook(units[:, cut:], codes, 2))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, second = books.distances(_unit(_matrix(batch.column(1), dim)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(first.argmin(1).astype(np.int32)), pa.array(second.argmin(1).astype(np.int32))],
                    names=["vec_id", "vector", "asks", "a", "b"],
                )

    index = written(usable.mapInArrow(
        assign, "vec_id bigint, vector array<double>, asks boolean, a int, b int"), "multi-index")
    # A vector that occurs many times fills a cell only once; else its copies would end every walk near them.
    counts = index.groupBy("a", "b", F.xxhash64("vector")).agg(F.count("*").alias("copies")).groupBy("a", "b").agg(
        F.count("*").alias("distinct"), F.sum("copies").alias("rows")).collect()
    sizes = np.zeros((len(books.first), len(books.second)), np.int64)
    rows = np.zeros(len(books.first), np.int64)
    for c in counts:
        sizes[c["a"], c["b"]] = c["distinct"]
        rows[c["a"]] += c["rows"]
    chunks = np.maximum(1, -(-rows // rows_per_chunk))
    wanted = max(LEAST_CANDIDATES, int(np.ceil(share * sizes.sum())))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query once for each chunk that it visits, with its cells there."""
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = books.distances(_unit(_matrix(batch.column(1), dim)))
            row, a, chunk, cells = [], [], [], []
            for i in range(batch.num_rows):
                opened: dict[int, list[int]] = {}
                for x, y in open_cells(first[i], second[i], sizes, wanted):
                    opened.setdefault(x, []).append(y)
                for x, ys in opened.items():
                    for c in range(chunks[x]):
                        row.append(i)
                        a.append(x)
                        chunk.append(c)
                        cells.append(ys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())),
                 pa.array(a, pa.int32()), pa.array(chunk, pa.int64()), pa.array(cells, pa.list_(pa.int32()))],
                names=["vec_id", "vector", "a", "chunk", "cells"],
            )

    asked = index.where("asks").select("vec_id", "vector").mapInArrow(
        walk, "vec_id bigint, vector array<double>, a int, chunk bigint, cells array<int>")
    pieces = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("a") + 1)
    stored = index.select("vec_id", "vector", "a", F.pmod(F.xxhash64("vec_id"), pieces).alias("chunk"),
                          F.array("b").alias("cells"), F.lit(0).alias("side"))
    both = stored.unionByName(asked.withColumn("side", F.lit(1))).select("a", "chunk", "side", "vec_id", "vector", "cells")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk = None, [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.flatnonzero(np.any(where[1:] != where[:-1], axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                ids, cells = part.column(3).to_numpy(), part.column(5)
                if tuple(where[lo, :2]) != key:
                    key, held, chunk = tuple(where[lo, :2]), [], None
                if where[lo, 2] == 0:
                    held.append((ids, _matrix(part.column(4), dim), cells.flatten().to_numpy()))
                elif held:
                    if chunk is None:
                        chunk = tuple(np.concatenate(x) for x in zip(*held))
                    for at in range(0, len(ids), 256):
                        yield _ranked(ids[at:at + 256], _matrix(part.column(4), dim)[at:at + 256],
                                      cells.slice(at, 256), chunk, len(books.second), k)

    found = both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(
        rank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _ranked(ids, queries, cells, chunk, codes: int, k: int):
    """The k best of a chunk for some queries, scored pair by pair on the original components."""
    import pyarrow as pa

    stored_ids, stored, cell = chunk
    allowed = np.zeros((len(ids), codes), bool)
    lengths = np.diff(cells.offsets.to_numpy())
    allowed[np.repeat(np.arange(len(ids)), lengths), cells.flatten().to_numpy()] = True
    scores = _unit(queries) @ _unit(stored).T
    scores[~allowed[:, cell] | (ids[:, None] == stored_ids[None, :])] = -np.inf
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(ids), -np.inf)
    q, s = np.nonzero((scores >= least[:, None] - _SLACK) & (scores > -np.inf))
    sizes = np.sqrt((queries[q] ** 2).sum(1)) * np.sqrt((stored[s] ** 2).sum(1))
    exact = (queries[q] * stored[s]).sum(1) / sizes
    order = np.lexsort((stored_ids[s], -exact, q))
    q, s, exact = q[order], s[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    top = place < k
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[q[top]]), pa.array(stored_ids[s[top]]), pa.array(exact[top])],
        names=["query_id", "vec_id", "score"],
    )
