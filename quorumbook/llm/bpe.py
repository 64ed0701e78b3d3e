"""Byte-level BPE as a fold of ranked merges over the distinct words, in arrays inside Spark's tasks.

The rank map is a sorted array of numbers, each for two neighbouring pieces, beside the
ranks of what they join to.  The words of a chunk lie one after the other in one array,
at first as the ids of their bytes.  Each turn of the fold joins in every word the
leftmost pair of least rank and looks up the pairs on both sides of it; words without a
ranked pair leave the array, until none is left.  Decoding looks the ids up and
concatenates the binary pieces, in Spark's higher-order functions.

Words are folded once per chunk of documents, not once per occurrence, and words that
are frequent in a sample are folded beforehand.  Documents never leave their task, so
nothing is shuffled but the counts of the sample.

Words that are pieces themselves have their own id and are not folded.  A turn of the
fold looks at the whole word, so words of more than ``LONG_WORD`` characters (a run of
base64, say) are first cut by a heap of ranked merges into the pieces they end up as, and
each piece is a word for the fold then: no merge crosses its ends, so it joins again.

Bounds: at most ``PREPARED_WORDS`` words from about ``PREPARED_FROM`` documents are
prepared and broadcast; which words these are changes the speed and never the ids.

Defined results: a null text is empty and has no ids; rows that repeat an id are
encoded separately; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREPARED_WORDS = 100_000
PREPARED_FROM = 8000
CHUNK_BYTES = 2_000_000
LONG_WORD = 200
_WORD = ("words", "ids", "texts", "bodies")
OUTPUTS = ("ids", "ids_text", "decoded")
#: Above every rank: the pair is no piece.
_NO_RANK = 2**31 - 1
_PLACES = 2**32
#: Above every id, so that two ids are one number.
_IDS = 1 << 24
_UNIT = 1 << 30
_GROUPS = 64
_ROWS = 256


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of every two pieces that join to a piece, by the number that stands for the two."""
    joined = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                joined[left * _IDS + right] = rank
    return joined


@dataclass(frozen=True)
class Merges:
    """The rank map in arrays: sorted numbers of pairs, their ranks, and the id of each byte."""

    pairs: np.ndarray
    joined: np.ndarray
    single: np.ndarray

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left * _IDS + right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.joined[at], _NO_RANK)


def merges(ranks: dict[bytes, int]) -> Merges:
    found = pair_ranks(ranks) or {-1: _NO_RANK}
    pairs = np.array(sorted(found), np.int64)
    return Merges(pairs, np.array([found[p] for p in pairs.tolist()], np.int64),
                  np.array([ranks[bytes([b])] for b in range(256)], np.int64))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded_words(words: list[bytes], table: Merges):
    """For each of a list of words (not empty) the ids of its pieces after all merges, as an array of lists."""
    import pyarrow as pa

    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = table.single[np.frombuffer(b"".join(words), np.uint8)]
    rank = np.full(len(ids), _NO_RANK, np.int64)  # of a piece and the next one of its word
    if len(ids) > 1:
        rank[:-1] = table.ranks(ids[:-1], ids[1:])
    rank[np.cumsum(sizes) - 1] = _NO_RANK
    word, done = np.arange(len(words)), []
    while len(word):
        starts = np.cumsum(sizes) - sizes
        # The least rank and, of equal ones, the first place, as one number.
        least = np.minimum.reduceat(rank * _PLACES + np.arange(len(rank)), starts)
        joins = least < _NO_RANK * _PLACES
        left, ended = np.repeat(joins, sizes), ~joins
        done.append((word[ended], sizes[ended], ids[~left]))
        least, word, sizes = least[joins], word[joins], sizes[joins] - 1
        at = least % _PLACES
        ids[at] = least // _PLACES
        left[at + 1] = False
        at = np.cumsum(left)[at] - 1
        ids, rank = ids[left], rank[left]
        starts = np.cumsum(sizes) - sizes
        last = at == starts + sizes - 1
        rank[at[last]] = _NO_RANK
        inner = at[~last]
        rank[inner] = table.ranks(ids[inner], ids[inner + 1])
        later = at[at > starts]
        rank[later - 1] = table.ranks(ids[later - 1], ids[later])
    if not done:
        return pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int32()))
    word, sizes, ids = (np.concatenate(parts) for parts in zip(*done))
    ids = ids[np.argsort(np.repeat(word, sizes), kind="stable")]
    cuts = np.append(0, np.cumsum(sizes[np.argsort(word)]))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))


def _piece_literal(ranks: dict[bytes, int]) -> Column:
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = base64.b64encode(piece).decode()
    return F.from_json(F.lit(json.dumps(by_id)), "array<binary>")


def decoded_all(lists: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of each of an array of id arrays."""
    def joined(pieces: Column, ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda i: F.get(pieces, i).cast("string")), "").cast("binary")

    return _let(_piece_literal(ranks), lambda pieces: F.transform(lists, lambda ids: joined(pieces, ids)))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    return F.get(decoded_all(F.array(ids), ranks), F.lit(0))


def pieces_of_long_word(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that a word ends up as, merge by merge from a heap: n log n where the fold takes n times n."""
    ends = list(range(1, len(word) + 1))  # where the piece that begins here ends; 0 where none begins any more
    before = list(range(-1, len(word) - 1))
    heap = [(rank, i) for i in range(len(word) - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
    heapify(heap)

    def offer(at: int) -> None:
        middle = ends[at]
        if middle < len(word) and (rank := ranks.get(word[at:ends[middle]])) is not None:
            heappush(heap, (rank, at))

    while heap:
        rank, at = heappop(heap)
        middle = ends[at]
        # A pair that has changed since was offered anew with another rank.
        if not middle or middle == len(word) or ranks.get(word[at:ends[middle]]) != rank:
            continue
        ends[at], ends[middle] = ends[middle], 0
        if ends[at] < len(word):
            before[ends[at]] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < len(word):
        out.append(word[at:ends[at]])
        at = ends[at]
    return out


class _Codes(dict):
    """Number the words of a chunk: prepared words as they are, others from there on."""

    def __init__(self, prepared: dict[str | bytes, int]):
        super().__init__()
        self.prepared, self.new = prepared, []

    def __missing__(self, word: str) -> int:
        code = self.prepared.get(word)
        if code is None:
            code = len(self.prepared) + len(self.new)
            self.new.append(word)
        self[word] = code
        return code


def _as_words(word: str, ranks: dict[bytes, int]) -> list[str | bytes]:
    """The pieces of a long word, as texts where they are texts."""
    return [p.decode() if _is_text(p) else p for p in pieces_of_long_word(word.encode(), ranks)]


def _finders(pattern: str):
    """How to split a text, and an equal but faster way for ASCII texts."""
    import regex

    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    whole = regex.compile(pattern).findall
    return whole, whole if r"\p{" in plain else re.compile(plain, re.ASCII).findall


def _prepared_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int, sample: int) -> bytes:
    """Word and ids of the most frequent words of some documents, ``most`` rows at most, as a serialised table."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    total = docs.count()
    part = F.pmod(F.xxhash64("text"), F.lit(_UNIT)) < min(_UNIT, -(-sample * _UNIT // max(1, total)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, ascii_only = _finders(pattern)
        for batch in batches:
            seen = Counter()
            for text in batch.column(0):
                text = text.as_py()
                found = (ascii_only if text.isascii() else whole)(text)
                seen.update(w for w in found if len(w) <= LONG_WORD)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "n"])

    counted = docs.select("text").where(part).mapInArrow(count, "word binary, n bigint")
    frequent = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    rows = frequent.groupBy(F.pmod(F.xxhash64("word"), F.lit(_GROUPS))).agg(F.collect_list("word").alias("words"))
    table = merges(ranks)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0):
                yield pa.RecordBatch.from_arrays(
                    [_one(words.values), _one(folded_words(words.as_py(), table))], names=["words", "ids"])

    folded = rows.select("words").mapInArrow(fold, "words array<binary>, ids array<array<int>>")
    found = _spelled(folded, ranks).select(F.explode(F.arrays_zip(*_WORD)).alias("w")).select("w.*").toArrow()
    own = [(piece, rank) for piece, rank in ranks.items() if _is_text(piece)]
    pieces = pa.table([[p for p, _ in own], [[r] for _, r in own], [str(r) for _, r in own], [p for p, _ in own]],
                      schema=found.schema)
    known = pa.compute.is_in(found.column("words"), value_set=pieces.column("words"))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, found.schema) as stream:
        stream.write_table(pa.concat_tables([pieces, found.filter(pa.compute.invert(known))]))
    return out.getvalue().to_pybytes()


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def _spelled(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add the ids of the words of each row as text, and the bytes that these decode to."""
    texts = F.transform("ids", lambda x: F.array_join(x.cast("array<string>"), ","))
    return rows.withColumn("texts", texts).withColumn("bodies", decoded_all(F.col("ids"), ranks))


class _Words:
    """What each numbered word contributes to a document."""

    def __init__(self):
        self.sizes, self.ids, self.texts, self.bodies = [], [], [], []

    def add(self, ids, texts, bodies) -> None:
        """Append the words of list, text and binary columns."""
        cuts = ids.offsets.to_numpy()
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("int32").tobytes()
        self.sizes += (cuts[1:] - cuts[:-1]).tolist()
        cuts = ((cuts - cuts[0]) * 4).tolist()
        self.ids += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.texts += texts.to_pylist()
        self.bodies += bodies.to_pylist()

    def cut(self, size: int) -> None:
        for values in (self.sizes, self.ids, self.texts, self.bodies):
            del values[size:]


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    outputs: tuple[str, ...] = OUTPUTS, prepared_words: int = PREPARED_WORDS, prepared_from: int = PREPARED_FROM,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """doc_id, n_tokens and the wanted of ids (array<int>), ids_text (decimal, with commas) and decoded (bytes)."""
    import pyarrow as pa

    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Bounded by prepared_words.
    known = docs.sparkSession.sparkContext.broadcast(_prepared_words(docs, ranks, pattern, prepared_words, prepared_from))
    pairs = merges(ranks)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, ascii_only = _finders(pattern)
        prepared = pa.ipc.open_stream(known.value).read_all().column("words").to_pylist()
        numbers = {w.decode(): i for i, w in enumerate(prepared)}
        del prepared
        for batch in batches:
            at, codes, held, words = 0, [], 0, _Codes(numbers)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                found = (ascii_only if text.isascii() else whole)(text)
                if max(map(len, found), default=0) > LONG_WORD:
                    found = [p for w in found for p in ([w] if len(w) <= LONG_WORD else _as_words(w, ranks))]
                codes.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)).tobytes())
                held += len(text)
                if held >= chunk_bytes or i + 1 == batch.num_rows:
                    ids = batch.column(0).slice(at, i + 1 - at)
                    new = [w if isinstance(w, bytes) else w.encode() for w in words.new]
                    yield pa.RecordBatch.from_arrays(
                        [_one(ids), _one(pa.array(codes, pa.binary())), _one(folded_words(new, pairs))],
                        names=["doc_ids", "codes", "ids"])
                    at, codes, held, words = i + 1, [], 0, _Codes(numbers)

    kinds = {"ids": pa.list_(pa.int32()), "ids_text": pa.string(), "decoded": pa.binary()}

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words()
        for prepared in pa.ipc.open_stream(known.value):
            table.add(*(prepared.column(c) for c in ("ids", "texts", "bodies")))
        ready = len(table.sizes)
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, codes = batch.column(0)[r].values, batch.column(1)[r].values
                table.add(*(batch.column(k)[r].values for k in (2, 3, 4)))
                sizes = np.array(table.sizes, np.int64)
                for at in range(0, len(codes), _ROWS):
                    part = [np.frombuffer(c.as_py(), np.uint32) for c in codes.slice(at, _ROWS)]
                    columns = [doc_ids.slice(at, _ROWS), pa.array([int(sizes[c].sum()) for c in part], pa.int64())]
                    part = [c.tolist() for c in part]
                    for name in outputs:
                        if name == "ids_text":
                            values = [",".join(map(table.texts.__getitem__, c)) for c in part]
                        elif name == "decoded":
                            values = [b"".join(map(table.bodies.__getitem__, c)) for c in part]
                        else:
                            values = [np.frombuffer(b"".join(map(table.ids.__getitem__, c)), np.int32) for c in part]
                        columns.append(pa.array(values, kinds[name]))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *outputs])
                table.cut(ready)

    chunks = docs.mapInArrow(split, f"doc_ids array<{kind}>, codes array<binary>, ids array<array<int>>")
    sql = {"ids": "array<int>", "ids_text": "string", "decoded": "binary"}
    wanted = "".join(f", {name} {sql[name]}" for name in outputs)
    return _spelled(chunks, ranks).select("doc_ids", "codes", "ids", "texts", "bodies").mapInArrow(
        assemble, f"doc_id {kind}, n_tokens bigint{wanted}")


def _one(values):
    """A list array whose only element holds all ``values``."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
