"""Alignment of two tokenizers over the same texts, and which of their tokens go together.

A text is encoded by a byte-level BPE (A, of the text after one space) and by a
sentence-piece model (B, which adds that space itself).  Both cut the same bytes, so
tokens are compared by the byte offset at which they end.

Inside a task the work is a pipeline of Arrow arrays over many documents at once:
lists of ids are flattened with the index of their document, token lengths are
summed up per document to ends, and a full outer hash join on (document, end) brings
the ends of both sides together.  Each row of it, in order, is one link: the token of
A and the token of B that cover the bytes up to that end.  Rows with an end on both
sides cut the text into groups.

How many documents hold a linked pair is counted per batch by ``Table.group_by`` and
merged by Spark.  The most frequent pairs, a bounded number, go to all tasks; the
links of other pairs meet their counts in a join.  All links are counted either way.

Defined results: a text that is null or empty, or that one side does not give back
byte for byte, has no tokens, and all its figures are zero; rows that repeat an id are
documents of their own; an empty table gives no rows; further columns are ignored.
Strings of special tokens in a text are plain text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumbook.llm.tables import written

#: UTF-8 bytes of the texts that one pass over arrays takes; a longer text is one pass.
CHUNK_BYTES = 1 << 21
#: Pairs whose counts every task holds (20 bytes each).
FREQUENT_PAIRS = 1 << 18
#: Distinct pairs that a task counts before it hands on what it has.
_PARTIAL_PAIRS = 1 << 20
_END_BITS = 40

#: White space, printable ASCII and Latin letters, on which pattern engines agree; other texts go to the slower library.
_UNSURE = re.compile("[^\t-\r\x20-\x7e\xa0-\u024f]").search
#: The library that is quick on common words takes quadratic time on a run of so many characters without a space.
_LONG_RUN = re.compile(r"\S{1000}").search


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a visible letter: itself, or the next free one from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _ByteLevel:
    """Side A: ids of a text after one space, and the bytes of every id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        letters, vocabulary = _byte_of_letter(), parts["model"]["vocab"]
        self.pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for word, number in vocabulary.items():
            if all(c in letters for c in word):
                self.pieces[number] = bytes(letters[c] for c in word)
        merges = [m if isinstance(m, str) else " ".join(m) for m in parts["model"]["merges"]]
        splits = parts["pre_tokenizer"] or {}
        # Ids that are ranks: the same merges in the same order as a table of ranks, over the same pattern.
        self.ranked = None
        special = {t["content"] for t in parts["added_tokens"]}
        if parts["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get(
                "add_prefix_space") and [vocabulary.get(m.replace(" ", "")) for m in merges] == list(
                range(256, 256 + len(merges))):
            from public_tokenizers import PATTERN

            ranks = {self.pieces[n]: n for w, n in vocabulary.items() if w not in special}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(f" {text}") for text in texts]

    def _one(self, text: str) -> np.ndarray:
        if self.ranked is None or _UNSURE(text) or _LONG_RUN(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class _Pieces:
    """Side B: ids of a text, to which the model adds a space, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]


class _Side:
    """One tokenizer with Arrow arrays of the bytes, their number and the decimal digits of every id."""

    def __init__(self, encoder):
        import pyarrow as pa

        self.encoder = encoder
        self.bytes = pa.array(encoder.pieces, pa.large_binary())
        self.lengths = pa.array([len(p) for p in encoder.pieces], pa.int64())
        numbers = [str(i).encode() for i in range(len(encoder.pieces))]
        width = max(map(len, numbers), default=1)
        self.n_digits = np.array([len(n) for n in numbers], np.int64)
        self.digits = np.frombuffer(b"".join(n.ljust(width) for n in numbers), np.uint8).reshape(-1, width)

    def lists(self, texts: list[str]):
        return _list_array(self.encoder.encode(texts))

    def gives_back(self, lists, wanted: list[bytes]) -> np.ndarray:
        """For each text, whether the tokens' bytes are its bytes."""
        joined = self.bytes.take(lists.values)
        found = joined.buffers()[2].to_pybytes() if len(joined) else b""
        places = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
        ends = places[lists.offsets.to_numpy()]
        return np.array([found[a:b] == text for a, b, text in zip(ends, ends[1:], wanted)], bool)


@lru_cache(maxsize=4)
def _sides(byte_level: str, pieces: str) -> tuple[_Side, _Side]:
    """Loaded once per worker."""
    return _Side(_ByteLevel(byte_level)), _Side(_Pieces(pieces))


def _list_array(arrays: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *arrays]))


def token_ends(lists, lengths):
    """Every token of every list with the key of its document and the byte offset of its end in it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    sums = pc.cumulative_sum(lengths.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums]).take(lists.offsets.slice(0, len(lists)))
    ends = pc.subtract(sums, before.take(parents))
    return pa.table({"key": pc.add(pc.shift_left(parents, pa.scalar(_END_BITS, pa.int64())), ends), "id": ids})


def joined_ends(a_lists, b_lists, a_lengths, b_lengths):
    """One row per link in the order of the texts: key, a and b (ids, null where the side has no end)."""
    a = token_ends(a_lists, a_lengths).rename_columns(["key", "a"])
    b = token_ends(b_lists, b_lengths).rename_columns(["key", "b"])
    return a.join(b, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()


def _column(table, name: str):
    import pyarrow as pa

    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def _group_texts(a: _Side, b: _Side, a_ids, b_ids, a_group, b_group, doc_of_group, n_docs: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` for every document: ids in order, groups apart by a semicolon."""
    n_groups = len(doc_of_group)
    b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=n_groups))])
    a_upto = np.cumsum(np.bincount(a_group, minlength=n_groups))
    width = max(a.digits.shape[1], b.digits.shape[1]) + 1
    letters = np.zeros((len(a_ids) + len(b_ids), width), np.uint8)
    used, document = np.zeros(len(letters), np.int64), np.zeros(len(letters), np.int64)
    for side, ids, group, place, mark in (
        (a, a_ids, a_group, np.arange(len(a_ids)) + b_before[a_group], b"|"),
        (b, b_ids, b_group, np.arange(len(b_ids)) + a_upto[b_group], b";"),
    ):
        letters[place, :side.digits.shape[1]] = side.digits[ids]
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        letters[place, side.n_digits[ids]] = np.where(last, ord(mark), ord(","))
        used[place], document[place] = side.n_digits[ids] + 1, doc_of_group[group]
    text = letters[np.arange(width) < used[:, None]].tobytes().decode()
    ends = np.cumsum(np.bincount(document, weights=used, minlength=n_docs).astype(np.int64))
    return [text[start:max(end - 1, start)] for start, end in zip([0, *ends], ends)]


def align_batch(texts: list[str | None], a: _Side, b: _Side):
    """One row per text: n_a, n_b, n_groups, n_links, groups, and its linked pairs (a_ids, b_ids, times)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = [text or "" for text in texts]
    wanted = [f" {text}".encode() for text in plain]
    a_lists, b_lists = a.lists(plain), b.lists(plain)
    whole = a.gives_back(a_lists, wanted) & b.gives_back(b_lists, wanted) & np.array([bool(t) for t in plain], bool)
    if not whole.all():
        a_lists, b_lists = (_list_array([
            x.values.to_numpy()[s:e] if ok else np.zeros(0, np.int32)
            for s, e, ok in zip(x.offsets.to_numpy(), x.offsets.to_numpy()[1:], whole)]) for x in (a_lists, b_lists))
    n = len(texts)
    ends = joined_ends(a_lists, b_lists, a.lengths, b.lengths)
    document = _column(ends, "key").to_numpy() >> _END_BITS
    a_end, b_end = _column(ends, "a"), _column(ends, "b")
    here_a, here_b = (pc.is_valid(x).to_numpy(zero_copy_only=False) for x in (a_end, b_end))
    cut = here_a & here_b
    group = np.cumsum(cut) - cut  # the last end of a text is on both sides, so no group spans two texts
    groups = _group_texts(a, b, a_lists.values.to_numpy(), b_lists.values.to_numpy(), group[here_a], group[here_b],
                          document[cut], n)
    links = pa.table({"document": document, "a": pc.fill_null_backward(a_end), "b": pc.fill_null_backward(b_end)})
    pairs = links.group_by(["document", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by(
        [("document", "ascending"), ("a", "ascending"), ("b", "ascending")]).combine_chunks()
    starts = np.searchsorted(_column(pairs, "document").to_numpy(), np.arange(n + 1)).astype(np.int32)

    def listed(name: str):
        return pa.ListArray.from_arrays(starts, _column(pairs, name).cast(pa.int32()))

    def counted(rows: np.ndarray):
        return pa.array(np.bincount(rows, minlength=n).astype(np.int64))

    return {
        "n_a": pc.list_value_length(a_lists).cast(pa.int64()), "n_b": pc.list_value_length(b_lists).cast(pa.int64()),
        "n_groups": counted(document[cut]), "n_links": counted(document), "groups": pa.array(groups, pa.string()),
        "a_ids": listed("a"), "b_ids": listed("b"), "times": listed("count_all"),
    }


def align_tokens(
    docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Every document with its groups, as text, and its linked pairs of ids with how often they occur.

    ``byte_level`` and ``pieces`` are the paths of the vocabularies on every machine.
    """
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(byte_level, pieces)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts], np.int64)
            chunk = (np.cumsum(sizes) - sizes) // chunk_bytes
            for first, last in _runs(chunk):
                columns = align_batch(texts.slice(first, last - first).to_pylist(), a, b)
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, *columns.values()], names=["doc_id", *columns])

    return docs.mapInArrow(
        aligned, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                 "a_ids array<int>, b_ids array<int>, times array<int>")


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(numbers)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)])) if len(numbers) else []


def pair_counts(aligned: DataFrame, partial_pairs: int = _PARTIAL_PAIRS) -> DataFrame:
    """How many documents hold each linked pair: a, b, documents, is_best (none of its a is held by more)."""
    import pyarrow as pa

    def summed(table: pa.Table) -> pa.Table:
        return table.group_by(["a", "b"], use_threads=False).aggregate([("documents", "sum")]).rename_columns(
            ["a", "b", "documents"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            a, b = batch.column("a_ids").flatten(), batch.column("b_ids").flatten()
            new = summed(pa.table({"a": a, "b": b, "documents": np.ones(len(a), np.int64)}))
            held = new if held is None else summed(pa.concat_tables([held, new]))
            if held.num_rows > partial_pairs:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    merged = aligned.select("a_ids", "b_ids").mapInArrow(partial, "a int, b int, documents bigint").groupBy("a", "b").agg(
        F.sum("documents").alias("documents"))
    # Rows of one a are at most as many as B has ids.
    best = F.max("documents").over(Window.partitionBy("a"))
    return merged.withColumn("is_best", F.col("documents") == best)


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The least number of documents for which at most ``most`` pairs are in as many or more."""
    level = F.floor(F.log2("documents") * 8).cast("int")  # at most 8 x 63 levels
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("documents").alias("least")).collect()
    least, held = 2**63 - 1, 0
    for row in sorted(rows, key=lambda r: -r.level):
        held += row.n
        if held > most:
            break
        least = row.least
    return least


def link_statistics(aligned: DataFrame, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """The documents with n_best (links whose pair no other of its a exceeds) and count_sum (counts over links).

    The other columns stay but for the pairs.  ``aligned`` is computed once and written.
    """
    import pyarrow as pa

    rows = written(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    least = _least_frequent(counts, frequent_pairs)
    frequent = counts.where(F.col("documents") >= least).toArrow()  # bounded by frequent_pairs
    keys = frequent["a"].to_numpy().astype(np.int64) << 32 | frequent["b"].to_numpy()
    order = np.argsort(keys)
    keys, held = keys[order], frequent["documents"].to_numpy()[order]
    best = frequent["is_best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy() for c in ("a_ids", "b_ids", "times"))
            sizes = batch.column("a_ids").value_lengths().to_numpy()
            wanted = a.astype(np.int64) << 32 | b
            place = np.searchsorted(keys, wanted)
            known = np.zeros(len(wanted), bool)
            if len(keys):
                place = np.minimum(place, len(keys) - 1)
                known = keys[place] == wanted
            edges = np.concatenate([[0], np.cumsum(sizes)])

            def by_row(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values)])
                return sums[edges[1:]] - sums[edges[:-1]]

            found = np.where(known, times, 0).astype(np.int64)
            sums = [by_row(found * (v[place] if len(keys) else 0)) for v in (best, held)]
            rare = by_row((~known).astype(np.int64))
            starts = np.concatenate([[0], np.cumsum(rare)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *map(pa.array, sums),
                 *[pa.ListArray.from_arrays(starts, x[~known]) for x in (a, b, times)]],
                names=["row", "n_best", "count_sum", "a_ids", "b_ids", "times"])

    split = written(rows.select("row", "a_ids", "b_ids", "times").mapInArrow(
        looked_up, "row bigint, n_best bigint, count_sum bigint, a_ids array<int>, b_ids array<int>, times array<int>"),
        "links-of-rare-pairs")
    links = split.where(F.size("a_ids") > 0).select(
        "row", F.inline(F.arrays_zip(F.col("a_ids").alias("a"), F.col("b_ids").alias("b"), F.col("times").alias("times"))))
    rare = links.join(counts.where(F.col("documents") < least), ["a", "b"]).select(
        "row", F.when(F.col("is_best"), F.col("times")).otherwise(0).cast("bigint").alias("n_best"),
        (F.col("times") * F.col("documents")).alias("count_sum"))
    sums = split.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("a_ids", "b_ids", "times").join(sums, "row").drop("row")
