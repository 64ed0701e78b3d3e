"""Power-of-two packing: every sequence is one binary-length piece of one document.

The token count of a document is split as in its binary form, whole sequences of
the greatest length first and then smaller powers of two.  Pieces of equal length
form a bucket, in which sequences are numbered; a batch drawn from one bucket has
no padding and no sequence that crosses documents.

Splitting needs no shuffle.  Numbering sorts narrow rows inside hashed pieces of
each bucket and adds up the sizes of the pieces only.

Strings of special tokens in a text are ordinary text, as the vocabulary's own notes set the tokenizer
(``encode_special_tokens``).

Defined results: a null text is empty and has the end token alone; repeated ids
are separate documents in the numbering; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumbook.llm.wordcache import WordEncoder

MAX_TOKENS = 4096
END_ID = 2
ROWS_PER_PIECE = 50_000
_PARTS_PER_BLOCK = 1024


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """Lengths that add up to ``tokens``: the longest as often as it fits, then each lower power of two at most once."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def binary_pieces(
    docs: DataFrame, tokenizer: str, longest: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id",
    text_col: str = "text", kept: Sequence[str] = (),
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit integers), ``kept``."""
    import pyarrow as pa

    if longest & (longest - 1):
        raise ValueError("the greatest length must be a power of two")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    end = end_id.to_bytes(4, "little")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            row, start, length, total, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                body = encoder.encode(text.as_py() or "") + end
                at = 0
                for n in binary_lengths(len(body) // 4, longest):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    total.append(len(body) // 4)
                    ids.append(body[4 * at:4 * (at + n)])
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()),
                 *[c.take(pa.array(row, pa.int64())) for c in batch.columns[2:]]],
                names=["doc_id", "start", "length", "doc_tokens", "ids", *kept],
            )

    return docs.mapInArrow(split, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary{more}")


def numbered_sequences(pieces: DataFrame, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Add sequence_id and offset: longer buckets first, without gaps, one piece at offset 0 of its sequence.

    ``pieces`` is read twice and should be a written table.
    """
    parts = max(1, -(-pieces.count() // rows_per_piece))
    cut = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    sizes = cut.groupBy("length", "_part").agg(F.count("*").alias("_size")).withColumn(
        "_block", F.floor(F.col("_part") / _PARTS_PER_BLOCK))
    # Two levels of sums: over the blocks of parts, and over the parts of each block.
    blocks = sizes.groupBy("length", "_block").agg(F.sum("_size").alias("_rows"))
    earlier = Window.orderBy(F.desc("length"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    before = Window.partitionBy("length", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(blocks, ["length", "_block"]).select(
        "length", "_part", (F.col("_first") + F.coalesce(F.sum("_size").over(before), F.lit(0))).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "start")
    return (
        cut.withColumn("_local", F.row_number().over(inside)).join(starts, ["length", "_part"])
        .withColumn("sequence_id", (F.col("_before") + F.col("_local") - 1).cast("bigint"))
        .withColumn("offset", F.lit(0).cast("bigint")).drop("_part", "_local", "_before")
    )
