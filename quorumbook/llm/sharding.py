"""Proportional stratified interleaving: every shard holds the mixture of the sources.

Rows are shuffled inside their source by a seeded hash and ranked; rank r of n
rows becomes the fraction (r - 1/2) / n.  Sorted by that fraction all sources
advance at the same pace, so a cut of the sequence into equal lengths gives
shards whose row counts differ by one at most and whose mixture is that of the
table to within a row per source.

Neither sort meets in one task: hashes and fractions are evenly spread by
construction, so equal ranges of them are pieces of about ``rows_per_piece``
rows, also of a source that holds most of the table, and only the sizes of the
pieces are added up.

Defined results: a null text has size 1 and the checksum of no bytes; a null
source is a source of its own; rows that repeat an id stay separate rows; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PIECE = 50_000
#: Hexadecimal digits of the hash that choose a piece: 52 bits, exact in a double.
_DIGITS = 13


def _numbered(rows: DataFrame, group: list[str], piece: Column, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 1; ``piece`` must grow with ``order``."""
    # Dealt by piece, so that a group with most of the rows is not sorted where the join before gathered it.
    pieces = rows.withColumn("_piece", piece).repartition(*group, "_piece")
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy(*group, "_piece").agg(F.count("*").alias("_size"))
    starts = sizes.select(
        *group, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy(*group, "_piece").orderBy(*order))
    joined = pieces.withColumn("_local", local).join(starts, [*group, "_piece"])
    return joined.withColumn(name, F.col("_before") + F.col("_local")).drop("_piece", "_local", "_before")


def stratified_shards(
    docs: DataFrame, shards: int = 8, seed: str = "mixture", id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("mix"),
    )
    strata = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("stratum"))
    counts = strata.groupBy("stratum").agg(F.count("*").alias("of"))
    all_rows = max(1, docs.count())
    sized = keyed.join(counts, "stratum")
    share = F.conv(F.substring("mix", 1, _DIGITS), 16, 10).cast("double") / float(16 ** _DIGITS)
    ranked = _numbered(
        sized, ["stratum"], F.floor(share * F.ceil(F.col("of") / rows_per_piece)),
        ["mix", "doc_id", "text_crc32", "size"], "rank",
    )
    spread = ranked.withColumn("fraction", (F.col("rank") - F.lit(0.5)) / F.col("of"))
    placed = _numbered(
        spread, [], F.floor(F.col("fraction") * -(-all_rows // rows_per_piece)),
        ["fraction", "stratum", "rank"], "place",
    )
    shard = F.expr(f"(place - 1) * {shards} div {all_rows}")
    first = F.expr(f"(shard * {all_rows} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - 1 - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
