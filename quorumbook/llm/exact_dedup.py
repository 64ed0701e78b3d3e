"""Exact deduplication by a 128-bit content hash with a comparison of the bytes.

Texts are equal when they agree after every run of white space becomes one
space; a null text counts as empty.  Rows are grouped by (hash, bytes), so a
group never mixes texts that merely share a hash.  Copies meet in the map-side
combine already: however large a group is, each input task sends one row of it.

Defined results: without an id a row yields to any row with one; rows that
repeat the smallest id of a group are all marked as kept, as they are one document
by id, and ``drop_copies`` keeps one of them; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumbook.llm.tables import SPACES, written


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _decided(docs: DataFrame, id_col: str, text_col: str, carried: list[Column], hash_of) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, hash, sha256 and the carried columns."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm"), *carried)
    hashed = hashed.withColumn("hash", hash_of(F.col("norm")))
    groups = hashed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A hash with one text needs no bytes to find its rows again; only rows of colliding hashes travel with their text.
    by_hash = written(groups.groupBy("hash").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    ), "exact-groups")
    rows = hashed.withColumn("sha256", F.sha2(F.col("norm").cast("binary"), 256))
    plain = rows.drop("norm").join(by_hash.where("texts = 1").drop("texts"), "hash")
    shared = by_hash.where("texts > 1").select("hash")
    if shared.isEmpty():
        return plain
    colliding = rows.join(shared, "hash", "left_semi").join(groups, ["hash", "norm"])
    return plain.unionByName(colliding.drop("norm"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, id_col, text_col, [], hash_of).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: one of those that bear the smallest id."""
    decided = _decided(docs, id_col, text_col, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")], content_hash)
    return decided.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["hash", "sha256"]).select("row.*")
