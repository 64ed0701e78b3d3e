"""Reading, appending and following ledger tables kept as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumbook.plans.workspace import materialize


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_accepted(classified: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Append the accepted commands to a table and return those rows.

    The commands are judged once; what is appended and what is returned are read from that one result.
    """
    accepted = materialize(classified.where(F.col("outcome") == "accepted").select(*columns), "accepted")
    accepted.write.mode("append").parquet(path)
    return accepted


def follow_table(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Change feed of an append-only table: new files become new micro-batch rows."""
    reader = spark.readStream.format("parquet").schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def inline_players(spark: SparkSession, names: list[str]) -> DataFrame:
    """Players given as literal names, numbered in the order given."""
    rows = [(i + 1, name, True) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "id bigint, display_name string, is_active boolean")


def with_default(df: DataFrame, column: str, default) -> DataFrame:
    """Add a column when it is missing and fill its nulls with the default."""
    value = F.lit(default) if not hasattr(default, "isNull") else default
    if column not in df.columns:
        return df.withColumn(column, value)
    return df.withColumn(column, F.coalesce(F.col(column), value))
