"""Running a stream over the files that are there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quorumbook.plans.workspace import fresh_path


def drain(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Work off the available input into parquet in the shared folder and read it back.

    A ``root`` that was drained into before goes on from its checkpoint.
    """
    spark = stream.sparkSession
    root = root or fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet").option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
