"""Tables written once and read back, to cut lineage or to share one computation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "quorumbook"


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset a session may name one in ``quorumbook.shared.dir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quorumbook.shared.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{_FOLDER}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
