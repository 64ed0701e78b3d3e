"""What the operators of this package share: reading a table and writing an intermediate one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runs of these characters separate words and count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset the
    session may name one in ``quorumbook.shared.dir``; there is no default, as a
    folder of one machine would be invisible to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quorumbook.shared.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/quorumbook-llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back, so that lineage ends here."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
