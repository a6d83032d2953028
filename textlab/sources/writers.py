"""Writers: result tables as Parquet or CSV, texts, batches (see operators.batches)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; where it is unset and Spark runs in this process (tests), of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textlab-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/textlab-{uuid.uuid4().hex}"


def table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def texts(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """One folder of text for each key; never into the folder it was read from."""
    if path.rstrip("/") in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        raise ValueError("the target is the source")
    df.select(key, text).write.mode("overwrite").partitionBy(key).text(path)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what is read twice is computed once."""
    path = shared(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
