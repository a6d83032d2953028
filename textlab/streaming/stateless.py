"""Row-local stages on streams, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import clean
from ..plans.config import CleaningRules
from ..sources import writers


def clean_stream(stream: DataFrame, rules: CleaningRules, unify: bool = True, empty_lines: int = 0) -> DataFrame:
    """Cleaning needs no state, so the batch operator runs on a stream as it is."""
    return clean(stream, rules, unify=unify, empty_lines=empty_lines)


def appended(stream: DataFrame) -> DataFrame:
    """All rows of a stateless stream, run to its end; what was written stays if the run is resumed."""
    path = writers.shared(stream.sparkSession)
    run = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/result")
    run.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/result")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped by Spark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def drained(stream: DataFrame) -> DataFrame:
    """The whole result of an aggregated stream, run to its end. State and result lie in the shared folder, not with the driver."""
    spark, path = stream.sparkSession, writers.shared(stream.sparkSession)
    out = spark.createDataFrame([], stream.schema)
    out.write.parquet(f"{path}/result")
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    run.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/result")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/result")
