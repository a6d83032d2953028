"""Readers: pages and texts by folder, metadata, stop words, chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.validate import ValidationError, require_columns

CHUNK_COLUMNS = ["chunk_id", "doc_id", "date", "period", "type", "speaker", "title", "section_title"]
CHUNKS = StructType([*(StructField(c, StringType()) for c in CHUNK_COLUMNS), StructField("char_count", IntegerType()), StructField("text", StringType())])


def text_files(spark: SparkSession, folder: str, pattern: str, needed: bool = True) -> DataFrame:
    """path, name, text, error of the files that match; text that isn't UTF-8 gives an error and null text."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    out = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.when(valid, F.col("content").cast("string")).alias("text"), F.when(~valid, "not UTF-8").alias("error"))
    if needed and out.isEmpty():
        raise ValidationError(f"no {pattern} in {folder}")
    return out


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    return text_files(spark, folder, "*.html", needed=False).withColumnRenamed("text", "html")


def cleaned_files(spark: SparkSession, folder: str) -> DataFrame:
    return text_files(spark, folder, "*_clean.txt")


def csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """All columns as strings, empty ones as empty strings; quoted line ends are kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return require_columns(df, required).na.fill("")


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def terms(spark: SparkSession, path: str, protected: frozenset[str] = frozenset()) -> DataFrame:
    """Stop words: trimmed lines without comments; a protected one is an error."""
    out = spark.read.text(path).select(F.trim("value").alias("term")).filter("term <> '' AND NOT term LIKE '#%'").distinct()
    if protected and (bad := [r[0] for r in out.filter(F.col("term").isin(*protected)).collect()]):
        raise ValidationError(f"protected stop words: {', '.join(sorted(bad))}")
    return out


def raw_labels(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of label records."""
    return spark.read.option("multiLine", True).json(path)
