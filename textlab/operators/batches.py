"""Fixed-size annotation batches, templates and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["chunk_id", "doc_id", "type", "period", "text"]


def numbered(df: DataFrame, key: str) -> DataFrame:
    """row from 1 in key order: ranges are counted, so no task sees all rows."""
    ranged = df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()).persist()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_offset")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.join(offset, "_part").withColumn("row", F.col("_offset") + rank).drop("_part", "_offset")


def batches(df: DataFrame, key: str, size: int = 15) -> DataFrame:
    return numbered(df, key).withColumn("batch_id", F.floor((F.col("row") - 1) / size) + 1)


def template(df: DataFrame, ids: list[str], labels: list[str]) -> DataFrame:
    return df.select(*ids, *[F.lit("").alias(c) for c in labels])


def write_batches(df: DataFrame, path: str) -> None:
    """One folder of JSON lines for each batch; earlier ones are replaced."""
    df.write.mode("overwrite").partitionBy("batch_id").json(path)


def round_trip_errors(written: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """Keys lost, added or repeated, and blank texts."""
    from . import validate

    out = validate.missing_keys(written, read, key, "lost").unionByName(validate.missing_keys(read, written, key, "added"))
    return out.unionByName(validate.duplicates(read, key)).unionByName(validate.empty_text(read, key))


def batch_errors(written: DataFrame, read: DataFrame, key: str, size: int = 15, columns: list[str] = COLUMNS) -> DataFrame:
    """round_trip_errors(), and rows in another place, batches over their size and a wrong set of columns. Both: row, batch_id, key."""
    out = round_trip_errors(written, read, key)
    moved = read.select(key, F.col("row").alias("_row")).join(written.select(key, "row"), key).filter("row <> _row")
    full = read.groupBy("batch_id").agg(F.count("*").alias("n")).filter(F.col("n") > size)
    out = out.unionByName(moved.select(F.lit("moved").alias("error"), F.col(key).cast("string").alias("key")))
    out = out.unionByName(full.select(F.lit("batch too large").alias("error"), F.col("batch_id").cast("string").alias("key")))
    if odd := sorted(set(columns) ^ (set(read.columns) - {"row", "batch_id"})):
        out = out.unionByName(read.sparkSession.createDataFrame([("wrong columns", ", ".join(odd))], "error string, key string"))
    return out


def note(title: str, lists: dict[str, list[str]]) -> str:
    """An analysis note: a heading and a bullet list for each name."""
    return "\n".join([f"# {title}", *[line for name, items in lists.items() for line in ("", f"## {name}", "", *[f"- {x}" for x in items])], ""])


def console(title: str, df: DataFrame, order: list[str], limit: int = 20) -> str:
    """A summary for the console: a title, the number of rows and the first of them."""
    return f"{title}: {df.count()} rows\n{markdown(df, order, limit)}"


def run_optional(tasks: dict[str, Callable[[], object]]) -> tuple[dict[str, object], list[str]]:
    """Runs tasks one by one: those without their input are named in warnings, and none produced at all is an error."""
    done, warnings = {}, []
    for name, task in tasks.items():
        try:
            done[name] = task()
        except (FileNotFoundError, AnalysisException) as e:
            warnings.append(f"{name} skipped: {str(e).splitlines()[0]}")
    if not done:
        raise ValueError("no task could run: " + "; ".join(warnings))
    return done, warnings


def cell(x: Column, kind: str) -> Column:
    """A table cell: three decimals, no line ends, bars escaped."""
    if kind in ("double", "float"):
        return F.format_string("%.3f", x)
    return F.replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def markdown(df: DataFrame, order: list[str], limit: int = 100) -> str:
    """A small report table of the first rows; it is built on the driver."""
    rows = df.orderBy(*order).limit(limit).select(*[cell(F.col(c), t).alias(c) for c, t in df.dtypes]).collect()
    if not rows:
        return "_No rows._"
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(list(r)) for r in rows]])


def prompt(labels: dict[str, tuple[str, ...]], task: str) -> str:
    """Instructions for annotators, from the taxonomy."""
    return "\n".join([task, "", *[f"{f}: one of {', '.join(v)}" for f, v in labels.items()], "evidence: a short passage, copied from the text"])
