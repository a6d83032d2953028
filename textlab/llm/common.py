"""Helpers shared by the operators: tables, shared scratch folder, Arrow batch size."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch; texts can be long, so far fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null doc_id inside the operators: pandas would turn the long ids of a batch with a null into doubles.
NO_ID = -(1 << 63)


def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id (null: NO_ID) and text (null: empty), with further columns."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def own_ids(df: DataFrame) -> DataFrame:
    """The ids of texts() as they were."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def veiled(docs: DataFrame) -> dict[str, str]:
    """Names for all columns but doc_id and text that clash with none of an operator's."""
    return {c: f"kept_{k}_" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}


def quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def unveiled(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from those of df; n_chars follows the text."""
    names = veiled(docs)
    out = {c: F.col(names.get(c, c)) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[x.alias(c) for c, x in out.items()])


def mapped(df: DataFrame, compute: Callable, read: tuple[str, ...], new: str, keep: tuple[str, ...]) -> DataFrame:
    """New columns from those read, beside kept ones, which no conversion touches.

    compute takes the columns read as lists and gives the numbers of the rows that stay (None: all) and the new values of each.
    """
    own = StructType.fromDDL(new)
    fields = to_arrow_schema(own)
    schema = StructType([*own.fields, *[df.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = compute(*[b.column(c).to_pylist() for c in read])
            kept = [b.column(c) if at is None else b.column(c).take(pa.array(at, pa.int64())) for c in keep]
            columns = zip(*values, strict=True) if values else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*[pa.array(list(v), f.type) for v, f in zip(columns, fields, strict=True)], *kept], schema.names)

    return df.select(*dict.fromkeys([*read, *keep])).mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the user has set a size."""
    for key, default, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(own))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark runs in this process (tests), one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textlab-")
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Folders that this driver has written and not dropped.
_written: list[str] = []


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"textlab-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if not _written:
        atexit.unregister(_drop_all)
        atexit.register(_drop_all, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    return list(_written)


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of stored() once all results that read them are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(p)


def _drop_all(spark: SparkSession) -> None:
    """At the driver's end nothing reads its folders any more."""
    try:
        drop_stored(spark, written())
    except Exception:  # noqa: BLE001  the JVM can be gone
        _written.clear()


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, stored, without the tables that it stored on its way."""
    before = set(_written)
    out = stored(make())
    drop_stored(spark, [p for p in _written[:-1] if p not in before])
    return out


def crc32_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Bits:
    """A set of longs as a bitmap of 2**bits places at most, by their low bits: what was put in is always found, other values sometimes.

    A place in 64 is taken as long as that needs no more places, so a small set sends little. The size
    is bounded whatever the number of values, so it can be broadcast; a false hit only
    costs work in the exact step that follows.
    """

    def __init__(self, values: DataFrame, column: str, bits: int = 26):
        values = values.select(column)
        block = 15  # bits of a place within its block: a block has 32,768 places
        bits = max(block, min(bits, (64 * values.count()).bit_length()))
        self.mask = (1 << bits) - 1
        places = values.select((F.col(column).bitwiseAND(self.mask)).cast("int").alias("at")).distinct()

        def fill(f: pd.DataFrame) -> pd.DataFrame:
            own = np.zeros(1 << block, np.uint8)
            own[f["at"].to_numpy() & ((1 << block) - 1)] = 1
            return pd.DataFrame({"block": [f["at"].iloc[0] >> block], "bits": [np.packbits(own, bitorder="little").tobytes()]})

        whole = np.zeros(1 << (bits - 3), np.uint8)
        size = 1 << (block - 3)
        for r in places.groupBy(F.shiftright("at", block).alias("b")).applyInPandas(fill, "block int, bits binary").collect():
            whole[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        self.any = bool(whole.any())
        self._sent = values.sparkSession.sparkContext.broadcast(whole)

    def drop(self) -> None:
        """Once what needed it is stored."""
        self._sent.destroy()

    def __getstate__(self) -> dict:
        return self.__dict__.copy()

    def has(self, values: np.ndarray) -> np.ndarray:
        at = (values.astype(np.int64) & self.mask).astype(np.int64)
        return (self._sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (a, b): root is the component's smallest node.

    Labels spread by the smallest neighbour and by jumping to the label's own label; each round
    is written to the shared folder.
    """
    both = stored(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        near = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        moved = stored(near.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("to"), "root"))
        labels = moved.select("node", F.col("to").alias("root"))
        if moved.filter("to <> root").isEmpty():
            return labels
