"""Embeddings: normalisation, KMeans, silhouette, representatives, distributions, projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import safe_divide
from ..functions.vectors import distance, norm, unit
from ..sources import writers


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Unit vectors as doubles; a zero vector fails the query."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return df.withColumn(vector, v).withColumn(vector, F.when(norm(F.col(vector)) == 0, F.raise_error(F.lit("zero vector")).cast("array<double>")).otherwise(unit(F.col(vector))))


def lloyd(made: DataFrame, starts: list[np.ndarray], most: int = 50, tol: float = 1e-4) -> tuple[list[np.ndarray], list[float]]:
    """Centres of several KMeans models and their costs, as Spark ML's KMeans makes them from those starts: all models move in one pass over the blocks.

    A model rests once none of its centres moves by more than tol; its cost is that of the last pass, before the centres moved.
    """
    centres, costs, moving = [np.asarray(c, float) for c in starts], [0.0] * len(starts), list(range(len(starts)))
    for _ in range(most):
        if not moving:
            break
        now = [centres[m] for m in moving]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every, first = np.vstack(now), np.cumsum([0, *map(len, now)])  # noqa: B023  run within this pass
            square = (every * every).sum(1)
            sums, sizes, cost = np.zeros_like(every), np.zeros(len(every)), np.zeros(len(first) - 1)
            for b in batches:
                for x in b.column("vectors"):
                    v = np.frombuffer(x.as_buffer()).reshape(-1, every.shape[1])
                    near, member = square - 2 * v @ every.T, np.zeros((len(v), len(every)))
                    for m, (i, j) in enumerate(zip(first[:-1], first[1:], strict=True)):
                        at = near[:, i:j].argmin(1)
                        member[np.arange(len(v)), i + at] = 1
                        cost[m] += near[np.arange(len(v)), i + at].sum() + (v * v).sum()
                    sums += member.T @ v
                    sizes += member.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sums, sizes, cost)], ["sums", "sizes", "cost"])

        rows = made.select("vectors").mapInArrow(run, "sums binary, sizes binary, cost binary").collect()  # one row for each task
        sums, sizes, cost = (sum(np.frombuffer(r[c]) for r in rows) for c in ("sums", "sizes", "cost"))
        sums, at, still = sums.reshape(len(sizes), -1), 0, []
        for m, old, own in zip(moving, now, cost, strict=True):
            n, s = sizes[at : at + len(old), None], sums[at : at + len(old)]
            centres[m], costs[m], at = np.where(n > 0, s / np.maximum(n, 1), old), float(own), at + len(old)
            if (((centres[m] - old) ** 2).sum(1) > tol * tol).any():
                still.append(m)
        moving = still
    return centres, costs


def nearest(df: DataFrame, models: dict[int, np.ndarray], key: str, vector: str) -> DataFrame:
    """k, key, prediction: the number of the nearest centre in each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for k, c in models.items():
                at = ((c * c).sum(1) - 2 * v @ c.T).argmin(1) if b.num_rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, k, np.int32)), b.column(key), pa.array(at.astype(np.int32))], ["k", key, "prediction"])

    rows = df.select(key, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    return rows.mapInArrow(run, StructType([StructField("k", IntegerType()), rows.schema[key], StructField("prediction", IntegerType())]))


def kmeans(df: DataFrame, ks: tuple[int, ...] = (3, 4, 5), seeds: int = 20, seed: int = 42, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(k, key, cluster) of the cheapest of several runs for each k; clusters are numbered by their smallest key.

    Each run has the start that Spark ML's KMeans takes for its seed; all runs move together.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(key, array_to_vector(vector).alias("features")).persist()  # read by each start; released below
    runs = [(k, KMeans(k=k, seed=seed + i, maxIter=0).fit(data).clusterCenters()) for k in ks for i in range(seeds)]
    made = blocks(data.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("c"), vector_to_array("features").alias("v")), 4096)
    data.unpersist()
    centres, costs = lloyd(made, [c for _, c in runs])
    best = {k: centres[min((cost, m) for m, (cost, (of, _)) in enumerate(zip(costs, runs, strict=True)) if of == k)[1]] for k in ks}
    got = writers.stored(nearest(df, best, key, vector))
    order = got.groupBy("k", "prediction").agg(F.min(key).alias("_least")).withColumn("cluster", F.row_number().over(Window.partitionBy("k").orderBy("_least")) - 1)
    return got.join(F.broadcast(order), ["k", "prediction"]).select("k", key, "cluster")  # k rows


def assignments(long: DataFrame, ks: tuple[int, ...], key: str = "vec_id") -> DataFrame:
    """One column cluster_k<k> for each k."""
    wide = long.groupBy(key).pivot("k", list(ks)).agg(F.first("cluster"))
    return wide.select(key, *[F.col(str(k)).alias(f"cluster_k{k}") for k in ks])


def sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("size"))


def centroids(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise means, in element order."""
    long = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def representatives(df: DataFrame, cluster: str, key: str, n: int = 5, vector: str = "embedding") -> DataFrame:
    """The n members nearest to each centroid; ties by key."""
    v = F.transform(vector, lambda x: x.cast("double"))
    away = df.join(centroids(df, [cluster], vector), cluster).withColumn("distance_to_centroid", distance(v, F.col("centroid")))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.round("distance_to_centroid", 9), key))
    return away.withColumn("rank", rank).filter(F.col("rank") <= n).select(cluster, "rank", key, "distance_to_centroid")


def distribution(df: DataFrame, cluster: str, dimension: str) -> DataFrame:
    """Observed pairs with their share within the cluster."""
    out = df.groupBy(cluster, dimension).agg(F.count("*").alias("chunk_count"))
    return out.withColumn("proportion_within_cluster", safe_divide(F.col("chunk_count"), F.sum("chunk_count").over(Window.partitionBy(cluster))))


def crosstab(df: DataFrame, cluster: str, dimension: str, values: list) -> DataFrame:
    return df.groupBy(cluster).pivot(dimension, values).agg(F.count(F.lit(1))).na.fill(0)


def blocks(points: DataFrame, size: int) -> DataFrame:
    """id, c, v as rows of at most size points, sorted by c within: block, ids, labels and vectors in bytes. Stored, as they are read many times."""

    def row(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by("c")
        raw = [t.column(c).combine_chunks() for c in ("id", "c", "v")]
        raw[2] = raw[2].flatten()
        return pa.RecordBatch.from_arrays([pa.array([x.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for x in raw], ["ids", "labels", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= size:
                t = pa.Table.from_batches(held)
                yield row(t.slice(0, size))
                held, rows = t.slice(size).to_batches(), rows - size
        if rows:
            yield row(pa.Table.from_batches(held))

    return writers.stored(points.mapInArrow(run, "ids binary, labels binary, vectors binary").withColumn("block", F.monotonically_increasing_id()))


def distance_sums(points: DataFrame, block: int, resident: int, parts: int) -> DataFrame:
    """id, c, other, total: sums of the distances from a point to those of each label, in one row or a few.

    A task holds a share of the blocks, at most `resident` bytes, and meets them with its own blocks one by one;
    they are read from where they are stored, so nothing is shuffled by pairs.
    """
    made = blocks(points, block)
    n, size = made.agg(F.count("*"), F.coalesce(F.sum(F.length("vectors")), F.lit(0))).first()
    left = made.repartition(max(1, min(n, parts)))
    right = made.select(*[F.col(c).alias(f"o_{c}") for c in ("ids", "labels", "vectors")]).coalesce(max(1, -(-size // resident)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, ids, labels, a, total = None, None, None, None, {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for other, sums in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(np.full(len(ids), other)), pa.array(sums)], ["id", "c", "other", "total"])
            total.clear()

        for b in batches:
            for k in range(b.num_rows):
                at = lambda c: b.column(c)[k].as_buffer()  # noqa: B023, E731
                if (number := b.column("block")[k].as_py()) != mine:
                    yield from flushed()
                    mine, ids, labels = number, np.frombuffer(at("ids"), np.int64).copy(), np.frombuffer(at("labels"), np.int64).copy()
                    a = np.frombuffer(at("vectors")).reshape(len(ids), -1)
                    a = np.hstack([-2 * a, (a * a).sum(1)[:, None], np.ones((len(a), 1))])
                others, own = np.frombuffer(at("o_ids"), np.int64), np.frombuffer(at("o_labels"), np.int64)
                v = np.frombuffer(at("o_vectors")).reshape(len(others), -1)
                d = a @ np.hstack([v, np.ones((len(v), 1)), (v * v).sum(1)[:, None]]).T
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if (same := np.flatnonzero(np.isin(ids, others))).size:
                    d[same] = np.where(ids[same][:, None] == others[None, :], 0, d[same])
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                for other, sums in zip(own[starts].tolist(), np.add.reduceat(d, starts, axis=1).T, strict=True):
                    total[other] = total[other] + sums if other in total else sums.copy()
                if len(total) * len(ids) > 1 << 22:  # so many labels leave in several rows
                    yield from flushed()
        yield from flushed()

    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, "id long, c long, other long, total double")


def silhouette(df: DataFrame, cluster: str, key: str, vector: str = "embedding", block: int = 4096, resident: int = 64 << 20) -> DataFrame:
    """Mean Euclidean silhouette over all points, exact and so quadratic in time: blocks of points meet block by block in numpy. Shuffled are the points, once, and their sums by cluster, once for each share of resident bytes.

    At scale use ClusteringEvaluator, whose squared variant needs the centroids only.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    points = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(cluster).cast("long").alias("c"), v.alias("v"))
    session = df.sparkSession
    parts = 4 * max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    total = distance_sums(points.filter("c IS NOT NULL AND v IS NOT NULL"), block, resident, parts).groupBy("id", "c", "other").agg(F.sum("total").alias("total"))
    n = points.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("n"))
    own = F.col("c") == F.col("other")
    mean = total.join(n, "other").withColumn("mean", F.when(own, safe_divide(F.col("total"), F.col("n") - 1)).otherwise(F.col("total") / F.col("n")))
    s = mean.groupBy("id", "c").agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    return s.agg(F.avg(F.when(F.col("n") == 1, 0.0).otherwise(safe_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))).alias("silhouette"))


def metrics(df: DataFrame, cluster: str, key: str, vector: str = "embedding") -> DataFrame:
    """silhouette, minimum and maximum cluster size; one row."""
    n = sizes(df, [cluster]).agg(F.min("size").alias("minimum_cluster_size"), F.max("size").alias("maximum_cluster_size"))
    return silhouette(df, cluster, key, vector).crossJoin(n)  # one row each


def projection(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """First two principal components of centred vectors; each component's largest loading is made positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(data).transform(data)
    model = PCA(k=2, inputCol="centred", outputCol="pc").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[np.abs(axes[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    pc = vector_to_array("pc")
    return model.transform(centred).select(key, *[(pc[k] * signs[k]).alias(f"pc{k + 1}") for k in range(2)])


def projected_centroids(df: DataFrame, cluster: str, axes: tuple[str, str] = ("pc1", "pc2")) -> DataFrame:
    """Where a cluster's label stands in a scatter plot: the mean of its points."""
    return df.groupBy(cluster).agg(*[F.avg(a).alias(a) for a in axes], F.count("*").alias("size"))


def encoded(df: DataFrame, encode, text: str = "text", size: int = 16) -> DataFrame:
    """Adds embedding by encode(list of texts) -> matrix, size rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [x for k in range(0, len(f), size) for x in np.asarray(encode(f[text].iloc[k : k + size].to_list()), float).tolist()]
            yield f.assign(embedding=rows)

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", embedding array<double>")
