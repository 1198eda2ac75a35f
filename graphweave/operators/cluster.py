"""Clustering of feature vectors, bags of codes and the k-medoids baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import cut


def distance2(x: Column, y: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b).cast("double") * (a - b)), F.lit(0.0), lambda s, v: s + v)


def kmeans(df: DataFrame, features: str, k: int, seed: int = 1) -> tuple[DataFrame, KMeansModel]:
    """df with the column cluster, and the model."""
    x = df.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(x)
    return model.transform(x).drop("__x"), model


def silhouette(clustered: DataFrame, features: str) -> float:
    """Mean silhouette by squared Euclidean distance."""
    x = clustered.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    return ClusteringEvaluator(featuresCol="__x", predictionCol="cluster").evaluate(x)


def kmeans_sweep(df: DataFrame, features: str, ks: list[int], seed: int = 1) -> DataFrame:
    """(k, cost, silhouette) for several k."""
    rows = []
    for k in ks:
        out, model = kmeans(df, features, k, seed)
        rows.append((k, float(model.summary.trainingCost), float(silhouette(out, features)) if k > 1 else None))
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def cluster_profile(clustered: DataFrame, features: str, top: int = 3) -> DataFrame:
    """(cluster, size, dim, total, place): the top dimensions of each cluster by the sum of their values."""
    size = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = clustered.select("cluster", F.posexplode(features).alias("dim", "v")).groupBy("cluster", "dim").agg(F.sum("v").alias("total"))
    order = Window.partitionBy("cluster").orderBy(F.desc("total"), "dim")
    return sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).join(size, "cluster").select("cluster", "size", "dim", "total", "place")


def truncated_svd(df: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """(key, array) projected on the k leading right singular vectors (not centred), the largest part of each made positive.

    Each task sums the products of its rows to a Gram matrix; their sum, of the size of the dimensions squared, goes to
    the driver, whose eigenvectors are the singular ones. Rows with null features are left out."""
    x = df.select(key, F.col(features).cast("array<double>").alias("x")).where(F.col("x").isNotNull())

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = np.stack(b.column(0).to_numpy(zero_copy_only=False))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total))], names=["i", "row"])

    parts = x.select("x").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    lines = sums.select("i", F.transform("row", lambda c: c["v"]).alias("row")).orderBy("i").collect()  # a line a dimension
    size = len(lines)
    m = np.array([r["row"] for r in lines]).reshape(size, size)
    v = np.linalg.eigh(m)[1][:, ::-1][:, :k] if size else m
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if size else v
    dots = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in v[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p) for j in range(v.shape[1])]
    return x.select(key, F.array(*dots).cast("array<double>").alias("reduced"))


def bag_of_codes(descriptors: DataFrame, key: str, features: str, model: KMeansModel) -> DataFrame:
    """(key, code, share): normalised histogram of the nearest codes of each item's descriptors."""
    x = descriptors.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    coded = model.transform(x).groupBy(key, F.col(model.getPredictionCol()).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return coded.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key))).select(key, "code", "share")


def kmedoids(df: DataFrame, key: str, features: str, k: int, iterations: int = 10) -> DataFrame:
    """(key, medoid, distance): each item's medoid after alternating assignment and update from the first k items by key.

    Distances are Euclidean, ties go to the lower key. The update takes the member of least sum of distances to its cluster. That
    sum is at least the cluster's size times the member's distance from the mean, so members are tried by this distance, block
    after block, until none is left that could win."""
    items = cut(df.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("x")))
    rows = items.orderBy("id").limit(k).collect()  # k rows, as literals: no join with them
    for _ in range(iterations):
        assigned = cut(items.select("id", "x", _nearest(rows)["m"].alias("m")))
        centre = assigned.select("m", F.posexplode("x").alias("i", "v")).groupBy("m", "i").agg(F.avg("v").alias("v")).groupBy("m").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select("m", F.transform("c", lambda s: s["v"]).alias("c"))
        near = assigned.join(F.broadcast(centre), "m").withColumn("d", F.sqrt(distance2(F.col("x"), F.col("c"))))
        near = near.withColumn("p", F.row_number().over(Window.partitionBy("m").orderBy("d", "id"))).withColumn("least", F.col("d") * F.count(F.lit(1)).over(Window.partitionBy("m")))
        found = _least_sums(assigned, cut(near.select("m", F.col("id").alias("o"), F.col("x").alias("ox"), "p", "least")))
        settled = {r["id"] for r in found} == {r["id"] for r in rows}
        rows = found
        if settled:
            break
    if not rows:
        return items.select(F.col("id").alias(key), F.col("id").alias("medoid"), F.lit(0.0).alias("distance"))
    near = _nearest(rows)
    return items.select(F.col("id").alias(key), near["m"].alias("medoid"), F.sqrt(near["d"]).alias("distance"))


def _least_sums(assigned: DataFrame, near: DataFrame) -> list:
    """Rows (id, x): the member of least sum of distances of each cluster m, tried in the order p while the bound least allows it."""
    best, done, size = {}, 0, BLOCK
    while True:
        options = near.where((F.col("p") > done) & (F.col("p") <= done + size))
        if best:
            options = options.where(F.array_max(F.array(*[F.when(F.col("m") == m, F.col("least") <= r["s"] * (1 + 1e-9) + 1e-8).otherwise(F.lit(False)) for m, r in best.items()])))
        sums = assigned.join(F.broadcast(options.select("m", "o", "ox")), "m").groupBy("m", "o").agg(F.round(F.sum(F.sqrt(distance2(F.col("x"), F.col("ox")))), 9).alias("s"), F.first("ox").alias("x"))
        rows = sums.groupBy("m").agg(F.min_by(F.struct(F.col("o").alias("id"), "x", "s"), F.struct("s", "o")).alias("b")).select("m", "b.*").collect()
        if not rows:
            return list(best.values())
        for r in rows:
            if r["m"] not in best or (r["s"], r["id"]) < (best[r["m"]]["s"], best[r["m"]]["id"]):
                best[r["m"]] = r
        done, size = done + size, min(2 * size, MOST)


def _nearest(medoids: list) -> Column:
    """The nearest of a few rows (id, x) to the column x, as a struct (d, m): squared distance, ties to the lower id."""
    points = [F.struct(distance2(F.col("x"), F.array(*[F.lit(float(v)) for v in r["x"]])).alias("d"), F.lit(r["id"]).alias("m")) for r in sorted(medoids, key=lambda r: r["id"])]
    return F.array_min(F.array(*points)) if points else F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).alias("m"))


#: Members of each cluster tried as its medoid at first, and at most at a time.
BLOCK, MOST = 64, 4096


def vectors(df: DataFrame, column: str) -> DataFrame:
    """df with an ML vector column as an array."""
    return df.withColumn(column, vector_to_array(column))
