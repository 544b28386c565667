"""k-means, two-stage Ward and the quality gate of the ensemble."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import NOISE
from profilekit.functions.vector import to_matrix
from profilekit.operators.features_tree import clustering_features, nearest_feature

MICRO_CLUSTERS = 1000
#: Ward keeps a matrix of so many features squared on the driver.
MOST_FEATURES = 4096


def _with_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(vector)))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, max_iter: int = 500, out: str = "label") -> tuple[DataFrame, float]:
    """Labelled rows and the inertia."""
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol=out).fit(_with_vector(df, vector))
    return model.transform(_with_vector(df, vector)).drop("_v"), float(model.summary.trainingCost)


def bisecting(df: DataFrame, vector: str, k: int, seed: int = 42, out: str = "label") -> DataFrame:
    """Divisive hierarchical labels."""
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(_with_vector(df, vector))
    return model.transform(_with_vector(df, vector)).drop("_v")


def lloyd_step(df: DataFrame, vector: str, label: str) -> DataFrame:
    """New centres from given labels: ``(label, size, centre)``."""
    return (
        _with_vector(df, vector).groupBy(label)
        .agg(F.count(F.lit(1)).alias("size"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("centre"))
    )


def ward_merges(sizes: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Ward linkage on weighted summaries until ``k`` groups remain; labels by first member.

    The merge cost needs only sizes and centres:
    ``|A||B| / (|A|+|B|) * distance(centre A, centre B)^2``.
    """
    n = len(sizes)
    size, centre = sizes.astype(float).copy(), centres.astype(float).copy()
    square = (centre ** 2).sum(axis=1)
    gaps = np.maximum(square[:, None] + square[None, :] - 2 * centre @ centre.T, 0.0)
    cost = gaps * (size[:, None] * size[None, :]) / (size[:, None] + size[None, :])
    np.fill_diagonal(cost, np.inf)
    owner, alive = np.arange(n), np.ones(n, dtype=bool)
    for _ in range(max(n - k, 0)):
        a, b = sorted(divmod(int(cost.argmin()), n))
        total = size[a] + size[b]
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / total
        size[a] = total
        alive[b] = False
        owner[owner == b] = a
        gap = ((centre - centre[a]) ** 2).sum(axis=1)
        row = np.where(alive, gap * size * total / (size + total), np.inf)
        row[a] = np.inf
        cost[a, :] = cost[:, a] = row
        cost[b, :] = cost[:, b] = np.inf
    return np.unique(owner, return_inverse=True)[1]


def ward(df: DataFrame, vector: str, k: int, micro: int = MICRO_CLUSTERS, seed: int = 42, out: str = "label") -> DataFrame:
    """Hierarchical Ward labels for any number of rows.

    Spark reduces the rows to at most ``micro`` clustering features; the merges run on their counts and means, and every
    row gets the label of the nearest mean. With no more different rows than ``micro`` this is Ward on the rows themselves.
    ``seed`` is not used any more: nothing here is random.
    """
    if not k <= micro <= MOST_FEATURES:
        raise ValueError(f"micro must lie between k and {MOST_FEATURES}")
    found = clustering_features(df, vector, micro).orderBy("total", "n").toArrow()
    if not found.num_rows:
        return df.withColumn(out, F.lit(None).cast("int"))
    size = found.column("n").to_numpy()
    centre = to_matrix(found.column("total")) / size[:, None]
    shared = df.sparkSession.sparkContext.broadcast((centre, ward_merges(size, centre, k).astype(np.int32)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, labels = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                near = nearest_feature(to_matrix(part.column(vector)), centres)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels[near])], [*part.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(label, f"{ddl}, `{out}` int")


def passes_gate(df: DataFrame, label: str, min_clusters: int = 2, max_noise: float = 0.50) -> bool:
    """A density result joins the ensemble only with enough clusters and little noise."""
    row = gate_report(df, label, min_clusters, max_noise).first()
    return bool(row["accepted"])


def gate_report(df: DataFrame, label: str, min_clusters: int = 2, max_noise: float = 0.50) -> DataFrame:
    noise = F.col(label) == NOISE
    return df.agg(
        F.countDistinct(F.when(~noise, F.col(label))).alias("n_clusters"),
        F.avg(noise.cast("double")).alias("noise_share"),
    ).withColumn("accepted", (F.col("n_clusters") >= min_clusters) & (F.col("noise_share") < max_noise))
