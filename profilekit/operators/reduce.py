"""Principal components and the 2-D map."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from profilekit.functions.vector import from_matrix, to_matrix
from profilekit.operators.scale import vector_moments


@dataclass(frozen=True)
class Components:
    """Means, loadings (dimension x kept) and explained share per kept component."""

    mean: np.ndarray
    loadings: np.ndarray
    explained: np.ndarray

    @property
    def kept(self) -> int:
        return self.loadings.shape[1]


def fit_components(df: DataFrame, vector: str, variance: float = 0.90) -> Components:
    """The fewest components whose explained variance adds up to more than ``variance``.

    The covariance is accumulated by Spark; only the dimension x dimension result
    reaches the driver. Signs are fixed so that each component's largest loading
    is positive.
    """
    dimension = df.select(F.size(vector)).first()[0]
    model = PCA(k=dimension, inputCol="v", outputCol="p").fit(df.select(array_to_vector(F.col(vector)).alias("v")))
    explained = np.asarray(model.explainedVariance.toArray())
    kept = min(int((np.cumsum(explained) <= variance).sum()) + 1, dimension)
    loadings = np.asarray(model.pc.toArray())[:, :kept]
    lead = loadings[np.abs(loadings).argmax(axis=0), np.arange(kept)]
    mean = np.array([m.mean for m in vector_moments(df, vector, dimension)])
    return Components(mean, loadings * np.where(lead < 0, -1.0, 1.0), explained[:kept])


def project(df: DataFrame, vector: str, components: Components, out: str = "pca") -> DataFrame:
    """Centred scores on the kept components."""
    mean, loadings = components.mean, components.loadings

    @arrow_udf("array<double>")
    def scores(column: pa.Array) -> pa.Array:
        matrix = to_matrix(column)
        return from_matrix((matrix - mean) @ loadings) if len(column) else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, scores(F.col(vector)))


def component_report(spark, components: Components) -> DataFrame:
    running = np.cumsum(components.explained)
    return spark.createDataFrame(
        [(i + 1, float(e), float(running[i])) for i, e in enumerate(components.explained)],
        "component int, explained double, cumulative double",
    )


def map_points(df: DataFrame, pca: str = "pca") -> DataFrame:
    """2-D map: the first two components."""
    return df.withColumns({
        "x": F.get(F.col(pca), F.lit(0)),
        "y": F.coalesce(F.get(F.col(pca), F.lit(1)), F.lit(0.0)),
    })
