"""Clustering features: bounded summaries of any number of rows, built per task and merged without loss.

A feature is (count, sum, sum of squared lengths); two features add up to that of all their rows. A task keeps at most a given number of
them: a row joins the nearest feature if its mean lies within a radius, else it becomes one of its own, and when there are too
many the radius grows and they are inserted anew. Features of several tasks are merged the same way, eight tasks at a time,
until one set is left. The radius starts at 0: as long as there are no more different rows than features, every feature
is one row and its copies, and whatever is computed from the features is exact.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.functions.vector import to_matrix
from profilekit.session import materialise

#: Rows whose features one task builds, and sets of features one task merges.
TASK_ROWS, FAN_IN = 250_000, 8


class FeatureSet:
    """At most ``most`` features, and the radius that took."""

    def __init__(self, width: int, most: int, radius: float = 0.0):
        self.most, self.radius = most, radius
        self.n, self.total, self.square = np.empty(0), np.empty((0, width)), np.empty(0)

    def add(self, n: np.ndarray, total: np.ndarray, square: np.ndarray) -> None:
        """Insert features in order; sums are kept exactly, whatever joins what."""
        for start in range(0, len(n), 1_024):
            part = slice(start, start + 1_024)
            self._insert(n[part], total[part], square[part])
            while len(self.n) > self.most:
                self._grow()

    def _insert(self, n: np.ndarray, total: np.ndarray, square: np.ndarray) -> None:
        mean = total / n[:, None]
        near, gap = _nearest(mean, self.total / self.n[:, None]) if len(self.n) else (np.zeros(len(n), np.int64), np.full(len(n), np.inf))
        fits = gap <= self.radius
        np.add.at(self.n, near[fits], n[fits])
        np.add.at(self.total, near[fits], total[fits])
        np.add.at(self.square, near[fits], square[fits])
        # The others meet each other: the first left opens a feature and takes those within the radius of it.
        left = np.flatnonzero(~fits)
        fresh = []
        while len(left):
            own = ((mean[left] - mean[left[0]]) ** 2).sum(axis=1) ** 0.5 <= self.radius
            own[0] = True
            took = left[own]
            fresh.append((n[took].sum(), total[took].sum(axis=0), square[took].sum()))
            left = left[~own]
        if fresh:
            counts, sums, squares = zip(*fresh)
            self.n, self.total, self.square = np.r_[self.n, counts], np.vstack([self.total, sums]), np.r_[self.square, squares]

    def _grow(self) -> None:
        """A radius at which about a quarter of the features join another, and all inserted anew."""
        mean = self.total / self.n[:, None]
        some = np.linspace(0, len(mean) - 1, min(len(mean), 512)).astype(np.int64)
        gaps = np.sort(_nearest(mean[some], mean, skip=some)[1])
        self.radius = max(1.2 * self.radius, float(gaps[len(gaps) // 4]), 1e-12)
        again = FeatureSet(self.total.shape[1], 2 * len(self.n) + 1, self.radius)
        again.add(self.n, self.total, self.square)
        self.n, self.total, self.square = again.n, again.total, again.square


def _nearest(rows: np.ndarray, centres: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, the first at ties, and how far it is; ``skip`` is each row's own place among the centres."""
    gap = (rows ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1)[None, :] - 2.0 * rows @ centres.T
    if skip is not None:
        gap[np.arange(len(rows)), skip] = np.inf
    at = gap.argmin(axis=1)
    return at, ((rows - centres[at]) ** 2).sum(axis=1) ** 0.5


def nearest_feature(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _nearest(rows, centres)[0]


_DDL = "part long, radius double, n double, total array<double>, square double"
_SCHEMA = pa.schema([("part", pa.int64()), ("radius", pa.float64()), ("n", pa.float64()), ("total", pa.list_(pa.float64())), ("square", pa.float64())])


def _rows_of(part: int, found: FeatureSet) -> pa.Table:
    size = len(found.n)
    return pa.table([
        pa.array([part] * size, pa.int64()), pa.array([found.radius] * size, pa.float64()), pa.array(found.n), pa.array(list(found.total), pa.list_(pa.float64())),
        pa.array(found.square)], schema=_SCHEMA)


def clustering_features(df: DataFrame, vector: str, most: int) -> DataFrame:
    """(n, total, square): at most ``most`` features of all rows, the same whatever the partitions of ``df``."""
    points = materialise(df.select(F.col(vector).cast("array<double>").alias("v")))
    parts = max(1, math.ceil(points.count() / TASK_ROWS))
    # Dealt and sorted by content, so the features do not depend on how the rows came.
    keyed = points.withColumn("h", F.xxhash64("v"))
    dealt = keyed.repartitionById(parts, F.pmod("h", F.lit(parts)).cast("int")).sortWithinPartitions("h", "v").select("v", F.spark_partition_id().cast("long").alias("part"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = None, 0
        for batch in batches:
            if batch.num_rows:
                rows, part = to_matrix(batch.column("v")), batch.column("part")[0].as_py()
                found = found or FeatureSet(rows.shape[1], most)
                found.add(np.ones(len(rows)), rows, (rows ** 2).sum(axis=1))
        if found is not None:
            yield from _rows_of(part, found).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("from", "ascending"), ("place", "ascending")])
        total = to_matrix(table.column("total").combine_chunks())
        found = FeatureSet(total.shape[1], most, max(table.column("radius").to_pylist()))
        found.add(table.column("n").to_numpy(), total, table.column("square").to_numpy())
        return _rows_of(table.column("part")[0].as_py(), found)

    sets = materialise(dealt.mapInArrow(build, _DDL))
    while parts > 1:
        up = sets.select(
            F.floor(F.col("part") / FAN_IN).alias("part"), F.col("part").alias("from"), F.xxhash64("n", "total").alias("place"), "radius", "n", "total", "square")
        sets = materialise(up.groupBy("part").applyInArrow(merge, _DDL))
        parts = math.ceil(parts / FAN_IN)
    return sets.select("n", "total", "square")
