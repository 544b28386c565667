"""Stability of k-means under resampling: all samples are reclustered together, in one plan.

Every row carries one bit per sample. A round of Lloyd's algorithm is one aggregate for all samples: each task adds up its
rows per (sample, cluster), Spark adds up the tasks, and as many rows as there are samples times clusters come to the
driver. The full table is one more sample, so its labels cost nothing extra. The last pass counts label pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.functions.vector import to_matrix
from profilekit.operators.stats import exact_quantiles
from profilekit.session import materialise


@dataclass(frozen=True)
class ResamplingParams:
    """Samples and their share; rounds; on how many rows, those of smallest hash, the first centres are chosen."""

    k: int = 12
    n_iterations: int = 50
    sample_share: float = 0.8
    seed: int = 42
    max_rounds: int = 60
    tolerance: float = 1e-9
    seed_rows: int = 4_096
    stable_from: float = 0.85
    min_rows: int = 10


def with_samples(df: DataFrame, id_col: str, vector: str, params: ResamplingParams) -> DataFrame:
    """(id, vector, member): ``member[i]`` tells whether the row is in sample i, of which 0 is the whole table.

    A sample is the rows whose seeded hash lies below its exact quantile: of fixed size and the same whatever the partitions.
    """
    names = [f"h{i}" for i in range(1, params.n_iterations + 1)]
    keyed = materialise(df.select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        *[F.xxhash64(F.lit(params.seed + i), F.col(id_col)).cast("double").alias(n) for i, n in enumerate(names)]))
    n = keyed.count()
    share = (int(n * params.sample_share) - 0.5) / max(n - 1, 1)
    cuts = exact_quantiles(keyed, names, [share])[None] if n else {}
    inside = [F.col(c) <= F.lit(cuts[c][0]) if n else F.lit(True) for c in names]
    return materialise(keyed.select("id", "vector", F.array(F.lit(True), *inside).alias("member")))


def first_centres(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k-means++ on a few rows; fewer rows than centres repeat."""
    chosen = [points[random.integers(len(points))]]
    gap = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = gap.sum()
        at = random.integers(len(points)) if total == 0 else int(np.searchsorted(np.cumsum(gap), random.random() * total, side="right"))
        chosen.append(points[min(at, len(points) - 1)])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, sample) -> cluster, for centres of shape (sample, cluster, number); the first at ties."""
    samples, k, _ = centres.shape
    flat = centres.reshape(samples * k, -1)
    score = (flat ** 2).sum(axis=1)[None, :] - 2.0 * points @ flat.T
    return score.reshape(len(points), samples, k).argmin(axis=2)


def _members(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("member")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lloyd(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """New centres of all samples; a cluster without rows keeps its centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    ddl = "sample int, cluster int, n long, total array<double>"
    schema = pa.schema([("sample", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, k, width = shared.value.shape
        total, seen = np.zeros((samples * k, width)), np.zeros(samples * k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                points, member = to_matrix(part.column("vector")), _members(part)
                place = nearest_centre(points, shared.value) + np.arange(samples)[None, :] * k
                for i in range(samples):
                    own = place[member[:, i], i]
                    np.add.at(total, own, points[member[:, i]])
                    seen += np.bincount(own, minlength=len(seen))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([
            pa.array(used // k, pa.int32()), pa.array(used % k, pa.int32()), pa.array(seen[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.float64()))], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = to_matrix(table.column("total").combine_chunks()).sum(axis=0)
        n = sum(table.column("n").to_pylist())
        return pa.table([[table.column("sample")[0].as_py()], [table.column("cluster")[0].as_py()], [n], [total.tolist()]], schema=schema)

    found = rows.select("vector", "member").mapInArrow(sums, ddl).groupBy("sample", "cluster").applyInArrow(add, ddl).toArrow()
    shared.unpersist()
    new = centres.copy()
    if found.num_rows:
        at = found.column("sample").to_numpy(), found.column("cluster").to_numpy()
        new[at] = to_matrix(found.column("total")) / found.column("n").to_numpy()[:, None]
    return new


def rand_index(cells: np.ndarray) -> float:
    """Adjusted Rand index of a table of counts."""
    pairs = lambda x: float((x * (x - 1.0) / 2).sum())
    same, a, b, every = pairs(cells), pairs(cells.sum(axis=1)), pairs(cells.sum(axis=0)), pairs(np.array([cells.sum()]))
    expected = a * b / every if every else 0.0
    best = (a + b) / 2
    return 1.0 if best == expected else (same - expected) / (best - expected)


def recluster_samples(df: DataFrame, id_col: str, vector: str, params: ResamplingParams = ResamplingParams()) -> DataFrame:
    """One row per sample: ``sample, n_rows, ari`` against the clusters of the whole table; null up to ``min_rows`` rows."""
    spark = df.sparkSession
    rows = with_samples(df, id_col, vector, params)
    ddl = "sample int, n_rows long, ari double"
    few = rows.orderBy(F.xxhash64(F.lit(params.seed), F.col("id")), "id").limit(params.seed_rows).toArrow()
    if not few.num_rows:
        return spark.createDataFrame([], ddl)
    points, member = to_matrix(few.column("vector")), np.array(few.column("member").to_pylist(), dtype=bool)
    random = np.random.default_rng(params.seed)
    centres = np.array([
        first_centres(points[member[:, i]] if member[:, i].any() else points, params.k, random) for i in range(params.n_iterations + 1)])
    for _ in range(params.max_rounds):
        new = _lloyd(rows, centres)
        moved, centres = np.abs(new - centres).max(), new
        if moved <= params.tolerance:
            break
    shared = spark.sparkContext.broadcast(centres)
    pair_ddl = "sample int, full int, part int, n long"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, k, _ = shared.value.shape
        cells = np.zeros((samples, k, k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                place, member = nearest_centre(to_matrix(part.column("vector")), shared.value), _members(part)
                for i in range(1, samples):
                    np.add.at(cells[i], (place[member[:, i], 0], place[member[:, i], i]), 1)
        sample, full, own = np.nonzero(cells)
        yield pa.RecordBatch.from_pydict({
            "sample": pa.array(sample, pa.int32()), "full": pa.array(full, pa.int32()), "part": pa.array(own, pa.int32()), "n": pa.array(cells[sample, full, own], pa.int64())})

    found = rows.select("vector", "member").mapInArrow(pairs, pair_ddl).groupBy("sample", "full", "part").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros((params.n_iterations + 1, params.k, params.k))
    for r in found:
        cells[r["sample"], r["full"], r["part"]] = r["n"]
    return spark.createDataFrame(
        [(i, int(cells[i].sum()), rand_index(cells[i]) if cells[i].sum() > params.min_rows else None) for i in range(1, params.n_iterations + 1)], ddl)


def stability_summary(samples: DataFrame, stable_from: float = 0.85) -> DataFrame:
    """One row: mean and population deviation of the index over the valid samples, and whether the mean says stable."""
    found = samples.agg(
        F.coalesce(F.avg("ari"), F.lit(0.0)).alias("mean_ari"), F.coalesce(F.stddev_pop("ari"), F.lit(0.0)).alias("std_ari"),
        F.count("ari").cast("int").alias("n_valid_iterations"))
    return found.withColumn("stable", (F.col("n_valid_iterations") > 0) & (F.col("mean_ari") > stable_from))
