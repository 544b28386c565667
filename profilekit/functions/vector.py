"""Vectors as ``array<double>`` columns, and their Arrow form inside tasks."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def _with_each(a: Column, once: Column, fn) -> Column:
    """``fn(element, once)`` per element. Inside a lambda ``once`` would be computed again for every element."""
    return F.zip_with(a, F.array_repeat(once, F.size(a)), fn)


def unit(a: Column) -> Column:
    """Scale to length one; the zero vector stays zero."""
    length = norm(a)
    return _with_each(a, F.when(length == 0, F.lit(1.0)).otherwise(length), lambda x, n: x / n)


def pick(a: Column, positions: Sequence[int]) -> Column:
    return F.array(*[F.get(a, F.lit(int(i))) for i in positions])


def block_unit(a: Column, positions: Sequence[int]) -> Column:
    """The part of a vector that belongs to one block, scaled by its length plus a tiny constant."""
    part = pick(a, positions)
    return _with_each(part, norm(part) + TINY, lambda x, n: x / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def well_formed(vector: Column, dimension: int) -> Column:
    """Right length and only finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def top_contributions(query: Column, candidate: Column, features: Sequence[str] | None, top_n: int = 5) -> Column:
    """Per-feature share of the cosine, the largest ``top_n`` by size, with both values.

    Empty where the cosine is not positive or too small to divide by. Equal sizes
    keep the order of the features.
    """
    names = None if features is None else F.array(*[F.lit(f) for f in features])
    cos = dot(query, candidate)
    usable = (cos >= TINY) & (cos < F.lit(float("inf")))
    values = F.zip_with(query, candidate, lambda x, y: F.struct(x.alias("q"), y.alias("c")))
    shares = _with_each(values, F.when(usable, cos), lambda e, total: F.struct(
        (e["q"] * e["c"] / total).alias("share"), e["q"].alias("q"), e["c"].alias("c")))
    entries = F.transform(shares, lambda e, i: F.struct(
        (-F.round(F.abs(e["share"]), 9)).alias("order"),
        i.alias("position"),
        (F.get(names, i) if names is not None else i.cast("string")).alias("feature"),
        e["share"].alias("contribution"),
        e["q"].alias("query_value"),
        e["c"].alias("candidate_value"),
    ))
    top = F.transform(
        F.slice(F.array_sort(entries), 1, top_n),
        lambda e: F.struct(
            e["feature"].alias("feature"),
            e["contribution"].alias("contribution"),
            F.abs(e["contribution"]).alias("abs_contribution"),
            e["query_value"].alias("query_value"),
            e["candidate_value"].alias("candidate_value"),
        ),
    )
    return F.when(usable, top).otherwise(F.slice(top, 1, 0))


def block_share(query: Column, candidate: Column, positions: Sequence[int]) -> Column:
    """Share of the cosine that one block contributes; null where there is no positive cosine."""
    cos = dot(query, candidate)
    return F.when(cos > 0, dot(pick(query, positions), pick(candidate, positions)) / cos)


# ---------------------------------------------------------------- Arrow helpers

def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equal-length vectors -> (rows, dimension) float64 matrix without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def from_matrix(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))
