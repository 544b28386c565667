"""Imputation, z-scores, composites, robust scaling and vector assembly."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.config import ADJUSTED_SUFFIX, ProfileConfig, weight_block
from profilekit.functions.scalar import direction
from profilekit.operators.stats import BROADCAST_BYTES, Moments, exact_quantiles, fill_literals, moments


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = exact_quantiles(df, columns, [0.5])
    return {c: found[None][c][0] for c in columns} if found else dict.fromkeys(columns)


def median_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(fill_literals(medians(df, columns)))


def cohort_median_fill(df: DataFrame, columns: Sequence[str], cohort: str) -> DataFrame:
    """Cohort median first, the global median where a cohort has no value at all."""
    overall = medians(df, columns)
    per_cohort = exact_quantiles(df, columns, [0.5], by=cohort)
    # One row per cohort, so the plan does not grow with their number.
    kind = T.StructType([T.StructField("_key", df.schema[cohort].dataType), T.StructField("_fill", T.ArrayType(T.DoubleType()))])
    fills = df.sparkSession.createDataFrame([(key, [found[c][0] for c in columns]) for key, found in per_cohort.items()], kind)
    if 8 * len(columns) * len(per_cohort) <= BROADCAST_BYTES:
        fills = F.broadcast(fills)
    joined = df.join(fills, F.col(cohort).eqNullSafe(F.col("_key")), "left")
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.get("_fill", F.lit(i)), *([F.lit(overall[c])] if overall[c] is not None else []))
        for i, c in enumerate(columns)
    }
    return joined.withColumns(filled).drop("_key", "_fill")


def _z(value: Column, m: Moments) -> Column:
    return (value - F.lit(m.mean)) / F.lit(m.std_pop or 1.0)


def standard_z(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population deviation, a deviation of zero counting as one."""
    found = moments(df, columns)
    return df.withColumns({c + suffix: _z(F.col(c), found[c]) for c in columns if found[c].count})


def add_composites(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean z-score over each column group, on median-filled values; 0.0 for an empty group."""
    used = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    if not used:
        return df.withColumns({name: F.lit(0.0) for name in groups})
    filled = fill_literals(medians(df, used))
    found = moments(df.select(*[v.alias(c) for c, v in filled.items()]), used)

    def mean_z(cols: Sequence[str]) -> Column:
        if not cols:
            return F.lit(0.0)
        total = _z(filled[cols[0]], found[cols[0]])
        for c in cols[1:]:
            total = total + _z(filled[c], found[c])
        return total / F.lit(float(len(cols)))

    return df.withColumns({name: mean_z(cols) for name, cols in groups.items()})


def cohort_zscore(df: DataFrame, columns: Sequence[str], cohort: str, suffix: str = ADJUSTED_SUFFIX) -> DataFrame:
    """(x - cohort mean) / cohort sample deviation; zero counts as one, a cohort of one gives null.

    The statistics table has one row per cohort; Spark broadcasts it when its
    measured size allows, so configured cohorts never move the profiles.
    """
    aggs = [a for i, c in enumerate(columns) for a in (F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}"))]
    stats = df.groupBy(F.col(cohort).alias("_cohort")).agg(*aggs)
    joined = df.join(stats, F.col(cohort).eqNullSafe(F.col("_cohort")), "left")
    adjusted = {
        c + suffix: (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_s{i}"))
        for i, c in enumerate(columns)
    }
    return joined.select(*df.columns, *[v.alias(n) for n, v in adjusted.items()])


def robust_scale(df: DataFrame, columns: Sequence[str], quantile_range: tuple[float, float] = (5.0, 95.0)) -> DataFrame:
    """(x - median) / (upper - lower quantile); an empty range counts as one. Values are not clipped."""
    low, high = quantile_range
    found = exact_quantiles(df, columns, [low / 100, 0.5, high / 100])[None]

    def scaled(c: str) -> Column:
        q_low, mid, q_high = found[c]
        if mid is None:
            return F.col(c)
        return (F.col(c) - F.lit(mid)) / F.lit((q_high - q_low) or 1.0)

    return df.withColumns({c: scaled(c) for c in columns})


def weight_columns(df: DataFrame, columns: Sequence[str], weights: Mapping[str, float], cfg: ProfileConfig) -> DataFrame:
    factors = {c: float(weights.get(weight_block(c, cfg), 1.0)) for c in columns}
    changed = {c: F.col(c) * F.lit(w) for c, w in factors.items() if w != 1.0}
    return df.withColumns(changed) if changed else df


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def vector_moments(df: DataFrame, vector: str, dimension: int) -> list[Moments]:
    """Moments of every position of a vector column, in one aggregation buffer."""
    wanted = Summarizer.metrics("count", "mean", "variance", "min", "max")
    row = df.select(wanted.summary(array_to_vector(F.col(vector))).alias("s")).first()["s"]
    n = row["count"]
    spreads = [float(v) ** 0.5 for v in row["variance"]]
    pop = ((n - 1) / n) ** 0.5 if n else 0.0
    return [
        Moments(n, float(row["mean"][i]), spreads[i] * pop, spreads[i], float(row["min"][i]), float(row["max"][i]))
        for i in range(dimension)
    ]


def row_profile(df: DataFrame, vector: str, features: Sequence[str], top_n: int = 5, out: str = "top_features") -> DataFrame:
    """Each row's ``top_n`` features by size of the z-score against the global mean."""
    found = vector_moments(df, vector, len(features))
    names = F.array(*[F.lit(f.replace(ADJUSTED_SUFFIX, "")) for f in features])
    means = F.array(*[F.lit(m.mean) for m in found])
    spreads = F.array(*[F.lit(m.std_pop + 1e-8) for m in found])
    z = F.transform(F.col(vector), lambda x, i: (x - F.get(means, i)) / F.get(spreads, i))
    ranked = F.array_sort(F.transform(z, lambda v, i: F.struct(
        (-F.round(F.abs(v), 9)).alias("order"), i.alias("position"), v.alias("z"), F.get(names, i).alias("feature"),
    )))
    top = F.transform(F.slice(ranked, 1, top_n), lambda e: F.struct(
        e["feature"].alias("feature"), F.round(e["z"], 3).alias("z_score"), direction(e["z"]).alias("direction"),
    ))
    return df.withColumn(out, top)
