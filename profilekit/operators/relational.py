"""Small reusable DataFrame building blocks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.session import materialise


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "number") -> DataFrame:
    """Consecutive numbers from 0 in sorted order without sorting everything in one task."""
    sorted_once = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    )
    sizes = {r["_part"]: (r["first"], r["rows"]) for r in sorted_once.groupBy("_part").agg(
        F.min("_at").alias("first"), F.count(F.lit(1)).alias("rows")).collect()}
    offsets, seen = [], 0
    for part in sorted(sizes):
        first, rows = sizes[part]
        offsets.append((part, seen - first))
        seen += rows
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    return (
        sorted_once.join(F.broadcast(shift), "_part")
        .withColumn(out, F.col("_at") + F.col("_shift")).select(*df.columns, out)
    )


def value_counts(df: DataFrame, by: str, value: str, out: str = "counts") -> DataFrame:
    """Map value -> count per group."""
    return (
        df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias(out))
    )


def group_stats(df: DataFrame, by: str, measure: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("std"),
        F.min(measure).alias("low"), F.max(measure).alias("high"),
    )


def conditional_rates(df: DataFrame, by: str, flag: Column, measures: Sequence[str]) -> DataFrame:
    """Size, flagged count and share, and the mean of each measure."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(flag.cast("long")).alias("flag_count"),
        F.round(F.avg(flag.cast("double")), 3).alias("flag_rate"),
        *[F.round(F.avg(m), 1).alias(f"avg_{m}") for m in measures],
    )


def role_shares(df: DataFrame, by: str, role: str, roles: Sequence[str]) -> DataFrame:
    """Share of each listed role per group; the total includes roles outside the list."""
    counts = df.groupBy(by).agg(
        F.count(role).alias("_total"),
        *[F.count(F.when(F.col(role) == r, 1)).alias(f"_r{i}") for i, r in enumerate(roles)],
    )
    shares = [
        F.when(F.col("_total") > 0, F.col(f"_r{i}") / F.col("_total")).otherwise(0.0).alias(r)
        for i, r in enumerate(roles)
    ]
    return counts.select(by, *shares)


def size_ratio(df: DataFrame, by: str) -> DataFrame:
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_size"), F.max("n").alias("max_size"),
        (F.max("n") / F.min("n")).alias("imbalance"),
    )


def with_group_stats(df: DataFrame, by: str, measure: str) -> DataFrame:
    """Each row with the mean and sample deviation of its group.

    Same result as a window over the group, but the group is aggregated map-side
    first and only its two numbers travel back.
    """
    stats = df.groupBy(by).agg(F.avg(measure).alias(f"{measure}_mean"), F.stddev_samp(measure).alias(f"{measure}_std"))
    return df.join(stats, by, "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key by ``order`` (pass descending columns for the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Ranked top ``k`` per group; Spark cuts every map partition to ``k`` rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def capped_pairs(df: DataFrame, group: str, member: str, cap: Column) -> DataFrame:
    """The first ``cap`` pairs (a before b, members in id order) of each group.

    Pair numbers are turned into member positions by arithmetic, so only the pairs
    asked for are ever made and only the members they can reach are ranked.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    plan = sizes.withColumn("cap", F.least(cap.cast("long"), F.expr("m * (m - 1) div 2"))).filter("cap > 0")
    reach = plan.agg(F.max("cap")).first()[0] or 0
    ranked = top_per_group(df.select(group, member), [group], [F.col(member)], int(reach) + 1, "pos")
    # pairs are numbered (0,1), (0,2), ... (0,m-1), (1,2), ...: row i starts at i*(2m-i-1)/2
    numbers = plan.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cap") - 1)))
    guess = F.floor((2 * F.col("m") - 1 - F.sqrt(F.pow(2 * F.col("m") - 1, 2) - 8 * F.col("p"))) / 2)
    start = lambda i: i * (2 * F.col("m") - i - 1) / 2
    row = F.when(start(guess + 1) <= F.col("p"), guess + 1).when(start(guess) > F.col("p"), guess - 1).otherwise(guess)
    spots = numbers.withColumn("i", row).withColumn("j", (F.col("p") - start(F.col("i")) + F.col("i") + 1).cast("long"))
    a = ranked.select(group, (F.col("pos") - 1).cast("long").alias("i"), F.col(member).alias("a"))
    b = ranked.select(group, (F.col("pos") - 1).cast("long").alias("j"), F.col(member).alias("b"))
    return spots.join(a, [group, "i"]).join(b, [group, "j"]).select(group, "a", "b")


def undirected_distinct(edges: DataFrame, a: str, b: str, order: Sequence[Column]) -> DataFrame:
    """One row per undirected edge, the first by ``order``."""
    keyed = edges.withColumns({"_low": F.least(a, b), "_high": F.greatest(a, b)})
    return first_per_key(keyed, ["_low", "_high"], order).drop("_low", "_high")


def compare_sets(df: DataFrame, old: str, new: str) -> DataFrame:
    """Overlap, additions, removals and Jaccard of two id lists."""
    o, n = F.coalesce(F.col(old), F.array()), F.coalesce(F.col(new), F.array())
    union = F.size(F.array_union(o, n))
    return df.withColumns({
        "overlap_count": F.size(F.array_intersect(o, n)),
        "new_only": F.array_sort(F.array_except(n, o)),
        "removed": F.array_sort(F.array_except(o, n)),
        "jaccard": F.when(union > 0, F.size(F.array_intersect(o, n)) / union).otherwise(F.lit(0.0)),
    })
