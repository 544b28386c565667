"""Joins and running totals in which one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.session import materialise

#: A key is hot when it has more than one row in so many; there are at most this many hot keys, whatever the table.
SHARES = 1_024
#: And more than so many rows, below which no task is worth sparing.
LEAST_HOT = 1_000


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` (one row per key) where a few keys may hold most rows of ``big``.

    Rows of hot keys meet a broadcast copy of their at most SHARES partners where they are; only the others are
    shuffled, and no key among them has more than one row in SHARES. ``how`` is inner, left or left_anti. ``big`` is read
    several times, so it should be a written table; ``counts`` has its rows per key (``count``) where they are known.
    Null keys match nothing.
    """
    keys = list(keys)
    counts = big.groupBy(*keys).count() if counts is None else counts
    hot = materialise(counts.where(F.col("count") > big.count() // SHARES + LEAST_HOT).select(*keys))
    if hot.isEmpty():
        return big.join(small, keys, how)
    few = F.broadcast(materialise(small.join(F.broadcast(hot), keys, "left_semi")))
    return (
        big.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
        .unionByName(big.join(F.broadcast(hot), keys, "left_anti").join(small, keys, how))
    )


def placed(df: DataFrame, order: Sequence[str], partitions: int, walk: Callable[[Iterable], Iterator], ddl: str) -> DataFrame:
    """``df`` sorted over all partitions by ``order`` and walked once, partition by partition; column ``part`` tells which.

    Rows are dealt by ranges of the whole order, with the place of the row in its input as the last
    word, so neither a long key nor many equal rows end up in one task. The result is a written table.
    """
    rows = df.withColumn("_place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions, *order, "_place").sortWithinPartitions(*order, "_place").drop("_place")
    return materialise(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(walk, ddl))


def carried(table: DataFrame, key: str, totals: Sequence[str], add: Callable[[tuple, tuple], tuple]) -> DataFrame | None:
    """(part, key, carry_<total> ...) of keys that go on from an earlier part; ``totals`` run within part and key.

    ``table`` is a result of :func:`placed` with a running column ``step``. Only the first and last key of each
    part come to the driver: as many rows as there are parts.
    """
    at_end = F.struct(key, "step")
    ends = sorted(
        table.groupBy("part").agg(
            F.min(key).alias("first"), F.max(key).alias("last"), *[F.max_by(t, at_end).alias(t) for t in totals]
        ).collect(), key=lambda r: r["part"])
    carries, last, held = [], None, None
    for row in ends:
        mine = tuple(row[t] for t in totals)
        if held is not None and row["first"] == last:
            carries.append((row["part"], row["first"], *held))
            mine = add(held, mine) if row["first"] == row["last"] else mine
        last, held = row["last"], mine
    if not carries:
        return None
    fields = ", ".join(f"carry_{t} long" for t in totals)
    return table.sparkSession.createDataFrame(carries, f"part int, {key} long, {fields}")
