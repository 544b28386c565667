"""Consensus of several clusterings.

Two rows agree as often as the algorithms give them the same non-noise label, which
depends only on their label tuples. The co-association of n rows is therefore
kept as one row per distinct tuple with its count, never as an n x n matrix.
"""

from __future__ import annotations

import heapq
from functools import reduce
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.config import NOISE
from profilekit.operators.nearest import nearest
from profilekit.session import materialise

#: Distinct tuples that three clusterings of 50 clusters can form, the most that RunParams admits.
MAX_TUPLES = 125_000
#: Up to so many tuples the first nearest partners are found on the driver.
FEW_TUPLES = 4_096


def label_tuples(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Distinct label tuples with the number of rows that have them."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n_rows"))


def coassociation(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Agreement of every two label tuples that agree at all: ``(a_*, b_*, agreement)`` with both row counts.

    One equi-join per algorithm on the tuple table, which holds at most the
    product of the cluster counts whatever the number of rows.
    """
    tuples = label_tuples(df, labels)
    left = tuples.select(*[F.col(c).alias(f"a_{c}") for c in labels], F.col("n_rows").alias("a_rows"))
    right = tuples.select(*[F.col(c).alias(f"b_{c}") for c in labels], F.col("n_rows").alias("b_rows"))
    agreeing = reduce(
        lambda x, y: x.unionByName(y),
        [
            left.filter(F.col(f"a_{c}") != NOISE).join(right, F.col(f"a_{c}") == F.col(f"b_{c}"))
            for c in labels
        ],
    )
    return agreeing.groupBy(*agreeing.columns).agg((F.count(F.lit(1)) / F.lit(len(labels))).alias("agreement"))


def mean_coassociation(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean of the full matrix, its zero diagonal included, from label counts alone."""
    long = df.select(F.posexplode(F.array(*[F.col(c).cast("int") for c in labels])).alias("algorithm", "label"))
    counts = long.groupBy("algorithm", "label").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("algorithm").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("label") != NOISE, F.col("n").cast("double") * (F.col("n") - 1)).otherwise(0.0)).alias("agree"),
    )
    return per.agg((F.sum("agree") / F.count(F.lit(1)) / F.pow(F.max("rows").cast("double"), 2)).alias("mean_coassociation"))


def average_linkage(agreement: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Average linkage on ``1 - agreement`` between weighted groups until ``k`` remain.

    Distances take few values, so ties are the rule: they go to the pair whose
    first members come first. Distances are compared after rounding to nine places.
    """
    n = len(counts)
    weight = counts.astype(float).copy()
    gap = np.round(1.0 - agreement, 12)
    np.fill_diagonal(gap, np.inf)
    owner = np.arange(n)
    # Smallest rounded distance of each row and where it is; only rows that a merge touches are looked at again.
    seen = np.round(gap, 9)
    place = seen.argmin(axis=1)
    least = seen[owner, place]
    for _ in range(max(n - k, 0)):
        first = int(least.argmin())
        a, b = sorted((first, int(place[first])))
        merged = (weight[a] * gap[a] + weight[b] * gap[b]) / (weight[a] + weight[b])
        merged[[a, b]] = np.inf
        gap[a, :] = gap[:, a] = merged
        gap[b, :] = gap[:, b] = np.inf
        rounded = np.round(merged, 9)
        seen[a, :] = seen[:, a] = rounded
        seen[b, :] = seen[:, b] = np.inf
        weight[a] += weight[b]
        owner[owner == b] = a
        stale = np.flatnonzero((place == a) | (place == b))
        place[stale] = seen[stale].argmin(axis=1)
        least[stale] = seen[stale, place[stale]]
        better = (rounded < least) | ((rounded == least) & (a < place) & np.isfinite(rounded))
        least[better], place[better] = rounded[better], a
        for row in (a, b):
            place[row] = seen[row].argmin()
            least[row] = seen[row, place[row]]
    return np.unique(owner, return_inverse=True)[1]


def label_profiles(values: np.ndarray, n_labels: int) -> np.ndarray:
    """One row per tuple: 1 for each of its labels, noise left out; columns are (algorithm, label)."""
    columns, start = [], 0
    for column in values.T:
        names, code = np.unique(column, return_inverse=True)
        columns.append(np.where(column == NOISE, -1, code + start))
        start += len(names)
    profiles = np.zeros((len(values), max(start, 1)))
    for code in columns:
        rows = np.flatnonzero(code >= 0)
        profiles[rows, code[rows]] = 1.0
    return profiles / n_labels ** 0.5


def profile_linkage(profiles: np.ndarray, counts: np.ndarray, k: int, first: np.ndarray | None = None) -> np.ndarray:
    """Average linkage as :func:`average_linkage` does it, without a matrix of pairs.

    The agreement of two groups is the inner product of their mean profiles, so a merge is a weighted mean. Each group remembers its best
    partner; agreements only fall when groups merge, so an outdated partner still bounds the true one and is looked up
    again only when it comes first. ``first`` are the best partners at the start, where they are known.
    """
    n, width = profiles.shape
    mean, weight, alive = profiles.copy(), counts.astype(float).copy(), np.ones(n, dtype=bool)
    columns = np.asfortranarray(mean)
    stamp, owner = np.zeros(n, dtype=np.int64), np.arange(n)

    def best(i: int) -> tuple[float, int] | None:
        used = np.flatnonzero(mean[i])
        gap = np.round(1.0 - columns[:, used] @ mean[i, used], 12)
        gap = np.round(gap, 9)
        gap[~alive] = np.inf
        gap[i] = np.inf
        j = int(gap.argmin())
        return (float(gap[j]), j) if np.isfinite(gap[j]) else None

    queue = []
    for i in range(n):
        found = best(i) if first is None else (round(round(1.0 - float(mean[i] @ mean[first[i]]), 12), 9), int(first[i]))
        if n > 1 and found is not None:
            queue.append((found[0], *sorted((i, found[1])), i, found[1], 0, 0))
    heapq.heapify(queue)
    left = n
    while left > max(k, 1) and queue:
        gap, a, b, i, j, of_i, of_j = heapq.heappop(queue)
        if not alive[i] or stamp[i] != of_i:
            continue
        if not alive[j] or stamp[j] != of_j:
            found = best(i)
            if found is not None:
                heapq.heappush(queue, (found[0], *sorted((i, found[1])), i, found[1], int(stamp[i]), int(stamp[found[1]])))
            continue
        mean[a] = (weight[a] * mean[a] + weight[b] * mean[b]) / (weight[a] + weight[b])
        columns[a] = mean[a]
        weight[a] += weight[b]
        alive[b] = False
        stamp[a] += 1
        owner[b] = a
        left -= 1
        found = best(a)
        if found is not None:
            heapq.heappush(queue, (found[0], *sorted((a, found[1])), a, found[1], int(stamp[a]), int(stamp[found[1]])))
    root = owner.copy()
    while (root != owner[root]).any():
        root = owner[root]
    return np.unique(root, return_inverse=True)[1]


def _first_partners(spark, profiles: np.ndarray) -> np.ndarray:
    """Each tuple's best partner, the smaller number at ties, found by Spark.

    Both sides get a number of their own that makes vectors unit length and leaves products as they are.
    """
    rest = np.sqrt(np.maximum(1.0 - (profiles ** 2).sum(axis=1), 0.0))
    rows = materialise(spark.createDataFrame(
        [(i, [*p.tolist(), r, 0.0], [*p.tolist(), 0.0, r]) for i, (p, r) in enumerate(zip(profiles, rest.tolist()))],
        "id long, query_vec array<double>, item_vec array<double>"))
    found = nearest(rows.selectExpr("id AS query_id", "query_vec"), rows.selectExpr("id AS item_id", "item_vec"), 1).orderBy("query_id").toArrow()
    return found.column("item_id").to_numpy()


def consensus_labels(df: DataFrame, labels: Sequence[str], k: int, out: str = "consensus") -> DataFrame:
    """Average-linkage consensus: linkage on the tuple table, labels joined back by tuple.

    The tuple table has at most MAX_TUPLES rows, whatever the number of rows; it is checked before it is read.
    """
    rows = label_tuples(df, labels).orderBy(*labels).limit(MAX_TUPLES + 1).collect()
    if len(rows) > MAX_TUPLES:
        raise ValueError(f"more than {MAX_TUPLES} distinct label tuples: use fewer clusters per algorithm")
    values = np.array([[r[c] for c in labels] for r in rows]).reshape(len(rows), len(labels))
    counts = np.array([r["n_rows"] for r in rows])
    profiles = label_profiles(values, len(labels))
    first = _first_partners(df.sparkSession, profiles) if len(rows) > FEW_TUPLES else None
    merged = profile_linkage(profiles, counts, k, first)
    types = {c: df.schema[c].dataType.simpleString() for c in labels}
    lookup = df.sparkSession.createDataFrame(
        [(*[int(v) for v in t], int(m)) for t, m in zip(values, merged)],
        ", ".join(f"`{c}` {types[c]}" for c in labels) + f", {out} int",
    )
    return df.join(F.broadcast(lookup), list(labels), "left")


def own_agreement(df: DataFrame, labels: Sequence[str], consensus: str, out: str = "agreement") -> DataFrame:
    """Mean agreement of each row with the other rows of its consensus cluster; null for a cluster of one.

    Rows of the cluster that share an algorithm's label are counted per (cluster,
    label), so no pair of rows is ever formed. The count tables are written once: their
    true size lets Spark broadcast them, so a huge cluster is not shuffled.
    """
    sizes = materialise(df.groupBy(consensus).agg(F.count(F.lit(1)).alias("_size")))
    result = df.join(sizes, consensus)
    total: Column = F.lit(0)
    for i, c in enumerate(labels):
        shared = materialise(df.groupBy(consensus, c).agg((F.count(F.lit(1)) - 1).alias(f"_same{i}")))
        result = result.join(shared, [consensus, c])
        total = total + F.when(F.col(c) != NOISE, F.col(f"_same{i}")).otherwise(0)
    mean = F.when(F.col("_size") > 1, total / F.lit(len(labels)) / (F.col("_size") - 1))
    return result.withColumn(out, mean).select(*df.columns, out)


def drop_low_consensus(df: DataFrame, labels: Sequence[str], consensus: str, min_consensus: float = 0.5, out: str = "label") -> DataFrame:
    scored = own_agreement(df, labels, consensus, "_agreement")
    weak = F.col("_agreement") < min_consensus
    return scored.withColumn(out, F.when(weak, F.lit(NOISE)).otherwise(F.col(consensus))).drop("_agreement")


def adjusted_rand(df: DataFrame, a: str, b: str, min_rows: int = 10) -> DataFrame:
    """One row ``(n_rows, ari)`` over rows that are noise in neither labelling; null up to ``min_rows`` rows."""
    cells = df.filter((F.col(a) != NOISE) & (F.col(b) != NOISE)).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = [
        cells.select(F.lit("cell").alias("kind"), "n"),
        cells.groupBy(a).agg(F.sum("n").alias("n")).select(F.lit("a").alias("kind"), "n"),
        cells.groupBy(b).agg(F.sum("n").alias("n")).select(F.lit("b").alias("kind"), "n"),
    ]
    pairs = F.col("n") * (F.col("n") - 1) / 2

    def total(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))

    sums = reduce(lambda x, y: x.unionByName(y), sides).agg(
        total("cell", F.col("n")).alias("rows"),
        total("cell", pairs).alias("same"), total("a", pairs).alias("in_a"), total("b", pairs).alias("in_b"),
    )
    every = F.nullif(F.col("rows") * (F.col("rows") - 1) / 2, F.lit(0.0))
    expected = F.col("in_a") * F.col("in_b") / every
    best = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.when(best == expected, F.lit(1.0)).otherwise((F.col("same") - expected) / (best - expected))
    return sums.select(
        F.col("rows").cast("long").alias("n_rows"), F.when(F.col("rows") > min_rows, ari).alias("ari")
    )


def consensus_report(df: DataFrame, labels: Sequence[str], final: str) -> DataFrame:
    """One row: clusters, hybrid rows and share, mean co-association, ARI per algorithm."""
    base = df.agg(
        F.countDistinct(F.when(F.col(final) != NOISE, F.col(final))).alias("n_clusters"),
        F.sum((F.col(final) == NOISE).cast("long")).alias("n_hybrid"),
        F.avg((F.col(final) == NOISE).cast("double")).alias("hybrid_share"),
    )
    scores = {c: adjusted_rand(df, c, final).first()["ari"] for c in labels}
    mean = mean_coassociation(df, labels).first()[0]
    return base.withColumns({
        "mean_coassociation": F.lit(mean),
        **{f"ari_{c}": F.lit(v).cast("double") for c, v in scores.items()},
    })
