"""How good is a search: recall, reciprocal rank, labelled pairs and the regression gate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.operators.labels import non_noise
from profilekit.operators.relational import capped_pairs, compare_sets

KS = (1, 5, 10, 20, 50)


def first_hits(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rank of the first expected id per answered query, null when none was found."""
    expected = pairs.select(F.col("query_id"), F.col("expected_id").alias("item_id")).distinct()
    answered = results.select("query_id").distinct().join(expected.select("query_id").distinct(), "query_id", "left_semi")
    hits = results.join(expected, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return answered.join(hits, "query_id", "left")


def recall_and_mrr(results: DataFrame, pairs: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """A query counts once when any expected id is within k; queries that were not answered are left out."""
    hits = first_hits(results, pairs)
    found = lambda k: F.coalesce(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))), F.lit(0.0))
    return hits.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[found(k).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
    )


def labelled_pairs(df: DataFrame, id_col: str, label: str, max_pairs: int = 500) -> DataFrame:
    """Pairs of one cluster, at most ``max_pairs // clusters + 1`` per cluster, in hash order, cut to ``max_pairs``."""
    clean = non_noise(df, label)
    clusters = clean.select(label).distinct().count()
    pairs = capped_pairs(clean, label, id_col, F.lit(max_pairs // max(clusters, 1) + 1))
    return pairs.orderBy(F.xxhash64("a", "b"), "a", "b").limit(max_pairs).select(
        F.col("a").alias("query_id"), F.col("b").alias("expected_id")
    )


def capture_baseline(results: DataFrame, k: int = 10) -> DataFrame:
    """Ordered result ids per query: ``(query_id, ids)``."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return results.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(ranked, lambda e: e["item_id"]).alias("ids"))


def compare_baseline(old: DataFrame, new: DataFrame, alert_below: float = 0.70) -> DataFrame:
    """Per query of the baseline that the new index answers: overlap, additions, removals, Jaccard, alert."""
    both = old.select("query_id", F.col("ids").alias("old_ids")).join(new.select("query_id", F.col("ids").alias("new_ids")), "query_id")
    return compare_sets(both, "old_ids", "new_ids").withColumn("alert", F.col("jaccard") < alert_below)


def gate(comparison: DataFrame, mean_from: float = 0.85) -> DataFrame:
    """One row: may the new index be promoted?"""
    return comparison.agg(
        F.count(F.lit(1)).alias("n_tested"),
        F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("mean_jaccard"),
        F.coalesce(F.sum(F.col("alert").cast("long")), F.lit(0)).alias("n_alerts"),
    ).withColumn("passed", (F.col("mean_jaccard") >= mean_from) & (F.col("n_alerts") == 0))


def score_drift(old: DataFrame, new: DataFrame, allowed: float = 0.05) -> DataFrame:
    """Shift of the median similarity between two versions."""
    from profilekit.operators.stats import exact_quantiles

    spark = old.sparkSession
    medians = [exact_quantiles(d, ["score"], [0.5]).get(None, {}).get("score", [None])[0] for d in (old, new)]
    shift = None if None in medians else abs(medians[1] - medians[0])
    return spark.createDataFrame(
        [(medians[0], medians[1], shift, shift is not None and shift > allowed)],
        "median_old double, median_new double, shift double, drifted boolean",
    )


def rank_correlation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spearman's rho per query on the ids both versions return; null below two common ids.

    Ranks within a query are distinct, so rho is 1 - 6 * sum(d^2) / (m (m^2 - 1)) on re-ranked positions.
    """
    from pyspark.sql import Window

    both = old.select("query_id", "item_id", F.col("rank").alias("ra")).join(
        new.select("query_id", "item_id", F.col("rank").alias("rb")), ["query_id", "item_id"])
    w = Window.partitionBy("query_id")
    ranked = both.withColumns({
        "pa": F.row_number().over(w.orderBy("ra")), "pb": F.row_number().over(w.orderBy("rb")),
    })
    per = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_common"), F.sum(F.pow(F.col("pa") - F.col("pb"), 2)).alias("_d2"))
    m = F.col("n_common")
    return per.select("query_id", "n_common", F.when(m > 1, 1 - 6 * F.col("_d2") / (m * (m * m - 1))).alias("spearman"))
