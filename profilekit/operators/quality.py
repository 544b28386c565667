"""How good is a clustering: separation, sizes, stability, diversity; and data quality."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import NOISE
from profilekit.functions.vector import euclidean
from profilekit.operators.consensus import adjusted_rand
from profilekit.operators.labels import centroids, non_noise
from profilekit.operators.relational import group_stats, size_ratio
from profilekit.operators.stats import exact_quantiles, moments
from profilekit.session import materialise

#: Clusters that are compared with each other in one row.
MAX_CLUSTERS = 1_000


def silhouette(df: DataFrame, vector: str, label: str) -> float | None:
    """Mean cosine silhouette without noise rows; ``None`` below two clusters."""
    clean = non_noise(df, label)
    if clean.select(label).distinct().limit(2).count() < 2:
        return None
    prepared = clean.select(array_to_vector(F.col(vector)).alias("v"), F.col(label).cast("int").alias("l"))
    return float(
        ClusteringEvaluator(featuresCol="v", predictionCol="l", metricName="silhouette", distanceMeasure="cosine").evaluate(prepared)
    )


def davies_bouldin(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / centroid distance.

    Clusters with the same centroid count as infinitely far apart. Rows meet only their own centroid. The comparison of clusters with each other is
    done on the table of valid clusters; more than ``MAX_CLUSTERS`` are refused.
    """
    clean = non_noise(df, label)
    centre = materialise(centroids(clean, vector, label).select(label, "centroid"))
    if centre.count() > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    spread = (
        clean.join(centre, label)
        .groupBy(label).agg(F.avg(euclidean(F.col(vector), F.col("centroid"))).alias("spread"))
        .join(centre, label)
    )
    table = spread.select(F.collect_list(F.struct(F.col(label).alias("l"), "spread", "centroid")).alias("all"))
    worst = F.transform(F.col("all"), lambda a: F.array_max(F.transform(
        F.filter(F.col("all"), lambda b: b["l"] != a["l"]),
        lambda b: F.coalesce(F.try_divide(a["spread"] + b["spread"], euclidean(a["centroid"], b["centroid"])), F.lit(0.0)),
    )))
    return table.select(
        F.when(F.size("all") >= 2, F.aggregate(worst, F.lit(0.0), lambda x, y: x + y) / F.size("all")).alias("davies_bouldin")
    )


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def size_report(df: DataFrame, label: str) -> DataFrame:
    """One row: valid clusters, smallest, largest, imbalance, noise rows and share."""
    sizes = cluster_sizes(df, label)
    valid = F.col(label) != NOISE
    return sizes.agg(
        F.count(F.when(valid, 1)).alias("n_clusters_valid"),
        F.min(F.when(valid, F.col("size"))).alias("min_cluster_size"),
        F.max(F.when(valid, F.col("size"))).alias("max_cluster_size"),
        (F.max(F.when(valid, F.col("size"))) / F.min(F.when(valid, F.col("size")))).alias("size_imbalance_ratio"),
        F.coalesce(F.sum(F.when(~valid, F.col("size"))), F.lit(0)).alias("n_noise"),
        (F.coalesce(F.sum(F.when(~valid, F.col("size"))), F.lit(0)) / F.sum("size")).alias("noise_share"),
    )


def temporal_stability(df: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """Share of consecutive periods in which an entity keeps its label; noise is skipped.

    Consecutive means period + 1, so the next row is found by an equi-join on
    (entity, period). An entity with a very long history is spread over tasks, which a
    window over the entity would not do. One label per entity and period is expected.
    """
    clean = non_noise(df, label).select(entity, period, label)
    following = clean.select(entity, (F.col(period) - 1).alias(period), F.col(label).alias("_next"))
    moves = clean.join(following, [entity, period])
    return moves.agg(
        F.count(F.lit(1)).alias("consecutive_pairs"),
        F.coalesce(F.sum((F.col(label) == F.col("_next")).cast("long")), F.lit(0)).alias("stable_transitions"),
        F.coalesce(F.avg((F.col(label) == F.col("_next")).cast("double")), F.lit(0.0)).alias("share_stable"),
    )


def diversity(df: DataFrame, label: str, chosen, healthy_from: int = 3) -> DataFrame:
    """How the chosen rows spread over clusters: ``chosen`` is a boolean column such as ``measure > 0.7`` or a flag."""
    picked = df.filter(chosen)
    return picked.agg(
        F.count(F.lit(1)).alias("n_chosen"),
        F.countDistinct(F.when(F.col(label) != NOISE, F.col(label))).alias("n_clusters"),
    ).withColumn("healthy", F.col("n_clusters") >= healthy_from)


def diversity_counts(df: DataFrame, label: str, chosen) -> DataFrame:
    return non_noise(df.filter(chosen), label).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def measure_by_cluster(df: DataFrame, label: str, measure: str) -> DataFrame:
    return group_stats(non_noise(df, label), label, measure)


def cohort_by_cluster(df: DataFrame, label: str, cohort: str) -> DataFrame:
    return df.groupBy(label, cohort).agg(F.count(F.lit(1)).alias("n"))


def chi_square(df: DataFrame, label: str, role: str) -> DataFrame:
    """Pearson statistic and degrees of freedom of role against cluster, noise left out.

    Uses sum(observed^2 / (row total * column total)), so empty cells need no rows of their own.
    """
    cells = non_noise(df, label).groupBy(label, role).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy(label).agg(F.sum("o").alias("r"))
    columns = cells.groupBy(role).agg(F.sum("o").alias("c"))
    return cells.join(rows, label).join(columns, role).agg(
        F.sum("o").alias("_n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("_phi"),
        F.countDistinct(label).alias("_a"), F.countDistinct(role).alias("_b"),
    ).select(
        F.col("_n").cast("long").alias("n_rows"),
        (F.col("_n") * (F.col("_phi") - 1)).alias("chi_square"),
        ((F.col("_a") - 1) * (F.col("_b") - 1)).alias("dof"),
    )


def resampling_stability(
    df: DataFrame, id_col: str, clusterer: Callable[[DataFrame], DataFrame],
    n_iterations: int = 50, sample_share: float = 0.8, seed: int = 42, stable_from: float = 0.85,
) -> dict[str, object]:
    """Recluster samples drawn without replacement and compare with the full labels.

    ``clusterer`` maps a DataFrame to one with ``id_col`` and ``label``. A sample is the
    rows whose seeded hash lies below the exact quantile, so it has a fixed size and
    is the same whatever the partitioning.
    """
    full = materialise(clusterer(df).select(id_col, F.col("label").alias("_full")))
    n = full.count()
    scores = []
    for i in range(n_iterations):
        keyed = df.withColumn("_h", F.xxhash64(F.lit(seed + i), F.col(id_col)).cast("double"))
        # half a rank above the last sampled row, so rounding cannot lose it
        share = (int(n * sample_share) - 0.5) / max(n - 1, 1)
        cut = exact_quantiles(keyed, ["_h"], [share])[None]["_h"][0]
        labelled = clusterer(keyed.filter(F.col("_h") <= cut).drop("_h"))
        pair = labelled.select(id_col, F.col("label").alias("_part")).join(full, id_col)
        score = adjusted_rand(pair, "_full", "_part").first()["ari"]
        if score is not None:
            scores.append(score)
    mean = sum(scores) / len(scores) if scores else 0.0
    spread = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5 if scores else 0.0
    return {"mean_ari": mean, "std_ari": spread, "n_valid_iterations": len(scores), "stable": bool(scores) and mean > stable_from}


def quality_report(df: DataFrame, columns: Sequence[str], missing_warn: float = 0.30, outlier_z: float = 4.0) -> DataFrame:
    """Per column: nulls, null rate, rows beyond ``outlier_z`` population deviations, flag on the null rate.

    Two passes whatever the number of columns: moments first, outliers against those numbers second.
    """
    found = moments(df, columns)

    def outliers(c: str):
        m = found[c]
        if not m.std_pop:
            return F.lit(0).cast("long")
        return F.sum((F.abs((F.col(c) - F.lit(m.mean)) / F.lit(m.std_pop)) > outlier_z).cast("long"))

    rows = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.sum(F.col(c).isNull().cast("long")).alias("missing_count"),
            F.avg(F.col(c).isNull().cast("double")).alias("missing_rate"),
            F.coalesce(outliers(c), F.lit(0)).alias("outlier_count"),
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ])
    return rows.select(F.explode(F.array(*rows.columns)).alias("r")).select("r.*").withColumns({
        "flagged": F.col("missing_rate") > missing_warn, "missing_rate": F.round("missing_rate", 4),
    })


def evaluate(df: DataFrame, vector: str, label: str, flag: str | None = None, measure: str | None = None, cohort: str | None = None) -> DataFrame:
    """All grouping metrics as one nested row."""
    spark = df.sparkSession
    sizes = size_report(df, label).first()
    metrics: dict[str, object] = dict(sizes.asDict())
    if sizes["n_clusters_valid"] < 2:
        return spark.createDataFrame([(None, None, "Less than 2 valid clusters")], "silhouette_cosine double, davies_bouldin double, warning string")
    metrics["silhouette_cosine"] = silhouette(df, vector, label)
    metrics["davies_bouldin"] = davies_bouldin(df, vector, label).first()[0]
    metrics["cluster_sizes"] = {int(r[label]): int(r["size"]) for r in cluster_sizes(non_noise(df, label), label).collect()}
    fields = [
        "silhouette_cosine double", "davies_bouldin double", "n_clusters_valid bigint", "min_cluster_size bigint",
        "max_cluster_size bigint", "size_imbalance_ratio double", "n_noise bigint", "noise_share double",
        "cluster_sizes map<int,bigint>",
    ]
    if flag:
        metrics["flag_diversity"] = diversity(df, label, F.col(flag)).first()
        fields.append("flag_diversity struct<n_chosen:bigint,n_clusters:bigint,healthy:boolean>")
    if measure:
        rows = measure_by_cluster(df, label, measure).collect()
        metrics["measure_by_cluster"] = {int(r[label]): (r["mean"], r["std"], float(r["low"]), float(r["high"])) for r in rows}
        fields.append("measure_by_cluster map<int,struct<mean:double,std:double,low:double,high:double>>")
    if cohort:
        table: dict[int, dict[str, int]] = {}
        for r in cohort_by_cluster(non_noise(df, label), label, cohort).collect():
            table.setdefault(int(r[label]), {})[r[cohort]] = int(r["n"])
        metrics["cohort_by_cluster"] = table
        fields.append("cohort_by_cluster map<int,map<string,bigint>>")
    return spark.createDataFrame([tuple(metrics[f.split(" ")[0]] for f in fields)], ", ".join(fields))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    return size_ratio(non_noise(df, label), label)
