"""The numbers behind each chart."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import MISSING_PROFILE_NAME, NOISE, NOISE_NAME
from profilekit.operators.labels import non_noise
from profilekit.operators.relational import role_shares


def map_mart(points: DataFrame, profiles: DataFrame, label: str) -> DataFrame:
    """Map points with their cluster's name; noise and clusters without a profile get fixed names."""
    named = points.join(profiles.select(label, F.col("name").alias("_n")), label, "left")
    return named.withColumn(
        "cluster_name",
        F.when(F.col(label) == NOISE, F.lit(NOISE_NAME)).otherwise(F.coalesce("_n", F.lit(MISSING_PROFILE_NAME))),
    ).drop("_n")


def radar_mart(profiles: DataFrame, label: str, dimensions: Sequence[str]) -> DataFrame:
    """One row per cluster and radar dimension, 0 where a cluster lacks it."""
    wanted = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(d).alias("dimension")) for i, d in enumerate(dimensions)])
    return profiles.select(label, "z_scores", F.explode(wanted).alias("d")).select(
        label, "d.position", "d.dimension", F.coalesce(F.element_at("z_scores", F.col("d.dimension")), F.lit(0.0)).alias("value")
    )


def size_mart(profiles: DataFrame, members: DataFrame, label: str) -> DataFrame:
    """Cluster sizes with names, the noise rows as a line of their own."""
    noise = members.filter(F.col(label) == NOISE).groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    return profiles.select(label, "name", "size").unionByName(noise.select(label, F.lit(NOISE_NAME).alias("name"), "size"))


def role_share_mart(members: DataFrame, label: str, role: str, roles: Sequence[str]) -> DataFrame:
    return role_shares(non_noise(members, label), label, role, roles)


def flag_rate_mart(members: DataFrame, label: str, flag: str) -> DataFrame:
    return non_noise(members, label).groupBy(label).agg(
        F.sum(F.col(flag).cast("long")).alias("flag_count"), F.round(F.avg(F.col(flag).cast("double")), 3).alias("flag_rate")
    )


def top_feature_mart(profiles: DataFrame, label: str, n: int = 5) -> DataFrame:
    """The first ``n`` top features of each cluster as rows."""
    return profiles.select(label, F.posexplode(F.slice("top_features", 1, n)).alias("position", "f")).select(label, "position", "f.*")
