"""Questions to a finished run: one entity, two entities, similar entities."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import MISSING_PROFILE_NAME, NOISE
from profilekit.functions.scalar import same_text
from profilekit.operators.labels import label_lookup
from profilekit.operators.scale import row_profile
from profilekit.operators.search import compare_two, similar_to


def entity_profiles(
    entities: DataFrame, profiles: DataFrame, vector: str, features: list[str],
    labels: Mapping[tuple[str, str], str], label: str = "label", top_n: int = 5,
) -> DataFrame:
    """Every entity with its cluster's name, map point and top labelled features; filter it for one entity."""
    lookup = label_lookup(labels)
    named = row_profile(entities, vector, features, top_n).withColumn(
        "top_features",
        F.transform("top_features", lambda e: F.struct(
            e["feature"].alias("feature"), e["z_score"].alias("z_score"), e["direction"].alias("direction"),
            F.coalesce(
                F.element_at(lookup, F.concat_ws("|", e["feature"], e["direction"])),
                F.concat_ws("-", e["feature"], e["direction"]),
            ).alias("label"),
        )),
    )
    return named.join(profiles.select(label, F.col("name").alias("_cluster")), label, "left").withColumns({
        "cluster_name": F.coalesce("_cluster", F.lit(MISSING_PROFILE_NAME)),
        "cluster_id": F.when(F.col(label) != NOISE, F.col(label)),
    }).drop("_cluster")


def _id_of(entities: DataFrame, id_col: str, name: str) -> object:
    row = entities.filter(same_text(F.col("name"), F.lit(name))).orderBy(id_col).select(id_col).first()
    if row is None:
        raise ValueError(f"'{name}' not found")
    return row[0]


def similar_by_name(entities: DataFrame, id_col: str, vector: str, name: str, k: int = 10) -> DataFrame:
    found = similar_to(entities, id_col, vector, _id_of(entities, id_col, name), k)
    facts = entities.select(F.col(id_col).alias("item_id"), "name", "debut_period", "total_periods")
    return found.join(facts, "item_id").orderBy("rank")


def compare_by_name(entities: DataFrame, id_col: str, vector: str, a: str, b: str) -> DataFrame:
    from profilekit.functions.vector import unit

    rows = entities.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("vector"), "label")
    return compare_two(rows, _id_of(entities, id_col, a), _id_of(entities, id_col, b))
