"""Fact tables -> scaled feature vectors."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import ADJUSTED_SUFFIX, ProfileConfig, RunParams, numeric_columns, ordered_distinct, resolve_blocks, resolve_composites
from profilekit.functions.scalar import same_text
from profilekit.operators.merge import merge_facts
from profilekit.operators.profile import attach_dimension, build_profiles, varying_columns
from profilekit.operators.scale import add_composites, assemble, cohort_zscore, median_fill, robust_scale, weight_columns
from profilekit.session import materialise


@dataclass
class Features:
    """Profiles (entity, metadata, raw means), vectors and the names of their positions."""

    profiles: DataFrame
    vectors: DataFrame
    names: list[str]
    blocks: dict[str, list[str]]
    composites: list[str]


def engineer(
    facts: Sequence[DataFrame], dimension: DataFrame | None, cfg: ProfileConfig, params: RunParams, unique_keys: bool = False
) -> Features:
    """Merge, filter, average, group into blocks, score composites, adjust by cohort, impute and scale.

    The merged table and the profile table (one row per entity) are written once;
    every statistic after them reads those instead of joining the facts again.
    """
    merged = materialise(merge_facts(facts, cfg.join_keys, unique_keys))
    columns = numeric_columns(merged.schema, exclude=(cfg.entity,))
    profiles = build_profiles(merged, cfg, columns, params.min_periods)
    if dimension is not None:
        profiles = attach_dimension(profiles, dimension, cfg.entity, cfg.dimension_measures, cfg.flag)
    profiles = materialise(profiles)

    usable = varying_columns(profiles, columns)
    blocks = resolve_blocks(usable, cfg)
    groups = resolve_composites(blocks, usable, cfg)
    scored = add_composites(profiles, groups)
    chosen = ordered_distinct(c for cols in blocks.values() for c in cols) + list(groups)
    adjusted = materialise(cohort_zscore(scored, chosen, "cohort"))
    names = [c + ADJUSTED_SUFFIX for c in chosen]
    scaled = robust_scale(median_fill(adjusted, names), names, params.quantile_range)
    weighted = weight_columns(scaled, names, params.block_weights, cfg)
    meta = [
        c for c in (cfg.entity, "name", "primary_role", "debut_period", "final_period", "total_periods", "cohort",
                    *cfg.dimension_measures, cfg.flag) if c and c in weighted.columns
    ]
    vectors = materialise(assemble(weighted, names).select(*meta, "features"))
    return Features(adjusted.drop(*names), vectors, names, blocks, list(groups))


def find_entity(vectors: DataFrame, name: str) -> DataFrame:
    """Rows of one name, whatever its case."""
    return vectors.filter(same_text(F.col("name"), F.lit(name)))
