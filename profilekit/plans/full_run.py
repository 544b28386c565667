"""The batch run: features, components, clusterings, consensus, labels, evaluation, exports."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import NOISE, ProfileConfig, RunParams
from profilekit.operators.cluster import kmeans, passes_gate, ward
from profilekit.operators.consensus import consensus_labels, consensus_report, drop_low_consensus
from profilekit.operators.density import density_clusters
from profilekit.operators.labels import cluster_profiles, cluster_summary
from profilekit.operators.quality import evaluate, quality_report
from profilekit.operators.reduce import Components, component_report, fit_components, map_points, project
from profilekit.operators.search import similarity_edges
from profilekit.plans.features import Features, engineer
from profilekit.session import materialise
from profilekit.sources.tables import write_edges, write_nested, write_points


@dataclass
class Run:
    """Everything one run produced."""

    features: Features
    quality: DataFrame
    components: Components
    component_table: DataFrame
    entities: DataFrame
    ensemble: list[str]
    consensus: DataFrame
    similarity: DataFrame
    profiles: DataFrame
    summary: DataFrame
    evaluation: DataFrame


def cluster_entities(df: DataFrame, id_col: str, params: RunParams, vector: str = "pca") -> tuple[DataFrame, list[str]]:
    """Density, hierarchical and k-means labels plus their consensus in ``label``.

    The density labels take part only when they pass the gate.
    """
    labelled, _ = kmeans(df, vector, params.n_clusters, params.seed, out="kmeans_label")
    labelled = ward(labelled, vector, params.n_clusters, params.micro_clusters, params.seed, out="ward_label")
    members = ["ward_label", "kmeans_label"]
    if params.use_density:
        dense = density_clusters(
            df, id_col, vector, params.min_cluster_size, params.min_samples, max_dims=10, out="density_label"
        ).select(id_col, "density_label")
        labelled = materialise(labelled.join(dense, id_col))
        if passes_gate(labelled, "density_label"):
            members = ["density_label", *members]
    labelled = materialise(labelled)
    agreed = consensus_labels(labelled, members, params.n_clusters)
    return materialise(drop_low_consensus(agreed, members, "consensus", params.min_consensus)), members


def run(facts: Sequence[DataFrame], dimension: DataFrame | None, cfg: ProfileConfig, params: RunParams | None = None) -> Run:
    params = params or RunParams()
    features = engineer(facts, dimension, cfg, params)
    raw = [c for cols in features.blocks.values() for c in cols]
    quality = quality_report(features.profiles, list(dict.fromkeys(raw)), params.missing_rate_warn, params.outlier_z)

    components = fit_components(features.vectors, "features", params.pca_variance)
    reduced = materialise(map_points(project(features.vectors, "features", components)))
    entities, ensemble = cluster_entities(reduced, cfg.entity, params)

    flag = cfg.flag if cfg.flag in entities.columns else None
    prepared = entities.withColumns({
        "role": F.col("primary_role"), "flag": F.col(flag) if flag else F.lit(False),
    })
    profiles = materialise(cluster_profiles(
        prepared, cfg.entity, "features", "label", features.names, cfg.labels, cfg.label_priority,
        measures=[m for m in cfg.dimension_measures if m in entities.columns], top_n=params.top_n_features,
    ))
    return Run(
        features=features,
        quality=quality,
        components=components,
        component_table=component_report(entities.sparkSession, components),
        entities=entities,
        ensemble=ensemble,
        consensus=consensus_report(entities, ensemble, "label"),
        similarity=similarity_edges(entities, cfg.entity, "pca", params.neighbours),
        profiles=profiles,
        summary=cluster_summary(profiles, prepared, "label", cfg.display_names),
        evaluation=evaluate(entities, "pca", "label", flag=flag, cohort="cohort"),
    )


def save(result: Run, folder: str) -> None:
    """Write the run's tables and nested documents."""
    folder = folder.rstrip("/")
    write_points(result.entities, f"{folder}/entities")
    write_nested(result.profiles, f"{folder}/cluster_profiles")
    write_nested(result.evaluation, f"{folder}/evaluation")
    write_edges(result.similarity, f"{folder}/similarity")


def noise_share(result: Run) -> float:
    return result.entities.agg(F.avg((F.col("label") == NOISE).cast("double"))).first()[0]
