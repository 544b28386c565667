"""Driver-side names and parameters: nothing in this module touches data."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Iterable, Mapping, Sequence

from pyspark.sql import types as T

ADJUSTED_SUFFIX = "_era_adj"
NOISE = -1
UNKNOWN_COHORT = "Unknown"
UNKNOWN_ROLE = "UNK"
NOISE_NAME = "Hybrid / Transitional"
MISSING_PROFILE_NAME = "Hybrid/Transitional"


# ---------------------------------------------------------------- parameters

@dataclass(frozen=True)
class RunParams:
    """Parameters of one run; a bad value fails here, before any job starts."""

    n_clusters: int = 12
    pca_variance: float = 0.90
    min_periods: int = 5
    min_cluster_size: int = 25
    min_samples: int = 3
    use_density: bool = True
    min_consensus: float = 0.5
    top_n_features: int = 4
    neighbours: int = 49
    micro_clusters: int = 200
    quantile_range: tuple[float, float] = (5.0, 95.0)
    block_weights: Mapping[str, float] = field(default_factory=dict)
    missing_rate_warn: float = 0.30
    outlier_z: float = 4.0
    seed: int = 42

    def __post_init__(self) -> None:
        problems = []
        if not 2 <= self.n_clusters <= 50:
            problems.append("n_clusters must lie in 2..50")
        if not 0.50 < self.pca_variance <= 0.99:
            problems.append("pca_variance must lie in (0.50, 0.99]")
        if not 1 <= self.min_periods <= 30:
            problems.append("min_periods must lie in 1..30")
        if not self.n_clusters <= self.micro_clusters <= 1_000:
            problems.append("micro_clusters must lie between n_clusters and 1000")
        if self.min_cluster_size < 5:
            problems.append("min_cluster_size must be at least 5")
        if self.seed < 0:
            problems.append("seed must not be negative")
        if problems:
            raise ValueError("; ".join(problems))


def config_hash(*parts: object) -> str:
    """First 12 hex digits of the md5 of all parameters, written as sorted JSON."""

    def plain(value: object) -> object:
        return asdict(value) if hasattr(value, "__dataclass_fields__") else value

    text = json.dumps([plain(p) for p in parts], sort_keys=True, default=str)
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:12]


# ------------------------------------------------------------------- columns

def numeric_columns(schema: T.StructType, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def ordered_distinct(items: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(items))


def find_columns(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Columns that contain any pattern, ordered by pattern and then by column."""
    return ordered_distinct(c for p in patterns for c in columns if p.lower() in c.lower())


def base_name(feature: str) -> str:
    return feature.replace(ADJUSTED_SUFFIX, "")


@dataclass(frozen=True)
class BlockRule:
    """How one semantic block picks its columns.

    ``exact`` takes the listed names as they are; otherwise they are substrings.
    ``merge_variants`` leaves out columns that the concept map calls a variant
    of another column.
    """

    patterns: tuple[str, ...]
    exact: bool = False
    merge_variants: bool = True


@dataclass(frozen=True)
class CompositeRule:
    """A composite score: the mean z-score over columns of some blocks."""

    blocks: tuple[str, ...]
    contains: tuple[str, ...] = ()
    also: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSpec:
    """One input table.

    ``types`` gives the SQL type of a column as the file calls it; other columns of a CSV take ``other``. ``missing`` is the
    text that stands for no value, besides an empty field.
    """

    name: str
    file: str
    required: tuple[str, ...]
    min_rows: int = 0
    rename: Mapping[str, str] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    other: str = "double"
    missing: str = "NA"


@dataclass(frozen=True)
class ProfileConfig:
    """Everything that ties the operators to one domain."""

    entity: str
    period: str
    name: str
    role: str
    context_keys: tuple[str, ...] = ()
    fact_tables: tuple[TableSpec, ...] = ()
    dimension: TableSpec | None = None
    dimension_measures: tuple[str, ...] = ()
    flag: str | None = None
    cohorts: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    blocks: Mapping[str, BlockRule] = field(default_factory=dict)
    concept_variants: Mapping[str, str] = field(default_factory=dict)
    composites: Mapping[str, CompositeRule] = field(default_factory=dict)
    weight_rules: tuple[tuple[str, tuple[str, ...]], ...] = ()
    search_blocks: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    labels: Mapping[tuple[str, str], str] = field(default_factory=dict)
    label_priority: tuple[str, ...] = ()
    display_names: Mapping[int, str] = field(default_factory=dict)
    roles: tuple[str, ...] = ()
    radar: tuple[str, ...] = ()
    required_after_mean: tuple[str, ...] = ()

    @property
    def join_keys(self) -> tuple[str, ...]:
        return (self.period, self.entity, *self.context_keys)


def resolve_blocks(columns: Sequence[str], cfg: ProfileConfig) -> dict[str, list[str]]:
    """Block name -> feature columns, found once from the column names."""
    out: dict[str, list[str]] = {}
    for block, rule in cfg.blocks.items():
        if rule.exact:
            out[block] = [p for p in rule.patterns if p in columns]
            continue
        found = find_columns(columns, rule.patterns)
        out[block] = [c for c in found if not (rule.merge_variants and c in cfg.concept_variants)]
    return out


def resolve_composites(blocks: Mapping[str, Sequence[str]], columns: Sequence[str], cfg: ProfileConfig) -> dict[str, list[str]]:
    """Composite name -> the columns whose z-scores it averages."""
    out: dict[str, list[str]] = {}
    for name, rule in cfg.composites.items():
        pool = ordered_distinct([c for b in rule.blocks for c in blocks.get(b, ())] + list(rule.also))
        out[name] = [
            c for c in pool
            if c in columns and (not rule.contains or any(k in c.lower() for k in rule.contains))
        ]
    return out


def weight_block(feature: str, cfg: ProfileConfig) -> str:
    """The block whose weight a feature takes: the first matching rule wins."""
    base = base_name(feature)
    for block, patterns in cfg.weight_rules:
        if any(p in base for p in patterns):
            return block
    return "default"


def block_positions(features: Sequence[str], patterns: Mapping[str, Sequence[str]], match: str = "substring") -> dict[str, list[int]]:
    """Search block -> positions in the vector. A feature may belong to several blocks."""
    out: dict[str, list[int]] = {}
    for block, pats in patterns.items():
        lowered = [p.lower() for p in pats]

        def hit(feature: str) -> bool:
            base = base_name(feature).lower()
            return base in lowered if match == "exact" else any(p in base for p in lowered)

        positions = [i for i, f in enumerate(features) if hit(f)]
        if positions:
            out[block] = positions
    return out


# ------------------------------------------------------------------ manifest

MANIFEST_TYPES = {
    "version": str,
    "feature_names": list,
    "n_vectors": int,
    "dimension": int,
}


def check_manifest(manifest: Mapping[str, object]) -> None:
    """Fail loudly when an index manifest lacks a key or holds a wrong type."""
    for key, kind in MANIFEST_TYPES.items():
        if key not in manifest:
            raise ValueError(f"index manifest lacks '{key}'")
        if not isinstance(manifest[key], kind):
            raise ValueError(f"index manifest: '{key}' must be {kind.__name__}")
    if len(manifest["feature_names"]) != manifest["dimension"]:
        raise ValueError("index manifest: one feature name per dimension expected")
