"""Small Column functions: text, directions, buckets, keys."""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilekit.config import ADJUSTED_SUFFIX, UNKNOWN_COHORT


def same_text(a: Column, b: Column) -> Column:
    """Case-insensitive equality."""
    return F.lower(a) == F.lower(b)


def starts_with_text(text: Column, prefix: Column) -> Column:
    return F.startswith(F.lower(text), F.lower(prefix))


def contains_text(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def strip_suffix(text: Column, suffix_pattern: str) -> Column:
    """Remove a trailing pattern, whatever its case."""
    return F.regexp_replace(text, f"(?i){suffix_pattern}$", "")


def replace_part(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def feature_base(name: Column) -> Column:
    return replace_part(name, ADJUSTED_SUFFIX, "")


def direction(z: Column) -> Column:
    """``high`` above zero, otherwise ``low``."""
    return F.when(z > 0, F.lit("high")).otherwise(F.lit("low"))


def join_words(words: Column, separator: str = " • ") -> Column:
    return F.array_join(words, separator)


def readable_traits(labels: Column, limit: int = 4) -> Column:
    """Labels without an underscore, distinct in their order, the first ``limit``."""
    kept = F.filter(labels, lambda x: x.isNotNull() & (x != "") & ~F.contains(x, F.lit("_")))
    return F.slice(F.array_distinct(kept), 1, limit)


def score_bucket(score: Column) -> Column:
    """Edge strength of a similarity score."""
    return F.when(score >= 0.9, "strong").when(score >= 0.8, "medium").otherwise("weak")


def share_percent(contribution: Column) -> Column:
    """Size of an attribution bar: percent, at most 100."""
    return F.least(F.abs(contribution) * 100, F.lit(100.0))


def whole_percent(score: Column) -> Column:
    return F.round(score * 100, 0)


def cohort_of(period: Column, cohorts: Mapping[str, tuple[int, int]]) -> Column:
    """Cohort name by inclusive period ranges."""
    out = None
    for name, (low, high) in cohorts.items():
        hit = period.between(low, high)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(UNKNOWN_COHORT) if out is None else out.otherwise(F.lit(UNKNOWN_COHORT))


def text_flag(text: Column) -> Column:
    """Boolean written as text: true, 1 or yes."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))


def number_or_null(value: Column) -> Column:
    """NaN means missing: Spark aggregates skip nulls only."""
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def request_key(fields: Iterable[tuple[str, Column]]) -> Column:
    """md5 over the named request fields in name order."""
    ordered = sorted(fields, key=lambda kv: kv[0])
    return F.md5(F.to_json(F.struct(*[c.alias(n) for n, c in ordered]), {"ignoreNullFields": "false"}))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def allowed_url(url: Column, hosts: Iterable[str]) -> Column:
    """https, a listed host and a path that is not empty; false for anything else."""
    path = F.try_parse_url(url, F.lit("PATH"))
    ok = (
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https")
        & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*[h.lower() for h in hosts])
        & (F.length(path) > 0)
    )
    return F.coalesce(ok, F.lit(False))
