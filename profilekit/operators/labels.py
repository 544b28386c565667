"""Cluster profiles, names, exemplars and read models."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.config import ADJUSTED_SUFFIX, NOISE
from profilekit.functions.scalar import direction, join_words, readable_traits
from profilekit.functions.vector import euclidean
from profilekit.operators.relational import number_rows, top_per_group, value_counts
from profilekit.operators.scale import vector_moments
from profilekit.session import materialise


def non_noise(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label) != NOISE)


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector and size per label; one aggregation buffer per label and map task."""
    return (
        df.select(label, array_to_vector(F.col(vector)).alias("_v")).groupBy(label)
        .agg(F.count(F.lit(1)).alias("size"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))
    )


def _texts(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def cluster_zscores(df: DataFrame, vector: str, label: str, features: Sequence[str]) -> DataFrame:
    """Per cluster the z-score of each feature's mean against all rows, noise included in the global figures."""
    found = vector_moments(df, vector, len(features))
    names = _texts([f.replace(ADJUSTED_SUFFIX, "") for f in features])
    means = F.array(*[F.lit(m.mean) for m in found])
    spreads = F.array(*[F.lit(m.std_pop + 1e-8) for m in found])
    z = F.transform(F.col("centroid"), lambda x, i: (x - F.get(means, i)) / F.get(spreads, i))
    return (
        centroids(non_noise(df, label), vector, label)
        .withColumn("z_scores", F.map_from_arrays(names, z))
        .select(label, "size", "z_scores")
    )


def rank_features(z_scores: Column, priority: Sequence[str], top_n: int) -> Column:
    """The ``top_n`` features by size of z; equal sizes go by label priority, then by position."""
    order = _texts(priority) if priority else F.array().cast("array<string>")

    def entry(e: Column, i: Column) -> Column:
        at = F.array_position(order, e["key"])
        return F.struct(
            (-F.round(F.abs(e["value"]), 9)).alias("order"),
            F.when(at > 0, at - 1).otherwise(F.lit(999)).cast("long").alias("priority"),
            i.alias("position"),
            e["key"].alias("feature"),
            e["value"].alias("z"),
        )

    ranked = F.array_sort(F.transform(F.map_entries(z_scores), entry))
    return F.slice(ranked, 1, top_n) if top_n else ranked


def label_lookup(labels: Mapping[tuple[str, str], str]) -> Column:
    """The configured (feature, direction) table as a literal map."""
    if not labels:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for (f, d), text in labels.items() for x in (f"{f}|{d}", text)])


def name_clusters(profiles: DataFrame, label: str, labels: Mapping[tuple[str, str], str], priority: Sequence[str] = (), top_n: int = 4) -> DataFrame:
    """Add ``top_features`` and the generated ``name``."""
    lookup = label_lookup(labels)

    def describe(e: Column) -> Column:
        way = direction(e["z"])
        text = F.coalesce(
            F.element_at(lookup, F.concat_ws("|", e["feature"], way)), F.concat_ws("-", e["feature"], way)
        )
        return F.struct(
            e["feature"].alias("feature"), F.round(e["z"], 3).alias("z_score"), way.alias("direction"), text.alias("label")
        )

    top = F.transform(rank_features(F.col("z_scores"), priority, top_n), describe)
    words = join_words(F.array_distinct(F.transform(F.col("top_features"), lambda e: e["label"])))
    return profiles.withColumn("top_features", top).withColumn(
        "name", F.when(words != "", words).otherwise(F.concat(F.lit("Archetype-"), F.col(label)))
    )


def exemplars(df: DataFrame, id_col: str, vector: str, label: str, k: int = 8) -> DataFrame:
    """The ``k`` members nearest their cluster's centroid."""
    members = non_noise(df, label)
    # written once: its true size lets Spark broadcast it instead of shuffling the members by cluster
    centre = materialise(centroids(members, vector, label).select(label, "centroid"))
    far = members.join(centre, label).withColumn("distance", euclidean(F.col(vector), F.col("centroid"))).drop("centroid")
    return top_per_group(far, [label], [F.round("distance", 9), F.col(id_col)], k)


def example_members(df: DataFrame, label: str, flag: str, total: str, name: str, k: int = 3) -> DataFrame:
    """Flagged members first, then the longest, then by name."""
    return top_per_group(df, [label], [F.col(flag).cast("int").desc(), F.col(total).desc(), F.col(name)], k)


def ranked_list(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Ranked rows (a few per group) -> one ordered list per group."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("_v"))))
    return df.groupBy(by).agg(F.transform(pairs, lambda e: e["_v"]).alias(out))


def cluster_profiles(
    df: DataFrame, id_col: str, vector: str, label: str, features: Sequence[str],
    labels: Mapping[tuple[str, str], str], priority: Sequence[str] = (), name: str = "name", role: str = "role",
    flag: str = "flag", measures: Sequence[str] = (), top_n: int = 4,
) -> DataFrame:
    """One nested row per cluster: name, size, features, z-scores, exemplars, roles, flag counts, mean measures."""
    named = name_clusters(cluster_zscores(df, vector, label, features), label, labels, priority, top_n)
    members = non_noise(df, label)
    facts = members.groupBy(label).agg(
        F.sum(F.col(flag).cast("long")).alias("flag_count"),
        F.round(F.avg(F.col(flag).cast("double")), 3).alias("flag_rate"),
        *[F.round(F.avg(m), 1).alias(f"avg_{m}") for m in measures],
    )
    nearest_names = ranked_list(exemplars(df, id_col, vector, label), label, name, "exemplars")
    roles = value_counts(members, label, role, "role_counts")
    return reduce(lambda a, b: a.join(b, label, "left"), [named, nearest_names, roles, facts])


def compare_clusters(profiles: DataFrame, label: str, a: int, b: int, k: int = 8) -> DataFrame:
    """Features in which two clusters differ most."""
    def side(cluster: int, out: str) -> DataFrame:
        return profiles.filter(F.col(label) == cluster).select(F.explode("z_scores").alias("feature", out))

    gap = F.abs(F.col("z_a") - F.col("z_b"))
    return side(a, "z_a").join(side(b, "z_b"), "feature").withColumn("divergence", gap).orderBy(
        F.round("divergence", 9).desc(), "feature"
    ).limit(k)


def cluster_summary(
    profiles: DataFrame, members: DataFrame, label: str, display_names: Mapping[int, str],
    name: str = "name", flag: str = "flag", total: str = "total_periods", noise_text: str = "Rows without a dense cluster",
) -> DataFrame:
    """Read model: display name, traits, description, examples and size per cluster, noise as its own row."""
    spark = profiles.sparkSession
    examples = ranked_list(example_members(members, label, flag, total, name), label, name, "examples")
    traits = readable_traits(F.transform(F.col("top_features"), lambda e: e["label"]))
    rows = profiles.select(
        label, F.col("name").alias("generated"), "size", traits.alias("traits")
    ).withColumn("description", F.when(F.size("traits") > 0, join_words(F.col("traits"), " · ")).otherwise(F.col("generated")))
    noise = members.filter(F.col(label) == NOISE).groupBy(label).agg(F.count(F.lit(1)).alias("size")).select(
        label, F.lit("Unclassified").alias("generated"), "size",
        F.array(F.lit("Outlier"), F.lit("Hybrid Profile")).alias("traits"), F.lit(noise_text).alias("description"),
    )
    noise = noise.join(profiles.select(label), label, "left_anti")
    curated = spark.createDataFrame([(int(c), n) for c, n in display_names.items()], f"{label} int, display string") if display_names else None
    out = rows.unionByName(noise)
    out = out.join(F.broadcast(curated), label, "left") if curated is not None else out.withColumn("display", F.lit(None).cast("string"))
    return out.join(examples, label, "left").select(
        label, F.coalesce("display", "generated").alias("name"), "size", "description", "traits", "examples"
    )


def size_order(df: DataFrame, label: str, size: str = "size") -> DataFrame:
    """All clusters with their ``position``: largest first, noise last."""
    return number_rows(df, [(F.col(label) == NOISE).cast("int"), F.col(size).desc(), F.col(label)], "position")


def with_defaults(neighbours: DataFrame, points: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join that gives rows without a match the configured defaults."""
    joined = neighbours.join(points.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
