"""Similarity search: candidates, hybrid re-ranking, attribution, lookups by name."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from profilekit.functions.scalar import contains_text, starts_with_text
from profilekit.functions.vector import TINY, as_double, dot, norm, to_matrix, top_contributions, unit, well_formed
from profilekit.operators.nearest import QUERY_LIMITS, nearest
from profilekit.operators.relational import first_per_key, top_per_group
from profilekit.session import materialise

METADATA = ("role", "flag", "debut_period", "final_period", "total_periods")


@dataclass(frozen=True)
class Scoring:
    """Weights of the hybrid score and the vector positions of each block."""

    blocks: Mapping[str, Sequence[int]]
    alpha: float = 0.60
    beta: float = 0.35
    gamma: float = 0.05
    block_weights: Mapping[str, float] = field(default_factory=dict)

    def weight(self, block: str) -> float:
        return float(self.block_weights.get(block, 1.0))


# -------------------------------------------------------------- similarities

def _as_sides(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    items = df.select(F.col(id_col).alias("item_id"), unit(as_double(F.col(vector))).alias("item_vec"))
    return items.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"}), items


def knn_graph(df: DataFrame, id_col: str, vector: str, k: int = 49, **kwargs) -> DataFrame:
    """Cosine neighbours of every row: ``(src, dst, score, rank)``; approximate with ``cells=`` a stored cell index."""
    queries, items = _as_sides(df, id_col, vector)
    return nearest(queries, items, k, **kwargs).withColumnsRenamed({"query_id": "src", "item_id": "dst"})


def similarity_edges(df: DataFrame, id_col: str, vector: str, k: int = 49, min_score: float | None = None) -> DataFrame:
    """The similarity matrix as edges: the nearest ``k`` rows of every row, whatever the number of rows."""
    edges = knn_graph(df, id_col, vector, k)
    return edges if min_score is None else edges_above(edges, min_score)


def edges_above(edges: DataFrame, score: float) -> DataFrame:
    return edges.filter(F.col("score") >= score)


def similar_to(df: DataFrame, id_col: str, vector: str, entity: object, k: int = 10, different: str | None = None) -> DataFrame:
    """Top-k rows most similar to one entity, optionally only those of a different group."""
    wanted = df.filter(F.col(id_col) == F.lit(entity))
    others = df
    if different:
        own = wanted.select(different).first()
        if own is not None:
            others = df.filter(~F.col(different).eqNullSafe(F.lit(own[0])))
    queries, _ = _as_sides(wanted, id_col, vector)
    _, items = _as_sides(others, id_col, vector)
    return nearest(queries, items, k)


# ------------------------------------------------------------- hybrid scoring

def same_role(query_role: Column, candidate_role: Column) -> Column:
    """1.0 when both roles are given and equal."""
    hit = (query_role != "") & (candidate_role != "") & (query_role == candidate_role)
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def _block_scores(scoring: Scoring):
    names = list(scoring.blocks)
    positions = [np.asarray(scoring.blocks[n]) for n in names]
    weights = np.array([scoring.weight(n) for n in names])

    @arrow_udf("struct<cosine:double, contributions:array<double>>")
    def score(query: pa.Array, candidate: pa.Array) -> pa.Array:
        if len(query) == 0:
            return pa.array([], pa.struct([("cosine", pa.float64()), ("contributions", pa.list_(pa.float64()))]))
        q, c = to_matrix(query), to_matrix(candidate)
        parts = []
        for at, w in zip(positions, weights):
            qb, cb = q[:, at], c[:, at]
            qb = qb / (np.linalg.norm(qb, axis=1, keepdims=True) + TINY)
            cb = cb / (np.linalg.norm(cb, axis=1, keepdims=True) + TINY)
            parts.append(w * (qb * cb).sum(axis=1))
        flat = np.stack(parts, axis=1).ravel() if parts else np.zeros(0)
        offsets = np.arange(len(q) + 1, dtype=np.int32) * len(parts)
        return pa.StructArray.from_arrays(
            [pa.array((q * c).sum(axis=1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["cosine", "contributions"],
        )

    return score, names, float(weights.sum())


def add_hybrid_score(pairs: DataFrame, scoring: Scoring) -> DataFrame:
    """Score pairs that carry ``query_vec, candidate_vec, query_role, candidate_role``.

    Adds ``cosine, block_sim, role_bonus, hybrid`` and each block's weighted contribution.
    """
    score, names, total = _block_scores(scoring)
    scored = pairs.withColumn("_s", score("query_vec", "candidate_vec"))
    parts = F.col("_s.contributions")
    weighted = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return (
        scored.withColumns({
            "cosine": F.col("_s.cosine"),
            "block_sim": weighted / F.lit(total) if total > 0 else F.lit(0.0),
            "role_bonus": same_role(F.col("query_role"), F.col("candidate_role")),
            "block_contributions": F.map_from_arrays(F.array(*[F.lit(n) for n in names]).cast("array<string>"), parts),
        })
        .withColumn(
            "hybrid",
            F.lit(scoring.alpha) * F.col("cosine") + F.lit(scoring.beta) * F.col("block_sim")
            + F.lit(scoring.gamma) * F.col("role_bonus"),
        )
        .drop("_s")
    )


# ----------------------------------------------------------------- searching

def search(
    requests: DataFrame,
    index: DataFrame,
    scoring: Scoring,
    k: int = 10,
    mode: str = "post",
    fetch: int | None = None,
    pool: int | None = None,
    features: Sequence[str] | None = None,
    attributions: int = 5,
    **kwargs,
) -> DataFrame:
    """Answer many search requests at once.

    ``index``: ``id, vector`` (unit length) and optionally ``name, role, period, flag, ...``.
    ``requests``: ``query_id`` and optionally ``want_role, min_period, max_period``.

    * no limits: the k + 1 nearest others, re-ranked by the hybrid score, first k;
    * ``mode="post"`` with limits: the 5k nearest others, those within the limits,
      the first 2k of them by cosine, re-ranked, first k - possibly fewer than k;
    * ``mode="pre"``: the limits apply before the top-k, so k results are found
      whenever they exist.

    With ``cells=`` a stored cell index of the same rows the candidates are approximate.
    """
    limits = [c for c in QUERY_LIMITS if c in requests.columns]
    filtered = bool(limits)
    if fetch is None:
        fetch = 5 * k if filtered and mode == "post" else (2 * k if filtered else k + 1)
    pool = pool if pool is not None else (2 * k if filtered else fetch)
    own = index.select(
        F.col("id").alias("query_id"), F.col("vector").alias("query_vec"),
        (F.col("role") if "role" in index.columns else F.lit("")).alias("query_role"),
    )
    queries = requests.join(own, "query_id")
    items = index.select(
        F.col("id").alias("item_id"), F.col("vector").alias("item_vec"), *[c for c in ("role", "period") if c in index.columns]
    )
    asked = queries.select("query_id", "query_vec", *(limits if mode == "pre" else []))
    found = nearest(asked, items if mode == "pre" else items.select("item_id", "item_vec"), fetch, **kwargs)
    kept = [c for c in ("name", "role", "period", *METADATA) if c in index.columns]
    facts = index.select(
        F.col("id").alias("item_id"), F.col("vector").alias("candidate_vec"),
        *[F.col(c).alias(f"candidate_{c}") for c in dict.fromkeys(kept)],
    )
    pairs = found.withColumnRenamed("rank", "cosine_rank").join(facts, "item_id").join(queries, "query_id")
    if "candidate_role" not in pairs.columns:
        pairs = pairs.withColumn("candidate_role", F.lit(""))
    if filtered and mode == "post":
        pairs = pairs.filter(within_limits(limits))
        pairs = top_per_group(pairs, ["query_id"], [F.col("score").desc(), F.col("item_id")], pool, "_pool").drop("_pool")
    ranked = top_per_group(
        add_hybrid_score(pairs, scoring), ["query_id"], [F.round("hybrid", 9).desc(), F.col("item_id")], k
    )
    if attributions:
        ranked = ranked.withColumn(
            "attributions", top_contributions(F.col("query_vec"), F.col("candidate_vec"), features, attributions)
        )
    return ranked.drop("query_vec", "candidate_vec", "score", "cosine_rank", *limits)


def response(results: DataFrame, version: str | None = None) -> DataFrame:
    """What a user sees of search results: ids, name, scores, rank and the public metadata."""
    public = [c for c in METADATA if f"candidate_{c}" in results.columns]
    optional = [c for c in ("attributions",) if c in results.columns]
    name = F.col("candidate_name") if "candidate_name" in results.columns else F.lit("Unknown")
    return results.select(
        "query_id", F.col("item_id").alias("entity_id"), F.coalesce(name, F.lit("Unknown")).alias("entity_name"),
        F.col("hybrid").alias("score"), F.col("cosine").alias("cosine_similarity"), "rank",
        F.struct(*[F.col(f"candidate_{c}").alias(c) for c in public]).alias("metadata") if public else F.lit(None).cast("string").alias("metadata"),
        *optional, F.lit(version).cast("string").alias("index_version"),
    )


def within_limits(limits: Sequence[str]) -> Column:
    """Metadata predicate of a request on a candidate."""
    tests = {
        "want_role": lambda: F.col("want_role").isNull() | (F.col("candidate_role") == F.col("want_role")),
        "min_period": lambda: F.col("min_period").isNull() | (F.col("candidate_period") >= F.col("min_period")),
        "max_period": lambda: F.col("max_period").isNull() | (F.col("candidate_period") <= F.col("max_period")),
    }
    out = F.lit(True)
    for name in limits:
        out = out & F.coalesce(tests[name](), F.lit(False))
    return out


def split_vectors(queries: DataFrame, vector: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Usable query vectors and the rejected rest."""
    ok = well_formed(F.col(vector), dimension)
    return queries.filter(ok), queries.filter(~ok)


def search_vectors(
    queries: DataFrame, index: DataFrame, dimension: int, k: int = 10, normalise: bool = True,
    features: Sequence[str] | None = None, attributions: int = 5, **kwargs,
) -> DataFrame:
    """Top-k for raw query vectors ``(query_id, vector)``: inner product, no self-exclusion, no re-ranking."""
    good, _ = split_vectors(queries, "vector", dimension)
    raw = as_double(F.col("vector"))
    asked = good.select("query_id", unit(raw).alias("query_vec"), (F.lit(1.0) if normalise else norm(raw)).alias("_scale"))
    items = index.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    found = nearest(asked.drop("_scale"), items, k, exclude_self=False, **kwargs)
    out = found.join(asked, "query_id")
    if attributions:
        facts = items.withColumnRenamed("item_vec", "candidate_vec")
        scaled = F.transform(F.col("query_vec"), lambda x: x * F.col("_scale"))
        out = out.join(facts, "item_id").withColumn(
            "attributions", top_contributions(scaled, F.col("candidate_vec"), features, attributions)
        ).drop("candidate_vec")
    return out.withColumn("score", F.col("score") * F.col("_scale")).drop("query_vec", "_scale")


# -------------------------------------------------------------------- lookup

def resolve(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Query text -> entity: exact id, then exact name, then the first name by prefix; misses give null.

    ``queries``: ``query``; ``entities``: ``id`` (string), ``name``. All three steps are
    equi-joins, so no query meets every name.
    """
    asked = queries.select("query", F.trim("query").alias("_q")).filter(F.length("_q") > 0).distinct()
    asked = asked.withColumn("_low", F.lower("_q"))
    known = entities.select("id", "name", F.lower(F.trim("name")).alias("_name"))
    by_id = asked.join(known, F.col("_q") == F.col("id")).select("query", "id", "name", "_name", F.lit(1).alias("step"))
    by_name = (
        asked.join(known.groupBy("_name").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id")), F.col("_low") == F.col("_name"))
        .select("query", "id", "name", "_name", F.lit(2).alias("step"))
    )
    by_prefix = _prefix_matches(asked, known).select("query", "id", "name", "_name", F.lit(3).alias("step"))
    best = first_per_key(
        by_id.unionByName(by_name).unionByName(by_prefix), ["query"], [F.col("step"), F.col("_name"), F.col("id")]
    )
    return queries.select("query").distinct().join(best.select("query", "id", "name", "step"), "query", "left")


def _prefix_matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The first name, in name order, that starts with each query.

    A name is cut at the lengths that queries have, of which there are no more than characters in the longest name; cuts
    that nobody asked for go at once, and the smallest name per prefix is an aggregate, so the join is an equality of
    prefixes with one row per prefix.
    """
    longest = known.agg(F.max(F.length("_name"))).first()[0] or 0
    wanted = asked.filter(F.length("_low") <= longest)
    lengths = sorted(r[0] for r in wanted.select(F.length("_low")).distinct().collect())
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_name"))
    cut = known.withColumn("_len", F.explode(cuts)).withColumn("_prefix", F.expr("substring(_name, 1, _len)"))
    # Prefixes nobody asked for go before anything is sorted or moved.
    cut = cut.join(wanted.select(F.col("_low").alias("_prefix")).distinct(), "_prefix", "left_semi")
    first = cut.groupBy("_prefix").agg(F.min(F.struct("_name", "id", "name")).alias("_hit"))
    return wanted.join(first, F.col("_low") == F.col("_prefix")).select("query", "_hit.id", "_hit.name", "_hit._name")


def suggest(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Names that start with the query, in name order; only when there are none, names that contain it."""
    text = query.strip().lower()
    if not text:
        return entities.select("id", "name", F.lit(0).alias("rank")).limit(0)
    known = entities.select("id", "name", F.lower(F.trim("name")).alias("_name"))
    hit = (
        F.when(starts_with_text(F.col("_name"), F.lit(text)), 1)
        .when(contains_text(F.col("_name"), F.lit(text)), 2)
    )
    tagged = known.withColumn("_kind", hit).filter(F.col("_kind").isNotNull())
    best = materialise(tagged.orderBy("_kind", "_name", "id").limit(limit))
    # the list is at most ``limit`` long here, so the window sees only those rows
    kind = best.agg(F.min("_kind")).first()[0]
    kept = best.filter(F.col("_kind") == F.lit(kind))
    return top_per_group(kept.withColumn("_all", F.lit(1)), ["_all"], [F.col("_name"), F.col("id")], limit).select("id", "name", "rank")


def compare_two(index: DataFrame, a: object, b: object, label: str = "label") -> DataFrame:
    """Cosine of two entities and whether they share a cluster."""
    left = index.filter(F.col("id") == F.lit(a)).select(
        F.lit(1).alias("_k"), F.col("id").alias("id_a"), F.col("vector").alias("va"), F.col(label).alias("label_a"))
    right = index.filter(F.col("id") == F.lit(b)).select(
        F.lit(1).alias("_k"), F.col("id").alias("id_b"), F.col("vector").alias("vb"), F.col(label).alias("label_b"))
    return left.join(right, "_k").select(
        "id_a", "id_b", dot(F.col("va"), F.col("vb")).alias("cosine"),
        "label_a", "label_b", (F.col("label_a") == F.col("label_b")).alias("same_cluster"),
    )
