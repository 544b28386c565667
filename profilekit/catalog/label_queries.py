"""Cluster names, profiles, read models, graphs and chart marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilekit.catalog.base import BLOCKS, DIMENSION, FEATURE_NAMES, PAIRS_SQL, query, rounded, sql_rounded, vectors
from profilekit.catalog.cluster_queries import LABELLED_SQL, labelled
from profilekit.catalog.search_queries import _ranked_sql
from profilekit.functions.scalar import score_bucket
from profilekit.operators.graph import ego_edges, ego_nodes, merge_graphs
from profilekit.operators.labels import (
    cluster_profiles, cluster_summary, cluster_zscores, compare_clusters, example_members, exemplars, name_clusters,
    rank_features, size_order, with_defaults,
)
from profilekit.operators.marts import flag_rate_mart, map_mart, radar_mart, role_share_mart, size_mart, top_feature_mart
from profilekit.operators.nearest import nearest
from profilekit.operators.reduce import fit_components, map_points, project
from profilekit.operators.relational import undirected_distinct
from profilekit.operators.search import Scoring, search
from profilekit.plans.explore import entity_profiles
from profilekit.session import materialise

# every feature gets a word per direction; neighbours share one, so names have duplicates to drop
LABELS = {(f"f{i:02d}", d): f"{d.title()} {i // 3}" for i in range(0, DIMENSION, 2) for d in ("high", "low")}
PRIORITY = tuple(f"f{i:02d}" for i in range(DIMENSION - 1, 31, -1))
DISPLAY = {0: "Zeroth", 3: "Third", -1: "Loose"}


def members(spark, folder):
    """Labelled embeddings with a flag, a total, a role and two measures."""
    at = lambda i: F.get("vector", F.lit(i))
    return labelled(spark, folder).withColumns({
        "flag": at(3) > 0, "total_periods": F.col("lb"), "role": F.concat(F.lit("s"), "lc"),
        "height": at(4) * 100, "weight": at(5) * 100,
    })


MEMBERS_SQL = LABELLED_SQL + """,
mem AS (SELECT id, name, vector, la, lb AS total_periods, 's' || lc AS role, vector[4] > 0 AS flag, vector[5] * 100 AS height, vector[6] * 100 AS weight FROM l),
x AS (SELECT id, la, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM mem),
g AS (SELECT pos, avg(x) AS gm, stddev_pop(x) + 1e-8 AS gs FROM x GROUP BY pos),
z AS (SELECT la, x.pos, 'f' || lpad((x.pos - 1)::VARCHAR, 2, '0') AS feature, (avg(x) - max(gm)) / max(gs) AS z FROM x JOIN g ON x.pos = g.pos WHERE la <> -1 GROUP BY la, x.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY la ORDER BY round(abs(z), 9) DESC, CASE WHEN pos > 32 THEN 64 - pos ELSE 999 END, pos) AS place,
  CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM z),
lab AS (SELECT *, CASE WHEN (pos - 1) % 2 = 0 THEN (CASE WHEN z > 0 THEN 'High ' ELSE 'Low ' END) || ((pos - 1) // 3) ELSE feature || '-' || direction END AS label FROM ranked),
named AS (SELECT la, string_agg(label, ' • ' ORDER BY place) AS name FROM (
  SELECT la, label, min(place) AS place FROM lab WHERE place <= 4 GROUP BY la, label) GROUP BY la)"""


def named(spark, folder):
    return name_clusters(cluster_zscores(members(spark, folder), "vector", "la", FEATURE_NAMES), "la", LABELS, PRIORITY)


@query("cluster_zscores", f"WITH {MEMBERS_SQL} SELECT la, feature, {sql_rounded('z')} AS z FROM z")
def _zscores(spark, folder):
    out = cluster_zscores(members(spark, folder), "vector", "la", FEATURE_NAMES)
    return out.select("la", F.explode("z_scores").alias("feature", "z")).select("la", "feature", rounded("z").alias("z"))


@query("feature_rank", f"WITH {MEMBERS_SQL} SELECT la, place, feature, direction FROM ranked WHERE place <= 10")
def _rank(spark, folder):
    out = cluster_zscores(members(spark, folder), "vector", "la", FEATURE_NAMES)
    rows = out.select("la", F.posexplode(rank_features(F.col("z_scores"), PRIORITY, 10)).alias("place", "e"))
    return rows.select("la", (F.col("place") + 1).alias("place"), "e.feature", F.when(F.col("e.z") > 0, "high").otherwise("low").alias("direction"))


@query("cluster_names", f"WITH {MEMBERS_SQL} SELECT la, name FROM named")
def _names(spark, folder):
    return named(spark, folder).select("la", "name")


@query("top_feature_mart", f"WITH {MEMBERS_SQL} SELECT la, place - 1 AS position, feature, {sql_rounded('z', 3)} AS z_score, direction, label FROM lab WHERE place <= 4")
def _top_features(spark, folder):
    return top_feature_mart(named(spark, folder), "la", 5).withColumn("z_score", rounded("z_score", 3))


@query("exemplars", f"""WITH {MEMBERS_SQL}, cen AS (SELECT la, list(m ORDER BY pos) AS cv FROM (SELECT la, pos, avg(x) AS m FROM x WHERE la <> -1 GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT mem.la, id, list_distance(vector, cv) AS d FROM mem JOIN cen ON mem.la = cen.la),
r AS (SELECT *, row_number() OVER (PARTITION BY la ORDER BY round(d, 9), id) AS rank FROM d)
SELECT la, id, rank, {sql_rounded('d')} AS distance FROM r WHERE rank <= 8""")
def _exemplars(spark, folder):
    return exemplars(members(spark, folder), "id", "vector", "la").select("la", "id", "rank", rounded("distance").alias("distance"))


_EXAMPLES = "ex AS (SELECT *, row_number() OVER (PARTITION BY la ORDER BY flag DESC, total_periods DESC, name) AS rank FROM mem)"


@query("example_members", f"WITH {MEMBERS_SQL}, {_EXAMPLES} SELECT la, name, rank FROM ex WHERE rank <= 3")
def _examples(spark, folder):
    return example_members(members(spark, folder), "la", "flag", "total_periods", "name").select("la", "name", "rank")


@query("cluster_profiles", f"""WITH {MEMBERS_SQL}, cen AS (SELECT la, list(m ORDER BY pos) AS cv FROM (SELECT la, pos, avg(x) AS m FROM x WHERE la <> -1 GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT mem.la, mem.name, row_number() OVER (PARTITION BY mem.la ORDER BY round(list_distance(vector, cv), 9), id) AS rank FROM mem JOIN cen ON mem.la = cen.la),
e AS (SELECT la, string_agg(name, ',' ORDER BY rank) AS exemplars FROM d WHERE rank <= 8 GROUP BY la),
rc AS (SELECT la, string_agg(role || '=' || n, ',' ORDER BY role) AS roles FROM (SELECT la, role, count(*) AS n FROM mem GROUP BY 1, 2) GROUP BY la)
SELECT mem.la, named.name, count(*) AS size, e.exemplars, rc.roles, count(*) FILTER (flag) AS flag_count,
  {sql_rounded('avg(CASE WHEN flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 3)} AS flag_rate, {sql_rounded('avg(height)', 1)} AS avg_height, {sql_rounded('avg(weight)', 1)} AS avg_weight
FROM mem JOIN named ON mem.la = named.la JOIN e ON e.la = mem.la JOIN rc ON rc.la = mem.la GROUP BY mem.la, named.name, e.exemplars, rc.roles""")
def _profiles(spark, folder):
    out = cluster_profiles(members(spark, folder), "id", "vector", "la", FEATURE_NAMES, LABELS, PRIORITY, measures=["height", "weight"])
    roles = F.array_join(F.transform(F.map_entries("role_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select(
        "la", "name", "size", F.array_join("exemplars", ",").alias("exemplars"), roles.alias("roles"), "flag_count",
        rounded("flag_rate", 3).alias("flag_rate"), rounded("avg_height", 1).alias("avg_height"), rounded("avg_weight", 1).alias("avg_weight"))


@query("cluster_compare", f"""WITH {MEMBERS_SQL} SELECT a.feature, {sql_rounded('a.z')} AS z_a, {sql_rounded('b.z')} AS z_b, {sql_rounded('abs(a.z - b.z)')} AS divergence
FROM z a JOIN z b ON a.feature = b.feature WHERE a.la = 1 AND b.la = 4 ORDER BY round(abs(a.z - b.z), 9) DESC, a.feature LIMIT 8""")
def _compare(spark, folder):
    out = compare_clusters(named(spark, folder), "la", 1, 4)
    return out.select("feature", *[rounded(c).alias(c) for c in ("z_a", "z_b", "divergence")])


@query("cluster_summary", f"""WITH {MEMBERS_SQL}, {_EXAMPLES},
el AS (SELECT la, string_agg(name, ',' ORDER BY rank) AS examples FROM ex WHERE rank <= 3 GROUP BY la),
tr AS (SELECT la, label, min(place) AS place FROM lab WHERE place <= 4 AND NOT contains(label, '_') GROUP BY la, label),
tl AS (SELECT la, string_agg(label, ',' ORDER BY place) AS traits, string_agg(label, ' · ' ORDER BY place) AS description FROM tr GROUP BY la),
sz AS (SELECT la, count(*) AS size FROM mem GROUP BY la)
SELECT sz.la, CASE sz.la WHEN 0 THEN 'Zeroth' WHEN 3 THEN 'Third' WHEN -1 THEN 'Loose' ELSE named.name END AS name, size,
  CASE WHEN sz.la = -1 THEN 'Rows without a dense cluster' ELSE coalesce(tl.description, named.name) END AS description,
  CASE WHEN sz.la = -1 THEN 'Outlier,Hybrid Profile' ELSE coalesce(tl.traits, '') END AS traits, el.examples
FROM sz LEFT JOIN named ON named.la = sz.la LEFT JOIN tl ON tl.la = sz.la LEFT JOIN el ON el.la = sz.la""")
def _summary(spark, folder):
    out = cluster_summary(named(spark, folder), members(spark, folder), "la", DISPLAY)
    return out.select("la", "name", "size", "description", F.array_join("traits", ",").alias("traits"), F.array_join("examples", ",").alias("examples"))


@query("cluster_order", f"""WITH {MEMBERS_SQL}, s AS (SELECT la, count(*) AS size FROM mem GROUP BY la)
SELECT la, size, row_number() OVER (ORDER BY la = -1, size DESC, la) - 1 AS position FROM s""")
def _order(spark, folder):
    return size_order(members(spark, folder).groupBy("la").agg(F.count(F.lit(1)).alias("size")), "la")


@query("entity_profile", f"""WITH {MEMBERS_SQL}, r AS (SELECT x.id, x.la, 'f' || lpad((x.pos - 1)::VARCHAR, 2, '0') AS feature, x.pos, (x.x - gm) / gs AS z FROM x JOIN g ON x.pos = g.pos),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(z), 9) DESC, pos) AS place FROM r)
SELECT t.id, coalesce(named.name, 'Hybrid/Transitional') AS cluster_name, nullif(t.la, -1) AS cluster_id, place, feature, {sql_rounded('z', 3)} AS z_score,
  CASE WHEN (pos - 1) % 2 = 0 THEN (CASE WHEN z > 0 THEN 'High ' ELSE 'Low ' END) || ((pos - 1) // 3) ELSE feature || CASE WHEN z > 0 THEN '-high' ELSE '-low' END END AS label
FROM t LEFT JOIN named ON named.la = t.la WHERE place <= 5""")
def _entity(spark, folder):
    out = entity_profiles(members(spark, folder), named(spark, folder), "vector", FEATURE_NAMES, LABELS, "la", 5)
    rows = out.select("id", "cluster_name", "cluster_id", F.posexplode("top_features").alias("place", "f"))
    return rows.select("id", "cluster_name", "cluster_id", (F.col("place") + 1).alias("place"), "f.feature", rounded("f.z_score", 3).alias("z_score"), "f.label")


# -------------------------------------------------------------------- marts

@query("radar_mart", f"""WITH {MEMBERS_SQL}, dims AS (SELECT unnest(['f03', 'f10', 'missing', 'f63']) AS dimension, unnest([0, 1, 2, 3]) AS position),
ls AS (SELECT DISTINCT la FROM z)
SELECT ls.la, position, dimension, {sql_rounded('coalesce(z, 0)')} AS value FROM ls CROSS JOIN dims LEFT JOIN z ON z.la = ls.la AND z.feature = dimension""")
def _radar(spark, folder):
    return radar_mart(named(spark, folder), "la", ["f03", "f10", "missing", "f63"]).withColumn("value", rounded("value"))


@query("size_mart", f"""WITH {MEMBERS_SQL} SELECT mem.la, coalesce(named.name, 'Hybrid / Transitional') AS name, count(*) AS size
FROM mem LEFT JOIN named ON named.la = mem.la GROUP BY 1, 2""")
def _size_mart(spark, folder):
    return size_mart(named(spark, folder), members(spark, folder), "la")


@query("role_share_mart", f"""WITH {MEMBERS_SQL} SELECT la, {', '.join(f"{sql_rounded(f'''count(*) FILTER (role = '{r}') / count(*)''')} AS {r}" for r in ("s0", "s3", "s7", "s9"))}
FROM mem WHERE la <> -1 GROUP BY la""")
def _role_share(spark, folder):
    roles = ["s0", "s3", "s7", "s9"]
    return role_share_mart(members(spark, folder), "la", "role", roles).select("la", *[rounded(r).alias(r) for r in roles])


@query("flag_rate_mart", f"""WITH {MEMBERS_SQL} SELECT la, count(*) FILTER (flag) AS flag_count, {sql_rounded('avg(CASE WHEN flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 3)} AS flag_rate
FROM mem WHERE la <> -1 GROUP BY la""")
def _flag_rate(spark, folder):
    return flag_rate_mart(members(spark, folder), "la", "flag").withColumn("flag_rate", rounded("flag_rate", 3))


@query("map_mart", f"""WITH {MEMBERS_SQL} SELECT id, flag, coalesce(named.name, 'Hybrid / Transitional') AS cluster_name FROM mem LEFT JOIN named ON named.la = mem.la""")
def _map_mart(spark, folder):
    m = members(spark, folder)
    points = map_points(project(m, "vector", fit_components(m, "vector")))
    return map_mart(points, named(spark, folder), "la").select("id", "flag", "cluster_name")


# -------------------------------------------------------------------- graph

def _found(spark, folder, k=5):
    v = vectors(spark, folder)
    return search(v.select(F.col("id").alias("query_id")), v, Scoring(BLOCKS), k, attributions=0)


_FINAL = f"{PAIRS_SQL}, cand AS (SELECT * FROM near WHERE rk <= 6), {_ranked_sql('cand', 5)}, top AS (SELECT * FROM final WHERE rank <= 5)"
_POINTS = "pts AS (SELECT vec_id AS id, label, 'r' || label AS role FROM embeddings WHERE label <> 4)"


@query("ego_graph_nodes", f"""WITH {_FINAL}, {_POINTS},
n AS (SELECT DISTINCT q AS center, q AS id, true AS is_center FROM top UNION ALL SELECT q, c, false FROM top)
SELECT n.center, n.id, n.is_center, coalesce(pts.label, -1) AS label, coalesce(pts.role, '—') AS role FROM n LEFT JOIN pts ON pts.id = n.id""")
def _nodes(spark, folder):
    points = vectors(spark, folder).filter("label <> 4").select("id", "label", "role")
    return ego_nodes(ego_edges(_found(spark, folder)), points)


@query("ego_graph", f"WITH {_FINAL} SELECT q AS source, c AS target, rank, {sql_rounded('hybrid')} AS score FROM top")
def _ego(spark, folder):
    return ego_edges(_found(spark, folder)).select("source", "target", "rank", rounded("score").alias("score"))


_MERGED = f"""{_FINAL}, e AS (SELECT q AS center, q AS source, c AS target, rank, hybrid AS score FROM top),
u AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY center, rank) AS rn FROM e)"""


@query("merged_graph", f"WITH {_MERGED} SELECT source, target, {sql_rounded('score')} AS score FROM u WHERE rn = 1")
def _merged(spark, folder):
    edges = materialise(ego_edges(_found(spark, folder)))
    nodes = ego_nodes(edges, vectors(spark, folder).select("id", "label", "role"))
    _, kept = merge_graphs(nodes, edges, 7)
    return kept.select("source", "target", rounded("score").alias("score"))


@query("merged_graph_nodes", f"""WITH {_FINAL}, t AS (SELECT * FROM top),
n AS (SELECT q AS id FROM t UNION SELECT c FROM t)
SELECT n.id, n.id = 7 AS is_center, n.id IN (SELECT q FROM t) AS expanded, v.label, v.role FROM n JOIN v ON v.id = n.id""")
def _merged_nodes(spark, folder):
    edges = materialise(ego_edges(_found(spark, folder)))
    nodes = ego_nodes(edges, vectors(spark, folder).select("id", "label", "role"))
    return merge_graphs(nodes, edges, 7)[0]


@query("edge_buckets", f"""WITH {PAIRS_SQL} SELECT CASE WHEN score + 0.5 >= 0.9 THEN 'strong' WHEN score + 0.5 >= 0.8 THEN 'medium' ELSE 'weak' END AS bucket,
count(*) AS n FROM near WHERE rk <= 10 GROUP BY 1""")
def _buckets(spark, folder):
    v = vectors(spark, folder)
    items = v.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    edges = nearest(items.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"}), items, 10)
    return edges.groupBy(score_bucket(F.col("score") + 0.5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("undirected_dedupe", f"""WITH {PAIRS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY least(q, c), greatest(q, c) ORDER BY rk, q) AS rn FROM near WHERE rk <= 5)
SELECT q AS src, c AS dst, rk AS rank FROM e WHERE rn = 1""")
def _undirected(spark, folder):
    v = vectors(spark, folder)
    items = v.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    edges = nearest(items.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"}), items, 5)
    edges = edges.select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), "rank")
    return undirected_distinct(edges, "src", "dst", [F.col("rank"), F.col("src")])


@query("neighbour_defaults", f"""WITH {PAIRS_SQL}, {_POINTS} SELECT q AS src, c AS id, coalesce(pts.label, -1) AS label, coalesce(pts.role, '—') AS role
FROM near LEFT JOIN pts ON pts.id = c WHERE rk <= 3""")
def _defaults(spark, folder):
    v = vectors(spark, folder)
    items = v.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    edges = nearest(items.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"}), items, 3)
    points = v.filter("label <> 4").select("id", "label", "role")
    return with_defaults(edges.select(F.col("query_id").alias("src"), F.col("item_id").alias("id")), points, "id", {"label": -1, "role": "—"})
