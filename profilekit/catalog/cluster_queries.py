"""Clusterings, consensus and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilekit.catalog.base import COHORT_SQL, COHORTS, CUSTOMER_YEARS, DIMENSION, VECTORS_SQL, facts, query, rounded, sql_rounded, table, vectors
from profilekit.config import RunParams
from profilekit.functions.scalar import cohort_of
from profilekit.operators.cluster import bisecting, gate_report, kmeans, lloyd_step, ward
from profilekit.operators.consensus import (
    adjusted_rand, coassociation, consensus_labels, consensus_report, drop_low_consensus, mean_coassociation, own_agreement,
)
from profilekit.operators.density import density_clusters
from profilekit.operators.labels import centroids
from profilekit.operators.profile import modal_value
from profilekit.operators.quality import (
    chi_square, cluster_sizes, cohort_by_cluster, davies_bouldin, diversity, diversity_counts, evaluate, imbalance,
    measure_by_cluster, resampling_stability, silhouette, size_report, temporal_stability,
)
from profilekit.operators.reduce import component_report, fit_components, map_points, project
from profilekit.operators.stability import recluster_samples
from profilekit.plans.full_run import run
from profilekit.operators.relational import number_rows
from profilekit.session import materialise


def labelled(spark, folder):
    """Three labelings of the embeddings: the table's label with 9 as noise, the largest of ten numbers, a sign pattern."""
    v = vectors(spark, folder)
    first = F.slice("vector", 1, 10)
    sign = lambda i: (F.get("vector", F.lit(i)) > 0).cast("int")
    return v.withColumns({
        "la": F.when(F.col("label") == 9, -1).otherwise(F.col("label")),
        "lb": (F.array_position(first, F.array_max(first)) - 1).cast("int"),
        "lc": sign(0) + 2 * sign(1) + 4 * sign(2),
    })


LABELLED_SQL = VECTORS_SQL + """,
l AS (SELECT *, CASE WHEN label = 9 THEN -1 ELSE label END AS la,
        list_position(list_slice(vector, 1, 10), list_max(list_slice(vector, 1, 10))) - 1 AS lb,
        (vector[1] > 0)::INT + 2 * (vector[2] > 0)::INT + 4 * (vector[3] > 0)::INT AS lc FROM v)"""


# ------------------------------------------------------------------ learned

@query("pca")
def _pca(spark, folder):
    return component_report(spark, fit_components(vectors(spark, folder), "vector", 0.90))


@query("map2d")
def _map(spark, folder):
    v = vectors(spark, folder)
    return map_points(project(v, "vector", fit_components(v, "vector", 0.90))).select("id", rounded("x").alias("x"), rounded("y").alias("y"))


@query("pca_keeps_variance", f"""WITH {VECTORS_SQL}, t AS (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM v)
SELECT {sql_rounded('sum(s)', 6)} AS total_variance FROM (SELECT var_pop(x) AS s FROM t GROUP BY pos)""")
def _pca_variance(spark, folder):
    """All components together carry the variance of all features."""
    v = vectors(spark, folder)
    scores = project(v, "vector", fit_components(v, "vector", 1.0))
    per = [F.var_pop(F.get("pca", F.lit(i))) for i in range(DIMENSION)]
    total = per[0]
    for p in per[1:]:
        total = total + p
    return scores.agg(rounded(total, 6).alias("total_variance"))


@query("kmeans", f"WITH {VECTORS_SQL} SELECT id, true AS own_mean_is_nearest, 12 AS n_clusters FROM v")
def _kmeans(spark, folder):
    """At the end of k-means every row is nearest to the mean of its own cluster."""
    found = materialise(kmeans(vectors(spark, folder).drop("label"), "vector", 12)[0].select("id", "vector", "label"))
    means = {r["label"]: list(r["centre"]) for r in lloyd_step(found, "vector", "label").collect()}  # one row per cluster

    def gap(centre):
        each = F.zip_with("vector", F.array(*map(F.lit, centre)), lambda x, c: (x - c) * (x - c))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

    gaps = found.select("id", "label", F.array(*[F.struct(F.lit(k).alias("of"), gap(c).alias("gap")) for k, c in means.items()]).alias("gaps"))
    own = F.filter("gaps", lambda g: g["of"] == F.col("label"))[0]["gap"]
    least = F.array_min(F.transform("gaps", lambda g: g["gap"]))
    return gaps.select("id", (own <= least + 1e-9).alias("own_mean_is_nearest"), F.size("gaps").alias("n_clusters"))


@query("lloyd_step", f"""WITH {LABELLED_SQL}, t AS (SELECT lb, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM l)
SELECT lb, pos - 1 AS position, count(*) AS size, {sql_rounded('avg(x)', 6)} AS centre FROM t GROUP BY lb, pos""")
def _lloyd(spark, folder):
    out = lloyd_step(labelled(spark, folder), "vector", "lb")
    return out.select("lb", "size", F.posexplode("centre").alias("position", "c")).select("lb", "position", "size", rounded("c", 6).alias("centre"))


@query("ward_two_stage")
def _ward(spark, folder):
    return ward(vectors(spark, folder).drop("label"), "vector", 12, micro=100).select("id", "label")


@query("bisecting")
def _bisecting(spark, folder):
    return bisecting(vectors(spark, folder).drop("label"), "vector", 12).select("id", "label")


@query("density_clusters")
def _density(spark, folder):
    points = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return density_clusters(points, "id", "vector", min_cluster_size=5).select("id", "label")


@query("density_gate", f"""WITH {LABELLED_SQL} SELECT count(DISTINCT la) FILTER (la <> -1) AS n_clusters,
{sql_rounded("avg(CASE WHEN la = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS noise_share,
count(DISTINCT la) FILTER (la <> -1) >= 2 AND avg(CASE WHEN la = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.5 AS accepted FROM l""")
def _gate(spark, folder):
    return gate_report(labelled(spark, folder), "la").withColumn("noise_share", rounded("noise_share"))


@query("full_run")
def _full_run(spark, folder):
    """The whole batch run on customer x year facts."""
    result = run(facts(spark, folder), None, CUSTOMER_YEARS, RunParams(n_clusters=6, min_cluster_size=10))
    return result.summary


@query("resampling_stability", "SELECT 1.0::DOUBLE AS mean_ari, 0.0::DOUBLE AS std_ari, 10 AS n_valid_iterations, true AS stable")
def _resampling(spark, folder):
    """Labels that depend on the row alone are the same in every sample."""
    v = materialise(vectors(spark, folder).select("id", "vector"))
    largest = (F.array_position("vector", F.array_max("vector")) - 1).cast("int")
    found = resampling_stability(v, "id", lambda d: d.withColumn("label", largest), n_iterations=10)
    return spark.createDataFrame(
        [(found["mean_ari"], found["std_ari"], found["n_valid_iterations"], found["stable"])],
        "mean_ari double, std_ari double, n_valid_iterations int, stable boolean")


@query("resampling_kmeans")
def _resampling_kmeans(spark, folder):
    """k-means of 50 samples against that of all rows, each sample with its index."""
    return recluster_samples(vectors(spark, folder), "id", "vector").withColumn("ari", rounded("ari", 6))


# ---------------------------------------------------------------- consensus

@query("coassociation", f"""WITH {LABELLED_SQL}, t AS (SELECT la, lb, lc, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT a.la AS a_la, a.lb AS a_lb, a.lc AS a_lc, a.n AS a_rows, b.la AS b_la, b.lb AS b_lb, b.lc AS b_lc, b.n AS b_rows,
  (CASE WHEN a.la = b.la AND a.la <> -1 THEN 1 ELSE 0 END + CASE WHEN a.lb = b.lb AND a.lb <> -1 THEN 1 ELSE 0 END
   + CASE WHEN a.lc = b.lc AND a.lc <> -1 THEN 1 ELSE 0 END) AS s FROM t a, t b)
SELECT a_la, a_lb, a_lc, a_rows, b_la, b_lb, b_lc, b_rows, {sql_rounded('s / 3.0::DOUBLE')} AS agreement FROM p WHERE s > 0""")
def _coassociation(spark, folder):
    return coassociation(labelled(spark, folder), ["la", "lb", "lc"]).withColumn("agreement", rounded("agreement"))


@query("mean_coassociation", f"""WITH {LABELLED_SQL}
SELECT {sql_rounded('''sum(CASE WHEN a.id = b.id THEN 0 ELSE (CASE WHEN a.la = b.la AND a.la <> -1 THEN 1 ELSE 0 END
  + CASE WHEN a.lb = b.lb THEN 1 ELSE 0 END + CASE WHEN a.lc = b.lc THEN 1 ELSE 0 END) / 3.0::DOUBLE END) / count(*)''', 6)} AS mean_coassociation
FROM l a, l b""")
def _mean_coassociation(spark, folder):
    return mean_coassociation(labelled(spark, folder), ["la", "lb", "lc"]).select(rounded("mean_coassociation", 6).alias("mean_coassociation"))


_OWN = f"""{LABELLED_SQL}, own AS (
  SELECT a.id, avg((CASE WHEN a.la = b.la AND a.la <> -1 THEN 1 ELSE 0 END + CASE WHEN a.lc = b.lc THEN 1 ELSE 0 END) / 2.0::DOUBLE) AS agreement
  FROM l a JOIN l b ON a.lb = b.lb AND a.id <> b.id GROUP BY a.id)"""


@query("own_agreement", f"WITH {_OWN} SELECT l.id, {sql_rounded('agreement')} AS agreement FROM l LEFT JOIN own ON l.id = own.id")
def _own(spark, folder):
    return own_agreement(labelled(spark, folder), ["la", "lc"], "lb").select("id", rounded("agreement").alias("agreement"))


@query("consensus_filter", f"WITH {_OWN} SELECT l.id, CASE WHEN agreement < 0.123 THEN -1 ELSE lb END AS final FROM l LEFT JOIN own ON l.id = own.id")
def _filter(spark, folder):
    return drop_low_consensus(labelled(spark, folder), ["la", "lc"], "lb", 0.123, "final").select("id", "final")


@query("consensus_labels")
def _consensus(spark, folder):
    return consensus_labels(labelled(spark, folder), ["la", "lb", "lc"], 12).select("id", "consensus")


def _ari_sql(a: str, b: str) -> str:
    return f"""cells AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM l WHERE {a} <> -1 AND {b} <> -1 GROUP BY 1, 2),
sx AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM cells GROUP BY x)),
sy AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM cells GROUP BY y)),
sc AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM cells)"""


_ARI = "(sc.s - sx.s * sy.s / (sc.n * (sc.n - 1) / 2)) / ((sx.s + sy.s) / 2 - sx.s * sy.s / (sc.n * (sc.n - 1) / 2))"


@query("adjusted_rand", f"WITH {LABELLED_SQL}, {_ari_sql('la', 'lb')} SELECT sc.n::BIGINT AS n_rows, {sql_rounded(_ARI, 6)} AS ari FROM sc, sx, sy")
def _ari(spark, folder):
    return adjusted_rand(labelled(spark, folder), "la", "lb").withColumn("ari", rounded("ari", 6))


@query("consensus_report", f"""WITH {LABELLED_SQL}, {_ari_sql('lc', 'la')},
m AS (SELECT sum(n * (n - 1.0::DOUBLE)) AS s FROM (SELECT count(*) AS n FROM l GROUP BY lc))
SELECT (SELECT count(DISTINCT la) FROM l WHERE la <> -1) AS n_clusters, (SELECT count(*) FROM l WHERE la = -1) AS n_hybrid,
  {sql_rounded('(SELECT avg(CASE WHEN la = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM l)')} AS hybrid_share,
  {sql_rounded('m.s / (SELECT count(*) * count(*) FROM l)', 6)} AS mean_coassociation, {sql_rounded(_ARI, 6)} AS ari_lc FROM sc, sx, sy, m""")
def _report(spark, folder):
    out = consensus_report(labelled(spark, folder), ["lc"], "la")
    return out.withColumns({"hybrid_share": rounded("hybrid_share"), "mean_coassociation": rounded("mean_coassociation", 6), "ari_lc": rounded("ari_lc", 6)})


# ------------------------------------------------------------------ quality

@query("silhouette", f"""WITH {LABELLED_SQL}, c AS (SELECT * FROM l WHERE la <> -1),
d AS (SELECT a.id, a.la, b.la AS other, sum(CASE WHEN a.id = b.id THEN 0 ELSE 1 - list_dot_product(a.vector, b.vector) END) AS s, count(*) AS n
      FROM c a, c b GROUP BY ALL),
own AS (SELECT id, s / (n - 1) AS a FROM d WHERE la = other), far AS (SELECT id, min(s / n) AS b FROM d WHERE la <> other GROUP BY id)
SELECT {sql_rounded('avg((b - a) / greatest(a, b))', 6)} AS silhouette FROM own JOIN far ON own.id = far.id""")
def _silhouette(spark, folder):
    value = silhouette(labelled(spark, folder), "vector", "la")
    return spark.createDataFrame([(value,)], "s double").select(rounded("s", 6).alias("silhouette"))


@query("davies_bouldin", f"""WITH {LABELLED_SQL}, c AS (SELECT * FROM l WHERE la <> -1),
cen AS (SELECT la, list(m ORDER BY pos) AS cv FROM (SELECT la, pos, avg(x) AS m FROM (
  SELECT la, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM c) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT c.la, avg(list_distance(c.vector, cen.cv)) AS spread FROM c JOIN cen ON c.la = cen.la GROUP BY c.la),
r AS (SELECT a.la, max((sa.spread + sb.spread) / list_distance(a.cv, b.cv)) AS w
      FROM cen a JOIN cen b ON a.la <> b.la JOIN s sa ON sa.la = a.la JOIN s sb ON sb.la = b.la GROUP BY a.la)
SELECT {sql_rounded('avg(w)', 6)} AS davies_bouldin FROM r""")
def _davies(spark, folder):
    return davies_bouldin(labelled(spark, folder), "vector", "la").select(rounded("davies_bouldin", 6).alias("davies_bouldin"))


@query("cluster_sizes", f"WITH {LABELLED_SQL} SELECT la, count(*) AS size FROM l GROUP BY la")
def _sizes(spark, folder):
    return cluster_sizes(labelled(spark, folder), "la")


@query("size_report", f"""WITH {LABELLED_SQL}, s AS (SELECT la, count(*) AS n FROM l GROUP BY la)
SELECT count(*) FILTER (la <> -1) AS n_clusters_valid, min(n) FILTER (la <> -1) AS min_cluster_size, max(n) FILTER (la <> -1) AS max_cluster_size,
  {sql_rounded('max(n) FILTER (la <> -1) / min(n) FILTER (la <> -1)')} AS size_imbalance_ratio,
  (SELECT count(*) FROM l WHERE la = -1) AS n_noise, {sql_rounded('(SELECT count(*) FROM l WHERE la = -1) / sum(n)')} AS noise_share FROM s""")
def _size_report(spark, folder):
    return size_report(labelled(spark, folder), "la").withColumns({
        "size_imbalance_ratio": rounded("size_imbalance_ratio"), "noise_share": rounded("noise_share")})


@query("size_ratio", f"""WITH {LABELLED_SQL}, s AS (SELECT la, count(*) AS n FROM l WHERE la <> -1 GROUP BY la)
SELECT count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, {sql_rounded('max(n) / min(n)')} AS imbalance FROM s""")
def _ratio(spark, folder):
    return imbalance(labelled(spark, folder), "la").withColumn("imbalance", rounded("imbalance"))


def daily_labels(spark, folder):
    """One label per user and day: the most frequent event type, errors as noise."""
    e = table(spark, folder, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01")))
    modal = modal_value(e, ["user_id", "day"], "event_type", out="kind")
    return modal.withColumn("label", F.when(F.col("kind") == "error", -1).otherwise(F.ascii("kind")))


_DAILY = """dl AS (SELECT user_id, day, CASE WHEN event_type = 'error' THEN -1 ELSE ascii(event_type) END AS label FROM (
  SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, event_type,
         row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY count(*) DESC, event_type) AS rn
  FROM events GROUP BY user_id, ts::DATE, event_type) WHERE rn = 1)"""


@query("modal_event_per_day", f"WITH {_DAILY} SELECT user_id, day, label FROM dl")
def _modal(spark, folder):
    return daily_labels(spark, folder).select("user_id", "day", "label")


@query("temporal_stability", f"""WITH {_DAILY},
n AS (SELECT *, lead(day) OVER w AS next_day, lead(label) OVER w AS next_label FROM dl WINDOW w AS (PARTITION BY user_id ORDER BY day)),
c AS (SELECT * FROM n WHERE label <> -1 AND next_label <> -1 AND next_day - day = 1)
SELECT count(*) AS consecutive_pairs, count(*) FILTER (label = next_label) AS stable_transitions,
  {sql_rounded('coalesce(avg(CASE WHEN label = next_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0)')} AS share_stable FROM c""")
def _stability(spark, folder):
    return temporal_stability(daily_labels(spark, folder), "user_id", "day", "label").withColumn("share_stable", rounded("share_stable"))


@query("elite_diversity", """SELECT count(*) AS n_chosen, count(DISTINCT c_nationkey) AS n_clusters, count(DISTINCT c_nationkey) >= 3 AS healthy
FROM customer WHERE c_acctbal / 10000 > 0.70""")
def _elite(spark, folder):
    return diversity(table(spark, folder, "customer"), "c_nationkey", F.col("c_acctbal") / 10000 > 0.70)


@query("flag_diversity", f"WITH {LABELLED_SQL} SELECT la, count(*) AS n FROM l WHERE vector[4] > 0 AND la <> -1 GROUP BY la")
def _flags(spark, folder):
    return diversity_counts(labelled(spark, folder), "la", F.get("vector", F.lit(3)) > 0)


@query("measure_by_cluster", f"""SELECT c_nationkey, {sql_rounded('avg(c_acctbal)')} AS mean, {sql_rounded('stddev_samp(c_acctbal)')} AS std,
  {sql_rounded('min(c_acctbal)')} AS low, {sql_rounded('max(c_acctbal)')} AS high FROM customer GROUP BY c_nationkey""")
def _measure(spark, folder):
    out = measure_by_cluster(table(spark, folder, "customer"), "c_nationkey", "c_acctbal")
    return out.select("c_nationkey", *[rounded(c).alias(c) for c in ("mean", "std", "low", "high")])


@query("cohort_by_cluster", f"""WITH o AS (SELECT o_custkey, min(year(o_orderdate)) AS debut_period FROM orders GROUP BY 1)
SELECT c_nationkey, {COHORT_SQL} AS cohort, count(*) AS n FROM customer JOIN o ON o_custkey = c_custkey GROUP BY 1, 2""")
def _cohorts(spark, folder):
    first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("debut"))
    both = table(spark, folder, "customer").join(first, "c_custkey").withColumn("cohort", cohort_of(F.col("debut"), COHORTS))
    return cohort_by_cluster(both, "c_nationkey", "cohort")


@query("chi_square", f"""WITH o AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*)::DOUBLE AS o FROM customer GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS r FROM o GROUP BY a), c AS (SELECT b, sum(o) AS c FROM o GROUP BY b), n AS (SELECT sum(o) AS n FROM o)
SELECT max(n.n)::BIGINT AS n_rows, {sql_rounded('sum(pow(coalesce(o.o, 0) - r.r * c.c / n.n, 2) / (r.r * c.c / n.n))')} AS chi_square,
  (count(DISTINCT r.a) - 1) * (count(DISTINCT c.b) - 1) AS dof
FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.a = r.a AND o.b = c.b""")
def _chi(spark, folder):
    return chi_square(table(spark, folder, "customer"), "c_nationkey", "c_mktsegment").withColumn("chi_square", rounded("chi_square"))


@query("evaluation", f"""WITH {LABELLED_SQL}, s AS (SELECT la, count(*) AS n FROM l GROUP BY la)
SELECT count(*) FILTER (la <> -1) AS n_clusters_valid, min(n) FILTER (la <> -1) AS min_cluster_size, max(n) FILTER (la <> -1) AS max_cluster_size,
  (SELECT count(*) FROM l WHERE la = -1) AS n_noise, (SELECT count(*) FROM l WHERE vector[4] > 0) AS n_chosen,
  (SELECT count(DISTINCT la) FROM l WHERE vector[4] > 0 AND la <> -1) AS n_clusters FROM s""")
def _evaluation(spark, folder):
    rows = materialise(labelled(spark, folder).withColumns({"flag": F.get("vector", F.lit(3)) > 0, "cohort": F.col("role")}))
    out = evaluate(rows, "vector", "la", flag="flag", cohort="cohort")
    return out.select("n_clusters_valid", "min_cluster_size", "max_cluster_size", "n_noise", "flag_diversity.n_chosen", "flag_diversity.n_clusters")


@query("clusters_by_id", f"""WITH {LABELLED_SQL}
SELECT la, count(*) AS n, min(id) AS first_id, row_number() OVER (ORDER BY la) - 1 AS position FROM l GROUP BY la""")
def _clusters_by_id(spark, folder):
    """All clusters in the order of their ids, noise first."""
    sizes = labelled(spark, folder).groupBy("la").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return number_rows(sizes, [F.col("la")], "position")


@query("centroids", f"""WITH {LABELLED_SQL}, t AS (SELECT la, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM l)
SELECT la, pos - 1 AS position, {sql_rounded('avg(x)', 6)} AS mean FROM t GROUP BY la, pos""")
def _centroids(spark, folder):
    out = centroids(labelled(spark, folder), "vector", "la").select("la", F.posexplode("centroid").alias("position", "m"))
    return out.select("la", "position", rounded("m", 6).alias("mean"))
