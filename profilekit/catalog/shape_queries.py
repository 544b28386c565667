"""Aggregates, windows, top-k, sets, scalar functions, reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilekit.catalog.base import PAIRS_SQL, VECTORS_SQL, facts, query, rounded, sql_rounded, table, vectors
from profilekit.catalog.profile_queries import CFG, MEASURES, profiles
from profilekit.config import RunParams, config_hash
from profilekit.functions.scalar import contains_text, direction, jaccard, replace_part, same_text, starts_with_text, text_flag
from profilekit.operators.merge import merge_facts
from profilekit.operators.nearest import nearest
from profilekit.operators.relational import (
    capped_pairs, compare_sets, conditional_rates, first_per_key, group_stats, number_rows, role_shares, top_per_group,
    value_counts, with_group_stats,
)
from profilekit.operators.retrieval import (
    capture_baseline, compare_baseline, gate, labelled_pairs, rank_correlation, recall_and_mrr, score_drift,
)
from profilekit.session import materialise, scratch_path
from profilekit.sources.index_store import fingerprint
from profilekit.sources.steps import step
from profilekit.sources.tables import read_baseline, read_edges, read_points, write_baseline, write_edges, write_nested, write_points


# -------------------------------------------------------------- aggregates

@query("value_counts_map", """SELECT o_orderpriority, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS counts
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def _value_counts(spark, folder):
    out = value_counts(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("o_orderpriority", text.alias("counts"))


@query("group_measure_stats", f"""SELECT event_type, {sql_rounded('avg(value)')} AS mean, {sql_rounded('stddev_samp(value)')} AS std,
{sql_rounded('min(value)')} AS low, {sql_rounded('max(value)')} AS high FROM events GROUP BY 1""")
def _group_stats(spark, folder):
    out = group_stats(table(spark, folder, "events"), "event_type", "value")
    return out.select("event_type", *[rounded(c).alias(c) for c in ("mean", "std", "low", "high")])


@query("conditional_rates", f"""SELECT c_mktsegment, count(*) AS size, count(*) FILTER (c_acctbal > 9000) AS flag_count,
{sql_rounded('avg(CASE WHEN c_acctbal > 9000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 3)} AS flag_rate, {sql_rounded('avg(c_acctbal)', 1)} AS avg_c_acctbal FROM customer GROUP BY 1""")
def _rates(spark, folder):
    out = conditional_rates(table(spark, folder, "customer"), "c_mktsegment", F.col("c_acctbal") > 9000, ["c_acctbal"])
    return out.withColumns({"flag_rate": rounded("flag_rate", 3), "avg_c_acctbal": rounded("avg_c_acctbal", 1)})


@query("document_label_rates", f"""SELECT lang, source, count(*) AS size, sum(toxic) AS flag_count,
{sql_rounded('avg(toxic::DOUBLE)', 3)} AS flag_rate FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1, 2""")
def _doc_rates(spark, folder):
    both = table(spark, folder, "documents").select("doc_id", "lang", "source").join(table(spark, folder, "labels"), "doc_id")
    out = conditional_rates(both.withColumn("key", F.struct("lang", "source")), "key", F.col("toxic") == 1, [])
    return out.select("key.lang", "key.source", "size", "flag_count", rounded("flag_rate", 3).alias("flag_rate"))


@query("role_pivot", f"""SELECT c_nationkey, {', '.join(f"{sql_rounded(f'''count(*) FILTER (c_mktsegment = '{r}') / count(c_mktsegment)''')} AS {r.lower()}" for r in ("HOUSEHOLD", "MACHINERY", "NOWHERE"))}
FROM customer GROUP BY 1""")
def _pivot(spark, folder):
    roles = ["HOUSEHOLD", "MACHINERY", "NOWHERE"]
    out = role_shares(table(spark, folder, "customer"), "c_nationkey", "c_mktsegment", roles)
    return out.select("c_nationkey", *[rounded(r).alias(r.lower()) for r in roles])


# ------------------------------------------------------------------ windows

@query("window_group_stats", f"""SELECT o_orderkey, {sql_rounded('avg(o_totalprice) OVER w')} AS o_totalprice_mean, {sql_rounded('stddev_samp(o_totalprice) OVER w')} AS o_totalprice_std
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def _window_stats(spark, folder):
    out = with_group_stats(table(spark, folder, "orders"), "o_custkey", "o_totalprice")
    return out.select("o_orderkey", rounded("o_totalprice_mean").alias("o_totalprice_mean"), rounded("o_totalprice_std").alias("o_totalprice_std"))


@query("first_last_per_key", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM orders)
SELECT x.o_custkey, x.o_orderkey AS first_order, y.o_orderkey AS last_order FROM f x JOIN f y ON x.o_custkey = y.o_custkey WHERE x.a = 1 AND y.b = 1""")
def _first_last(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = first_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    last = first_per_key(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return first.select("o_custkey", F.col("o_orderkey").alias("first_order")).join(
        last.select("o_custkey", F.col("o_orderkey").alias("last_order")), "o_custkey")


@query("ranked_per_group", """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank
FROM part QUALIFY rank <= 4""")
def _ranked(spark, folder):
    return top_per_group(table(spark, folder, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 4).select("p_brand", "p_partkey", "rank")


@query("capped_pairs", """WITH m AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
p AS (SELECT a.c_nationkey, a.c_custkey AS a, b.c_custkey AS b, row_number() OVER (PARTITION BY a.c_nationkey ORDER BY a.i, b.i) AS n
      FROM m a JOIN m b ON a.c_nationkey = b.c_nationkey AND a.i < b.i)
SELECT c_nationkey, a, b FROM p WHERE n <= 90""")
def _capped(spark, folder):
    return capped_pairs(table(spark, folder, "customer"), "c_nationkey", "c_custkey", F.lit(90))


@query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS number FROM orders")
def _numbers(spark, folder):
    return number_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "number")


# -------------------------------------------------------------------- sets

@query("array_jaccard", f"""WITH {PAIRS_SQL}, ids AS (SELECT q, list(c ORDER BY rk) FILTER (rk <= 8) AS a, list(c ORDER BY rk) FILTER (rk BETWEEN 4 AND 12) AS b FROM near WHERE rk <= 12 GROUP BY q)
SELECT q AS query_id, len(list_intersect(a, b)) AS overlap_count, {sql_rounded('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS jaccard,
array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS new_only, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed FROM ids""")
def _sets(spark, folder):
    found = _neighbours(spark, folder, 12)
    ids = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 8, F.col("item_id")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("rank") >= 4, F.col("item_id")))).alias("b"))
    out = compare_sets(ids, "a", "b")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("query_id", "overlap_count", rounded("jaccard").alias("jaccard"), text("new_only").alias("new_only"), text("removed").alias("removed"))


@query("word_set_jaccard", f"""SELECT a.p_partkey AS part, {sql_rounded("len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' '))))")} AS similarity
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def _word_sets(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("words").alias("other"))
    return p.join(nxt, "p_partkey").select(F.col("p_partkey").alias("part"), rounded(jaccard(F.col("words"), F.col("other"))).alias("similarity"))


@query("ordered_distinct", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM documents),
f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM f GROUP BY doc_id""")
def _ordered_distinct(spark, folder):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    d = table(spark, folder, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


# ----------------------------------------------------------------- scalars

@query("text_match", """SELECT p_partkey, lower(p_type) = lower('small') AS same, starts_with(lower(p_name), lower('RE')) AS starts, contains(lower(p_name), lower('IDG')) AS inside,
replace(p_brand, '#', ' ') AS brand, CASE WHEN p_size - 25 > 0 THEN 'high' ELSE 'low' END AS way, p_type = 'SMALL' AS flag FROM part""")
def _text_match(spark, folder):
    p = table(spark, folder, "part")
    return p.select(
        "p_partkey", same_text(F.col("p_type"), F.lit("small")).alias("same"), starts_with_text(F.col("p_name"), F.lit("RE")).alias("starts"),
        contains_text(F.col("p_name"), F.lit("IDG")).alias("inside"), replace_part(F.col("p_brand"), "#", " ").alias("brand"),
        direction(F.col("p_size") - 25).alias("way"), text_flag(F.when(F.col("p_type") == "SMALL", " Yes ").otherwise("no")).alias("flag"))


@query("fingerprint", "SELECT 12 AS digits, true AS changes_with_a_row, true AS changes_with_a_number, count(*) AS n FROM embeddings")
def _fingerprint(spark, folder):
    """12 digits that change when a row goes and when a number of one row changes."""
    v = vectors(spark, folder).select("id", "vector")
    smallest = v.agg(F.min("id")).first()[0]
    moved = F.when(F.col("id") == smallest, F.transform("vector", lambda x: x + 0.001)).otherwise(F.col("vector"))
    whole, fewer, other = (fingerprint(d, "id", "vector").first()[0] for d in (v, v.filter(F.col("id") != smallest), v.withColumn("vector", moved)))
    return v.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(len(whole)).alias("digits"), F.lit(fewer != whole).alias("changes_with_a_row"), F.lit(other != whole).alias("changes_with_a_number"), "n")


@query("fingerprint_order_free", "SELECT true AS same, count(*) AS n FROM embeddings")
def _fingerprint_same(spark, folder):
    """The fingerprint must not depend on row order or partitioning."""
    v = vectors(spark, folder)
    a = fingerprint(v, "id", "vector").first()[0]
    b = fingerprint(v.repartition(5).sortWithinPartitions(F.col("id").desc()), "id", "vector").first()[0]
    return v.agg(F.lit(a == b).alias("same"), F.count(F.lit(1)).alias("n"))


@query("json_roundtrip", f"""WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k, '{{"k":' || k || '}}' AS again FROM k""")
def _json(spark, folder):
    parsed = table(spark, folder, "events").withColumn("p", F.from_json("props", "k bigint"))
    return parsed.select("event_id", "p.k", F.to_json("p").alias("again"))


# --------------------------------------------------------------- retrieval

def _neighbours(spark, folder, k, cut: int | None = None):
    v = vectors(spark, folder)
    if cut:
        v = v.withColumn("vector", F.transform("vector", lambda x, i: F.when(i < cut, x).otherwise(0.0)))
    items = v.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    return nearest(items.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"}), items, k)


_CUT = """cutv AS (SELECT id, list_slice(vector, 1, 60) AS vector FROM v),
cutn AS (SELECT * FROM (SELECT a.id AS q, b.id AS c, round(list_dot_product(a.vector, b.vector), 9) AS score,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vector, b.vector), 9) DESC, b.id) AS rk FROM cutv a JOIN cutv b ON a.id <> b.id) WHERE rk <= 10)"""


@query("labelled_pairs", "SELECT 500 AS n_pairs, 0 AS wrong, least(500, count(DISTINCT label) * (500 // count(DISTINCT label) + 1)) AS expected FROM embeddings")
def _pairs(spark, folder):
    """500 pairs, all of one cluster, within the cap per cluster."""
    v = vectors(spark, folder)
    pairs = labelled_pairs(v, "id", "label")
    own = v.select("id", "label")
    both = pairs.join(own.select(F.col("id").alias("query_id"), F.col("label").alias("l1")), "query_id").join(
        own.select(F.col("id").alias("expected_id"), F.col("label").alias("l2")), "expected_id")
    return both.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum((F.col("l1") != F.col("l2")).cast("long")).alias("wrong")).withColumn("expected", F.lit(500).cast("long"))


_SAME = "exp AS (SELECT a.id AS q, b.id AS c FROM v a JOIN v b ON a.label = b.label AND b.id = a.id + 10)"


@query("recall_mrr", f"""WITH {PAIRS_SQL}, {_SAME}, h AS (SELECT exp.q, min(near.rk) AS r FROM exp LEFT JOIN near ON near.q = exp.q AND near.c = exp.c AND near.rk <= 50 GROUP BY exp.q)
SELECT count(*) AS n_queries, {', '.join(f"{sql_rounded(f'avg(CASE WHEN r <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS recall_at_{k}" for k in (1, 5, 10, 20, 50))},
{sql_rounded('avg(coalesce(1.0::DOUBLE / r, 0))')} AS mrr FROM h""")
def _recall(spark, folder):
    v = vectors(spark, folder).select("id", "label")
    expected = v.select(F.col("id").alias("query_id"), "label", (F.col("id") + 10).alias("expected_id")).join(
        v.select(F.col("id").alias("expected_id"), "label"), ["expected_id", "label"]).select("query_id", "expected_id")
    out = recall_and_mrr(_neighbours(spark, folder, 50), expected)
    return out.select("n_queries", *[rounded(c).alias(c) for c in out.columns if c != "n_queries"])


@query("baseline_compare", f"""WITH {PAIRS_SQL}, {_CUT},
a AS (SELECT q, list(c) AS a FROM near WHERE rk <= 10 GROUP BY q), b AS (SELECT q, list(c) AS b FROM cutn GROUP BY q)
SELECT a.q AS query_id, len(list_intersect(a, b)) AS overlap_count, {sql_rounded('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS jaccard,
len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) < 0.70 AS alert FROM a JOIN b ON a.q = b.q""")
def _baseline(spark, folder):
    old, new = capture_baseline(_neighbours(spark, folder, 10)), capture_baseline(_neighbours(spark, folder, 10, 60))
    return compare_baseline(old, new).select("query_id", "overlap_count", rounded("jaccard").alias("jaccard"), "alert")


@query("baseline_gate", f"""WITH {PAIRS_SQL}, {_CUT},
a AS (SELECT q, list(c) AS a FROM near WHERE rk <= 10 GROUP BY q), b AS (SELECT q, list(c) AS b FROM cutn GROUP BY q),
j AS (SELECT len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM a JOIN b ON a.q = b.q)
SELECT count(*) AS n_tested, {sql_rounded('avg(j)')} AS mean_jaccard, count(*) FILTER (j < 0.70) AS n_alerts, avg(j) >= 0.85 AND count(*) FILTER (j < 0.70) = 0 AS passed FROM j""")
def _gate(spark, folder):
    old, new = capture_baseline(_neighbours(spark, folder, 10)), capture_baseline(_neighbours(spark, folder, 10, 60))
    return gate(compare_baseline(old, new)).withColumn("mean_jaccard", rounded("mean_jaccard"))


@query("score_drift", f"""WITH {PAIRS_SQL}, {_CUT}, m AS (SELECT (SELECT quantile_cont(score, 0.5) FROM near WHERE rk <= 10) AS a, (SELECT quantile_cont(score, 0.5) FROM cutn) AS b)
SELECT {sql_rounded('a', 6)} AS median_old, {sql_rounded('b', 6)} AS median_new, {sql_rounded('abs(a - b)', 6)} AS shift, abs(a - b) > 0.05 AS drifted FROM m""")
def _drift(spark, folder):
    out = score_drift(materialise(_neighbours(spark, folder, 10)), materialise(_neighbours(spark, folder, 10, 60)))
    return out.select(*[rounded(c, 6).alias(c) for c in ("median_old", "median_new", "shift")], "drifted")


@query("rank_correlation", f"""WITH {PAIRS_SQL}, {_CUT}, b AS (SELECT near.q, near.rk AS ra, cutn.rk AS rb FROM near JOIN cutn ON near.q = cutn.q AND near.c = cutn.c WHERE near.rk <= 10),
r AS (SELECT q, rank() OVER (PARTITION BY q ORDER BY ra) AS pa, rank() OVER (PARTITION BY q ORDER BY rb) AS pb FROM b)
SELECT q AS query_id, count(*) AS n_common, {sql_rounded('CASE WHEN count(*) > 1 THEN corr(pa, pb) END')} AS spearman FROM r GROUP BY q""")
def _spearman(spark, folder):
    out = rank_correlation(_neighbours(spark, folder, 10), _neighbours(spark, folder, 10, 60))
    return out.select("query_id", "n_common", rounded("spearman").alias("spearman"))


# --------------------------------------------------------- reading, writing

@query("typed_csv_read", f"""SELECT c_custkey::VARCHAR AS id, c_name AS name, c_nationkey AS label, {sql_rounded('c_acctbal', 2)} AS x, c_acctbal > 5000 AS hof,
CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '—' ELSE c_mktsegment END AS role FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def _typed_csv(spark, folder):
    """Customers as text, every row twice: a stale copy first; one segment has an unreadable number."""
    path = scratch_path(spark, "csv")
    c = table(spark, folder, "customer")
    text = c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("label"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("x"),
        F.when(F.col("c_acctbal") > 5000, "TRUE").otherwise("no").alias("hof"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "").otherwise(F.col("c_mktsegment")).alias("role"))
    stale = text.withColumn("name", F.lit("stale"))
    stale.write.option("header", True).csv(f"{path}/1-old")
    text.write.option("header", True).csv(f"{path}/2-new")
    columns = {"id": "string", "name": "string", "label": "whole", "x": "double", "hof": "flag"}
    out = read_points(spark, [f"{path}/1-old", f"{path}/2-new"], columns, "id", {"role": "—"})
    return out.withColumn("x", rounded("x", 2))


@query("csv_export", f"""WITH {VECTORS_SQL} SELECT id::VARCHAR AS id, role, {sql_rounded('vector[1]')} AS pca_1, {sql_rounded('vector[5]')} AS pca_5 FROM v""")
def _export(spark, folder):
    path = scratch_path(spark, "export")
    write_points(vectors(spark, folder).withColumn("pca", F.col("vector")).drop("vector"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("id", "role", rounded(F.col("pca_1").cast("double")).alias("pca_1"), rounded(F.col("pca_5").cast("double")).alias("pca_5"))


@query("json_roundtrip_io", """SELECT o_orderpriority, sum(n)::BIGINT AS total, count(*) AS n_values FROM (
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def _nested_io(spark, folder):
    path = scratch_path(spark, "json")
    write_nested(value_counts(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus"), path)
    back = spark.read.schema("o_orderpriority string, counts map<string,bigint>").json(path)
    return back.select(
        "o_orderpriority", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.size("counts").cast("long").alias("n_values"))


@query("edges_export", f"""WITH {PAIRS_SQL}, e AS (SELECT q AS src, c AS dst, rk AS rank FROM near WHERE rk <= 10)
SELECT 'all' AS part, * FROM e UNION ALL SELECT 'two' AS part, * FROM e WHERE src IN (3, 77)""")
def _edges_io(spark, folder):
    path = scratch_path(spark, "edges")
    write_edges(_neighbours(spark, folder, 10).withColumnsRenamed({"query_id": "src", "item_id": "dst"}), path)
    whole, two = read_edges(spark, path), read_edges(spark, path, [3, 77])
    return whole.select(F.lit("all").alias("part"), "src", "dst", "rank").unionByName(two.select(F.lit("two").alias("part"), "src", "dst", "rank"))


@query("baseline_io", f"WITH {PAIRS_SQL} SELECT q::VARCHAR AS query_id, string_agg(c::VARCHAR, ',' ORDER BY rk) AS ids FROM near WHERE rk <= 10 GROUP BY q")
def _baseline_io(spark, folder):
    path = scratch_path(spark, "baseline")
    write_baseline(capture_baseline(_neighbours(spark, folder, 10)), path)
    return read_baseline(spark, path).select("query_id", F.array_join("ids", ",").alias("ids"))


@query("step_checkpoint", f"SELECT o_orderpriority, count(*) AS n, {sql_rounded('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1")
def _step(spark, folder):
    """The second call reads what the first wrote: its builder would fail."""
    where, key = scratch_path(spark, "steps"), config_hash(RunParams())
    o = table(spark, folder, "orders")
    build = lambda: o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    step(spark, where, "totals", key, build)

    def fail():
        raise AssertionError("a finished step must not run again")

    return step(spark, where, "totals", key, fail).withColumn("total", rounded("total", 2))


@query("fact_merge_from_files", "SELECT count(*) AS n_rows, sum(n_orders)::BIGINT AS n_orders FROM (SELECT o_custkey, year(o_orderdate), count(*) AS n_orders FROM orders GROUP BY 1, 2)")
def _merge_files(spark, folder):
    """Facts written to CSV, read back with types and merged again."""
    path = scratch_path(spark, "facts")
    a = facts(spark, folder)[0].select("entity", "period", "status", "tag", "n_orders")
    a.write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.option("header", True).schema(a.schema).csv(path)
    merged = merge_facts([back, a], CFG.join_keys)
    return merged.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_orders").alias("n_orders"))


@query("profile_counts", """SELECT 14 AS n_measures, count(*) AS n FROM (
SELECT o_custkey FROM (SELECT o_custkey, year(o_orderdate) AS y FROM orders UNION SELECT user_id, year(ts) FROM events) GROUP BY 1 HAVING count(DISTINCT y) >= 5)""")
def _counts(spark, folder):
    return profiles(spark, folder).agg(F.lit(len(MEASURES)).alias("n_measures"), F.count(F.lit(1)).alias("n"))
