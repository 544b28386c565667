"""Sources, checks, profiles and scaling on customer x year facts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from profilekit.catalog.base import (
    COHORT_SQL, COHORTS, CUSTOMER_YEARS, FACTS_SQL, MEASURES, META_SQL, PROFILE_SQL,
    facts, query, rounded, show, sql_rounded, table,
)
from profilekit.config import RunParams, TableSpec, base_name
from profilekit.functions.vector import norm, top_contributions, unit
from profilekit.operators.merge import merge_facts, merge_report, schema_report
from profilekit.operators.nearest import nearest
from profilekit.operators.profile import (
    attach_dimension, build_profiles, eligible_entities, entity_meta, keep_eligible, mean_profile, variety_report,
)
from profilekit.operators.quality import quality_report
from profilekit.operators.scale import (
    add_composites, assemble, cohort_median_fill, cohort_zscore, median_fill, robust_scale, row_profile, standard_z, weight_columns,
)
from profilekit.plans.features import engineer
from profilekit.session import materialise, scratch_path
from profilekit.sources.index_store import index_rows
from profilekit.sources.tables import bad_row_counts, bad_rows, read_dimension, read_facts

CFG = CUSTOMER_YEARS
COUNTS = ["n_orders", "n_lines", "n_events"]
REALS = [c for c in MEASURES if c not in COUNTS]
GROUPS = {
    "volume_score": ["n_orders", "n_lines", "qty", "n_events"],
    "price_score": ["avg_order_price", "max_order_price", "avg_line_price"],
    "terms_score": ["avg_discount", "avg_tax", "return_share"],
}
# what the block rules must find, in order
CHOSEN = [
    "n_orders", "n_lines", "qty", "n_events",
    "avg_order_price", "max_order_price", "avg_line_price", "rare_price", "spend",
    "avg_discount", "avg_tax", "return_share",
]
SCORES = ["volume_score", "price_score", "terms_score", "empty_score"]


def merged(spark, folder):
    return merge_facts(facts(spark, folder), CFG.join_keys)


def profiles(spark, folder):
    return build_profiles(materialise(merged(spark, folder)), CFG, MEASURES, 5)


def profile_table(spark, folder):
    """Profiles written once, for operators that fit statistics before they transform."""
    return materialise(profiles(spark, folder))


# ------------------------------------------------------------ merge and checks

@query("merge_facts", f"""WITH {FACTS_SQL}
SELECT period, entity, status, tag, {', '.join(COUNTS)}, {', '.join(f'{sql_rounded(c)} AS {c}' for c in REALS)} FROM merged""")
def _merge_facts(spark, folder):
    return show(merged(spark, folder), ["period", "entity", "status", "tag", *COUNTS], REALS)


_TYPES = {"entity": "bigint", "status": "string", "tag": "string", "n_orders": "bigint", "n_lines": "bigint", "events": "bigint"}
FILES = replace(
    CFG, flag="building", dimension_measures=("balance",),
    fact_tables=tuple(TableSpec(n, f"{n}.csv", ("entity", "period"), types=_TYPES, rename={"events": "n_events"} if n == "events" else {})
                      for n in ("orders", "lines", "events")),
    dimension=TableSpec("customers", "customers.csv", ("entity",), types={"entity": "bigint", "balance": "double", "building": "boolean"}, other="string"),
)


def _as_files(spark, folder):
    """The fact tables and the customers as CSV, with the orders of every 50th customer again in lines that cannot be read."""
    where = scratch_path(spark, "csv")
    a, b, c = facts(spark, folder)
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance"), (F.col("c_mktsegment") == "BUILDING").alias("building"))
    for name, df in (("orders", a), ("lines", b.drop("n_orders")), ("events", c.withColumnRenamed("n_events", "events")), ("customers", customers)):
        df.write.option("header", True).csv(f"{where}/{name}.csv")
    broken = a.filter("entity % 50 = 0").select([F.lit("many").alias(n) if n == "n_orders" else F.col(n) for n in a.columns])
    broken.write.mode("append").option("header", True).csv(f"{where}/orders.csv")
    return where


@query("facts_from_csv", f"""WITH {FACTS_SQL}
SELECT period, m.entity, status, tag, {', '.join(COUNTS)}, {', '.join(f'{sql_rounded(c)} AS {c}' for c in REALS)},
       {sql_rounded('c_acctbal')} AS balance, c_mktsegment = 'BUILDING' AS building
FROM merged m LEFT JOIN customer ON m.entity = c_custkey""")
def _facts_from_csv(spark, folder):
    """All facts and the dimension through the readers, merged."""
    where = _as_files(spark, folder)
    both = merge_facts(read_facts(spark, where, FILES), CFG.join_keys).join(read_dimension(spark, where, FILES), "entity", "left")
    return show(both, ["period", "entity", "status", "tag", *COUNTS, "building"], [*REALS, "balance"])


@query("csv_bad_rows", """SELECT 'orders' AS table_name, count(*) AS n_bad, count(*) FILTER (c LIKE '%,many,%') AS n_shown
FROM (SELECT ',many,' AS c FROM orders WHERE o_custkey % 50 = 0 GROUP BY o_custkey, year(o_orderdate)) HAVING count(*) > 0""")
def _csv_bad_rows(spark, folder):
    """Lines that do not fit the declared types, with their text."""
    bad = bad_rows(spark, _as_files(spark, folder), [*FILES.fact_tables, FILES.dimension])
    shown = bad.groupBy("table_name").agg(F.count_if(F.col("record").contains(",many,")).alias("n_shown"))
    return bad_row_counts(bad).groupBy("table_name").agg(F.sum("n_bad").alias("n_bad")).join(shown, "table_name")


@query("merge_facts_unique_keys", f"""WITH {FACTS_SQL},
e AS (SELECT entity, period, count(*) AS n_lines, sum(l_quantity) AS qty FROM
      (SELECT l_suppkey AS entity, year(l_shipdate) AS period, l_quantity FROM lineitem) GROUP BY 1, 2),
f AS (SELECT l_partkey AS entity, year(l_shipdate) AS period, avg(l_tax) AS avg_tax FROM lineitem GROUP BY 1, 2)
SELECT coalesce(e.entity, f.entity) AS entity, coalesce(e.period, f.period) AS period, n_lines,
       {sql_rounded('qty')} AS qty, {sql_rounded('avg_tax')} AS avg_tax
FROM e FULL JOIN f ON e.entity = f.entity AND e.period = f.period""")
def _merge_unique(spark, folder):
    l = table(spark, folder, "lineitem")
    year = F.year("l_shipdate").alias("period")
    a = l.groupBy(F.col("l_suppkey").alias("entity"), year).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    b = l.groupBy(F.col("l_partkey").alias("entity"), year).agg(F.avg("l_tax").alias("avg_tax"))
    return show(merge_facts([a, b], ("entity", "period"), unique_keys=True), ["entity", "period", "n_lines"], ["qty", "avg_tax"])


@query("merge_integrity", f"""WITH {FACTS_SQL},
slim AS (SELECT period, status, n_orders FROM merged),
d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM slim))
SELECT 'merged' AS step, count(*) AS row_count, 3 AS column_count, count(*) - (SELECT n FROM d) AS duplicate_rows,
       false AS has_suffix_columns, count(*) >= 1 AS row_count_ok,
       count(*) > 0 AND count(*) - (SELECT n FROM d) = 0 AS is_valid FROM slim""")
def _merge_integrity(spark, folder):
    return merge_report(merged(spark, folder).select("period", "status", "n_orders"), "merged")


def _schema_sql(name: str, required: list[str], min_rows: int) -> str:
    need = ", ".join(f"('{c}')" for c in required)
    return f"""SELECT '{name}' AS "table", true AS "exists",
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM (VALUES {need}) r(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE {name}))), '') AS missing,
  coalesce((SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {name}) WHERE column_name NOT IN (SELECT c FROM (VALUES {need}) r(c))), '') AS extra,
  (SELECT count(*) FROM {name}) AS row_count, (SELECT count(*) FROM {name}) >= {min_rows} AS row_count_ok"""


_SPECS = (
    TableSpec("orders", "orders.parquet", ("o_orderkey", "o_custkey", "o_orderdate", "o_clerk"), 500),
    TableSpec("lineitem", "lineitem.parquet", ("l_orderkey", "l_quantity"), 500),
    TableSpec("region", "region.parquet", ("r_regionkey", "r_name"), 100),
    TableSpec("customer", "customer.parquet", ("c_custkey", "c_name", "c_phone", "c_comment"), 100),
)


@query("schema_report", " UNION ALL ".join(_schema_sql(s.name, list(s.required), s.min_rows) for s in _SPECS))
def _schema_report(spark, folder):
    report = schema_report({s.name: table(spark, folder, s.name) for s in _SPECS}, _SPECS)
    return report.select(
        "table", "exists", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"),
        "row_count", "row_count_ok",
    )


@query("quality_report", f"""WITH {PROFILE_SQL},
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c}::DOUBLE AS x FROM profile" for c in MEASURES)}),
st AS (SELECT col, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY col)
SELECT long.col AS "column", count(*) - count(x) AS missing_count,
       round((count(*) - count(x)) / count(*), 4) AS missing_rate,
       count(CASE WHEN s > 0 AND abs((x - m) / s) > 2 THEN 1 END) AS outlier_count,
       (count(*) - count(x)) / count(*) > 0.30 AS flagged
FROM long JOIN st ON long.col = st.col GROUP BY long.col""")
def _quality_report(spark, folder):
    return quality_report(profile_table(spark, folder), MEASURES, 0.30, 2.0)


# ------------------------------------------------------------------ profiles

@query("eligible_entities", f"""WITH {FACTS_SQL}
SELECT entity, count(DISTINCT period) AS total_periods FROM merged GROUP BY entity HAVING count(DISTINCT period) >= 5""")
def _eligible(spark, folder):
    return eligible_entities(merged(spark, folder), "entity", "period", 5)


@query("eligible_entities_approximate", f"""WITH {FACTS_SQL}
SELECT entity, count(DISTINCT period) AS total_periods FROM merged GROUP BY entity HAVING count(DISTINCT period) >= 5""")
def _eligible_approx(spark, folder):
    """With at most a handful of periods per entity the sketch counts exactly."""
    return eligible_entities(merged(spark, folder), "entity", "period", 5, approximate=True)


@query("keep_eligible", f"""WITH {FACTS_SQL}
SELECT period, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM merged
WHERE entity IN (SELECT entity FROM merged GROUP BY entity HAVING count(DISTINCT period) >= 5) GROUP BY period""")
def _keep_eligible(spark, folder):
    kept = keep_eligible(merged(spark, folder), "entity", "period", 5)
    return kept.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("n_entities"))


@query("mean_profile", f"""WITH {FACTS_SQL}
SELECT entity, {', '.join(f'{sql_rounded(f"avg({c})")} AS {c}' for c in MEASURES)} FROM merged GROUP BY entity""")
def _mean_profile(spark, folder):
    return show(mean_profile(merged(spark, folder), "entity", MEASURES), ["entity"], MEASURES)


@query("entity_meta", f"""WITH {FACTS_SQL}, {META_SQL}
SELECT m.entity, debut_period, final_period, total_periods, name, coalesce(r.status, 'UNK') AS primary_role, {COHORT_SQL} AS cohort
FROM meta m LEFT JOIN roles r ON m.entity = r.entity""")
def _entity_meta(spark, folder):
    return entity_meta(merged(spark, folder), CFG)


@query("entity_profiles", f"""WITH {PROFILE_SQL}
SELECT entity, name, primary_role, cohort, total_periods, c_mktsegment, coalesce(c_acctbal > 5000, false) AS rich,
       {', '.join(f'{sql_rounded(c)} AS {c}' for c in MEASURES)}
FROM profile LEFT JOIN customer ON entity = c_custkey""")
def _profiles(spark, folder):
    dim = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), "c_mktsegment", (F.col("c_acctbal") > 5000).alias("rich"))
    out = attach_dimension(profiles(spark, folder), dim, "entity", ["c_mktsegment"], "rich")
    return show(out, ["entity", "name", "primary_role", "cohort", "total_periods", "c_mktsegment", "rich"], MEASURES)


@query("cohort_bucket", f"""WITH o AS (SELECT o_custkey AS entity, min(year(o_orderdate)) AS debut_period FROM orders GROUP BY 1)
SELECT {COHORT_SQL} AS cohort, count(*) AS n FROM o GROUP BY 1""")
def _cohort_bucket(spark, folder):
    from profilekit.functions.scalar import cohort_of

    first = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("debut_period"))
    return first.groupBy(cohort_of(F.col("debut_period"), COHORTS).alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


_VARIETY = ["l_quantity", "l_tax", "always", "never"]


@query("drop_constant_cols", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({e}) AS n_values, coalesce(min({e}) = max({e}), false) AS is_constant, count({e}) = 0 AS is_empty FROM lineitem"""
    for c, e in (("l_quantity", "l_quantity"), ("l_tax", "l_tax"), ("always", "l_quantity - l_quantity"), ("never", "nullif(l_tax, l_tax)"))))
def _variety(spark, folder):
    l = table(spark, folder, "lineitem").withColumns({
        "always": F.col("l_quantity") - F.col("l_quantity"), "never": F.nullif(F.col("l_tax"), F.col("l_tax"))})
    return variety_report(l, _VARIETY)


# ------------------------------------------------------------------- scaling

_MEDIANS = f"med AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) AS {c}' for c in MEASURES)} FROM profile)"
_FILLED = f"filled AS (SELECT p.entity, p.cohort, {', '.join(f'coalesce(p.{c}, med.{c}) AS {c}' for c in MEASURES)} FROM profile p, med)"


@query("median_impute", f"""WITH {PROFILE_SQL}, {_MEDIANS}, {_FILLED}
SELECT entity, {', '.join(f'{sql_rounded(c)} AS {c}' for c in MEASURES)} FROM filled""")
def _median_impute(spark, folder):
    return show(median_fill(profile_table(spark, folder), MEASURES), ["entity"], MEASURES)


@query("cohort_median_impute", f"""WITH {PROFILE_SQL}, {_MEDIANS},
cm AS (SELECT cohort, {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) AS {c}' for c in MEASURES)} FROM profile GROUP BY cohort)
SELECT entity, p.cohort, {', '.join(f'{sql_rounded(f"coalesce(p.{c}, cm.{c}, med.{c})")} AS {c}' for c in MEASURES)}
FROM profile p JOIN cm ON p.cohort = cm.cohort, med""")
def _cohort_median(spark, folder):
    return show(cohort_median_fill(profile_table(spark, folder), MEASURES, "cohort"), ["entity", "cohort"], MEASURES)


_STATS = f"st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}' for c in MEASURES)} FROM filled)"


@query("standard_z", f"""WITH {PROFILE_SQL}, {_MEDIANS}, {_FILLED}, {_STATS}
SELECT entity, {', '.join(f'{sql_rounded(f"({c} - m_{c}) / s_{c}")} AS {c}' for c in REALS)} FROM filled, st""")
def _standard_z(spark, folder):
    z = standard_z(median_fill(profile_table(spark, folder), REALS), REALS, "_z")
    return z.select("entity", *[rounded(f"{c}_z").alias(c) for c in REALS])


def _score_sql(cols: list[str]) -> str:
    return "(" + " + ".join(f"({c} - m_{c}) / s_{c}" for c in cols) + f") / {len(cols)}.0::DOUBLE"


@query("composites", f"""WITH {PROFILE_SQL}, {_MEDIANS}, {_FILLED}, {_STATS}
SELECT entity, {', '.join(f'{sql_rounded(_score_sql(c))} AS {n}' for n, c in GROUPS.items())}, 0.0::DOUBLE AS empty_score FROM filled, st""")
def _composites(spark, folder):
    out = add_composites(profile_table(spark, folder), {**GROUPS, "empty_score": []})
    return show(out, ["entity"], SCORES)


_COHORT_STATS = f"""cs AS (SELECT cohort, {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END AS s_{c}' for c in MEASURES)}
FROM profile GROUP BY cohort)"""
_ADJUSTED = f"adj AS (SELECT entity, p.cohort, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in MEASURES)} FROM profile p JOIN cs ON p.cohort = cs.cohort)"


@query("cohort_zscore", f"""WITH {PROFILE_SQL}, {_COHORT_STATS}, {_ADJUSTED}
SELECT entity, cohort, {', '.join(f'{sql_rounded(c)} AS {c}' for c in MEASURES)} FROM adj""")
def _cohort_z(spark, folder):
    z = cohort_zscore(profiles(spark, folder), MEASURES, "cohort", "_adj")
    return z.select("entity", "cohort", *[rounded(f"{c}_adj").alias(c) for c in MEASURES])


def _robust(c: str) -> str:
    low, mid, high = (f"quantile_cont({c}::DOUBLE, {p}) OVER ()" for p in (0.05, 0.5, 0.95))
    return f"({c} - {mid}) / CASE WHEN {high} - {low} = 0 THEN 1 ELSE {high} - {low} END"


@query("robust_scale", f"""WITH {PROFILE_SQL}, s AS (SELECT entity, {', '.join(f'{_robust(c)} AS {c}' for c in REALS)} FROM profile)
SELECT entity, {', '.join(f'{sql_rounded(c)} AS {c}' for c in REALS)} FROM s""")
def _robust_scale(spark, folder):
    return show(robust_scale(profile_table(spark, folder), REALS), ["entity"], REALS)


# the whole chain: chosen columns and composites, cohort z, global median, robust scale, volume weighted by 2
_ALL = CHOSEN + SCORES
_CHAIN = f"""{PROFILE_SQL}, {_MEDIANS}, {_FILLED}, {_STATS},
scored AS (SELECT p.*, {', '.join(f'f.{n}' for n in SCORES)} FROM profile p JOIN (
  SELECT entity, {', '.join(f'{_score_sql(c)} AS {n}' for n, c in GROUPS.items())}, 0.0::DOUBLE AS empty_score FROM filled, st) f ON p.entity = f.entity),
cst AS (SELECT cohort, {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END AS s_{c}' for c in _ALL)} FROM scored GROUP BY cohort),
zed AS (SELECT entity, p.cohort, p.name, p.primary_role, p.debut_period, {', '.join(f'(p.{c} - cst.m_{c}) / cst.s_{c} AS {c}' for c in _ALL)} FROM scored p JOIN cst ON p.cohort = cst.cohort),
zmed AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _ALL)} FROM zed),
zfull AS (SELECT z.entity, z.cohort, z.name, z.primary_role, z.debut_period, {', '.join(f'coalesce(z.{c}, zmed.{c}) AS {c}' for c in _ALL)} FROM zed z, zmed),
scaled AS (SELECT entity, cohort, name, primary_role, debut_period, {', '.join(f'{_robust(c)} AS {c}' for c in _ALL)} FROM zfull)"""


def _weighted(c: str) -> str:
    return f"{c} * 2" if "n_" in c or "qty" in c else c


@query("feature_vectors", f"""WITH {_CHAIN}
SELECT entity, cohort, {', '.join(f'{sql_rounded(_weighted(c))} AS {c}' for c in _ALL)} FROM scaled""")
def _feature_vectors(spark, folder):
    found = engineer(facts(spark, folder), None, CFG, RunParams(block_weights={"volume": 2.0}))
    names = [n.replace("_era_adj", "") for n in found.names]
    return found.vectors.select("entity", "cohort", *[rounded(F.get("features", F.lit(i))).alias(n) for i, n in enumerate(names)])


@query("weight_blocks", f"""WITH {PROFILE_SQL}
SELECT entity, {', '.join(f'{sql_rounded(f"{c} * 3" if "price" in c or "spend" in c else c)} AS {c}' for c in MEASURES)} FROM profile""")
def _weights(spark, folder):
    return show(weight_columns(profiles(spark, folder), MEASURES, {"price": 3.0}, CFG), ["entity"], MEASURES)


@query("l2_norm", f"""WITH {PROFILE_SQL},
z AS (SELECT entity, coalesce(n_orders, 0) AS a, coalesce(avg_tax, 0) AS b, coalesce(avg_qty, 0) AS c FROM profile),
u AS (SELECT *, sqrt(a * a + b * b + c * c) AS len, CASE WHEN len = 0 THEN 1 ELSE len END AS d FROM z)
SELECT entity, {sql_rounded('len')} AS length, {sql_rounded('a / d', 6)} AS u1, {sql_rounded('b / d', 6)} AS u2, {sql_rounded('c / d', 6)} AS u3 FROM u""")
def _l2(spark, folder):
    """Lengths of all entities; a missing value counts as 0, and a vector of zeros stays one."""
    p = assemble(profiles(spark, folder).fillna(0, ["n_orders", "avg_tax", "avg_qty"]), ["n_orders", "avg_tax", "avg_qty"], "v")
    u = unit(F.col("v"))
    return p.select("entity", rounded(norm(F.col("v"))).alias("length"), *[rounded(F.get(u, F.lit(i)), 6).alias(f"u{i + 1}") for i in range(3)])


_ROW = ["avg_order_price", "max_order_price", "avg_qty", "spend"]


@query("row_z_profile", f"""WITH {PROFILE_SQL},
f AS (SELECT entity, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _ROW)} FROM profile),
st2 AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS s_{c}' for c in _ROW)} FROM f),
long AS ({' UNION ALL '.join(f"SELECT entity, '{c}' AS feature, {i} AS pos, ({c} - m_{c}) / s_{c} AS z FROM f, st2" for i, c in enumerate(_ROW))}),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(abs(z), 9) DESC, pos) AS rank FROM long)
SELECT entity, rank, feature, {sql_rounded('z', 3)} AS z_score, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM r WHERE rank <= 3""")
def _row_profile(spark, folder):
    """All entities; a missing value counts as 0."""
    p = assemble(profile_table(spark, folder).fillna(0, _ROW), _ROW, "v")
    top = row_profile(p, "v", _ROW, 3).select("entity", F.posexplode("top_features").alias("rank", "f"))
    return top.select("entity", (F.col("rank") + 1).alias("rank"), "f.feature", rounded("f.z_score", 3).alias("z_score"), "f.direction")


# ------------------------------------------------------------------ flagship

_VEC = "[" + ", ".join(_ALL) + "]"


@query("similar_customers", f"""WITH {_CHAIN},
vec AS (SELECT entity, {_VEC} AS x FROM scaled),
u AS (SELECT entity, list_transform(x, lambda e: e / CASE WHEN list_dot_product(x, x) = 0 THEN 1 ELSE sqrt(list_dot_product(x, x)) END) AS x FROM vec),
p AS (SELECT a.entity AS entity, b.entity AS other, round(list_dot_product(a.x, b.x), 9) AS score, a.x AS ax, b.x AS bx
      FROM u a JOIN u b ON a.entity <> b.entity),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, other) AS rank FROM p),
t AS (SELECT entity, other, rank, score, unnest([{', '.join(f"'{c}'" for c in _ALL)}]) AS feature,
             unnest(list_transform(list_zip(ax, bx), lambda e: e[1] * e[2])) AS part, generate_subscripts(ax, 1) AS pos
      FROM r WHERE rank <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY entity, other ORDER BY round(abs(part / score), 6) DESC, pos) AS n FROM t)
SELECT entity, other, rank, {sql_rounded('score')} AS similarity, feature AS main_feature FROM f WHERE n = 1 AND score > 0""")
def _similar_customers(spark, folder):
    found = engineer(facts(spark, folder), None, CFG, RunParams())
    index = materialise(index_rows(found.vectors, "entity", "features"))
    items = index.withColumnsRenamed({"id": "item_id", "vector": "item_vec"})
    asked = index.withColumnsRenamed({"id": "query_id", "vector": "query_vec"})
    pairs = nearest(asked, items, 5).join(asked, "query_id").join(items, "item_id")
    top = top_contributions(F.col("query_vec"), F.col("item_vec"), [base_name(n) for n in found.names], 1)
    return pairs.filter(F.col("score") > 0).select(
        F.col("query_id").alias("entity"), F.col("item_id").alias("other"), "rank",
        rounded("score").alias("similarity"), F.get(top, F.lit(0))["feature"].alias("main_feature"),
    )
