"""Registration, rounding and the inputs that several queries share."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit.config import BlockRule, CompositeRule, ProfileConfig
from profilekit.functions.vector import as_double, unit
from profilekit.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL with the same result."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Doubles are compared after the same floor-based rounding on both sides. The half
# is shifted a little, because means of two-decimal prices often end exactly on a half.

def rounded(value: Column | str, places: int = 4) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return (F.floor(c * F.lit(10.0 ** places) + F.lit(0.50001)) / F.lit(10.0 ** places)).cast("double")


def sql_rounded(expr: str, places: int = 4) -> str:
    return f"(floor(({expr}) * {10 ** places}.0::DOUBLE + 0.50001::DOUBLE) / {10 ** places}.0::DOUBLE)::DOUBLE"


def show(df: DataFrame, keep: list[str], doubles: list[str], places: int = 4) -> DataFrame:
    return df.select(*keep, *[rounded(c, places).alias(c) for c in doubles])


# ------------------------------------------------ customer x year fact tables

A_COLUMNS = ["n_orders", "spend", "avg_order_price", "max_order_price"]
B_COLUMNS = ["n_lines", "qty", "avg_qty", "avg_discount", "avg_tax", "avg_line_price", "rare_price", "return_share"]
C_COLUMNS = ["n_events", "avg_event_value"]
MEASURES = A_COLUMNS + B_COLUMNS + C_COLUMNS

COHORTS = {"early": (1900, 1995), "middle": (1996, 1996), "late": (1997, 2000)}

CUSTOMER_YEARS = ProfileConfig(
    entity="entity",
    period="period",
    name="tag",
    role="status",
    context_keys=("status", "tag"),
    cohorts=COHORTS,
    blocks={
        "volume": BlockRule(("n_orders", "n_lines", "qty", "n_events")),
        "price": BlockRule(("price", "spend")),
        "terms": BlockRule(("avg_discount", "avg_tax", "return_share"), exact=True, merge_variants=False),
    },
    concept_variants={"avg_qty": "qty"},
    composites={
        "volume_score": CompositeRule(("volume",)),
        "price_score": CompositeRule(("price",), ("avg", "max")),
        "terms_score": CompositeRule(("terms",)),
        "empty_score": CompositeRule(("nothing",)),
    },
    weight_rules=(("volume", ("n_", "qty")), ("price", ("price", "spend"))),
    search_blocks={
        "volume": ("n_orders", "n_lines", "qty", "n_events", "volume_score"),
        "price": ("price", "spend"),
        "terms": ("avg_discount", "avg_tax", "return_share", "terms_score"),
    },
)


def _keys() -> list[Column]:
    """Context keys of a year: the last status letter (none for P) and the lowest priority.

    Taken as maxima of numbers: a maximum of texts would turn the hash aggregate into a sort.
    """
    return [
        F.nullif(F.chr(F.max(F.ascii("o_orderstatus"))), F.lit("P")).alias("status"),
        F.concat(F.lit("P"), F.max(F.substring("o_orderpriority", 1, 1).cast("int"))).alias("tag"),
    ]


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")).agg(
        *_keys(),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("spend"),
        F.avg("o_totalprice").alias("avg_order_price"),
        F.max("o_totalprice").alias("max_order_price"),
    )


def line_facts(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    l = table(spark, folder, "lineitem")
    rare = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08)
    return (
        l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")).agg(
            *_keys(),
            F.countDistinct("l_orderkey").alias("n_orders"),
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.avg("l_quantity").alias("avg_qty"),
            F.avg("l_discount").alias("avg_discount"),
            F.avg("l_tax").alias("avg_tax"),
            F.avg("l_extendedprice").alias("avg_line_price"),
            F.avg(F.when(rare, F.col("l_extendedprice"))).alias("rare_price"),
            F.avg((F.col("l_returnflag") == "R").cast("double")).alias("return_share"),
        )
    )


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.col("user_id").alias("entity"), F.year("ts").alias("period")).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("avg_event_value"),
    )


def facts(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [order_facts(spark, folder), line_facts(spark, folder), event_facts(spark, folder)]


_M1 = ["period", "entity", "status", "tag"]
FACTS_SQL = f"""
fa AS (
  SELECT o_custkey AS entity, year(o_orderdate) AS period, nullif(max(o_orderstatus), 'P') AS status,
         'P' || max(o_orderpriority[1]::INT) AS tag, count(*) AS n_orders, sum(o_totalprice) AS spend,
         avg(o_totalprice) AS avg_order_price, max(o_totalprice) AS max_order_price
  FROM orders GROUP BY 1, 2),
fb AS (
  SELECT o_custkey AS entity, year(o_orderdate) AS period, nullif(max(o_orderstatus), 'P') AS status,
         'P' || max(o_orderpriority[1]::INT) AS tag, count(*) AS n_lines, sum(l_quantity) AS qty, avg(l_quantity) AS avg_qty,
         avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax, avg(l_extendedprice) AS avg_line_price,
         avg(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount > 0.08 THEN l_extendedprice END) AS rare_price,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS return_share
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
fc AS (
  SELECT user_id AS entity, year(ts) AS period, count(*) AS n_events, avg(value) AS avg_event_value
  FROM events GROUP BY 1, 2),
m1 AS (
  SELECT {', '.join(f'coalesce(a.{k}, b.{k}) AS {k}' for k in _M1)},
         {', '.join('a.' + c for c in A_COLUMNS)}, {', '.join('b.' + c for c in B_COLUMNS)}
  FROM fa a FULL JOIN fb b ON {' AND '.join(f'a.{k} IS NOT DISTINCT FROM b.{k}' for k in _M1)}),
merged AS (
  SELECT coalesce(m.period, c.period) AS period, coalesce(m.entity, c.entity) AS entity, m.status, m.tag,
         {', '.join('m.' + c for c in A_COLUMNS + B_COLUMNS)}, {', '.join('c.' + c for c in C_COLUMNS)}
  FROM m1 m FULL JOIN fc c ON m.period IS NOT DISTINCT FROM c.period AND m.entity IS NOT DISTINCT FROM c.entity)"""

COHORT_SQL = ("CASE " + " ".join(f"WHEN debut_period BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in COHORTS.items())
              + " ELSE 'Unknown' END")

META_SQL = f"""
meta AS (
  SELECT entity, min(period) AS debut_period, max(period) AS final_period, count(DISTINCT period) AS total_periods,
         first(tag ORDER BY period, tag) FILTER (tag IS NOT NULL) AS name
  FROM merged GROUP BY entity),
roles AS (
  SELECT entity, status FROM (
    SELECT entity, status, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, status) AS rn
    FROM merged WHERE status IS NOT NULL GROUP BY entity, status) WHERE rn = 1)"""

PROFILE_SQL = FACTS_SQL + "," + META_SQL + f""",
means AS (SELECT entity, {', '.join(f'avg({c}) AS {c}' for c in MEASURES)} FROM merged GROUP BY entity),
profile AS (
  SELECT m.*, {COHORT_SQL} AS cohort, coalesce(r.status, 'UNK') AS primary_role, {', '.join('x.' + c for c in MEASURES)}
  FROM meta m JOIN means x ON m.entity = x.entity LEFT JOIN roles r ON m.entity = r.entity
  WHERE m.total_periods >= 5)"""


# --------------------------------------------------------------- embeddings

def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Unit vectors with a role, a period and a flag taken from the table's label."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        unit(as_double(F.col("embedding"))).alias("vector"),
        F.col("label").cast("int").alias("label"),
        F.concat(F.lit("r"), F.col("label")).alias("role"),
        (F.col("label") + 2000).cast("int").alias("period"),
        F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("name"),
    )


DIMENSION = 64
FEATURE_NAMES = [f"f{i:02d}" for i in range(DIMENSION)]
BLOCKS = {f"b{b}": list(range(8 * b, 8 * b + 8)) for b in range(8)}

VECTORS_SQL = """
raw AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
v AS (
  SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vector, label, 'r' || label AS role,
         label + 2000 AS period, 'v' || lpad(id::VARCHAR, 6, '0') AS name
  FROM raw)"""

PAIRS_SQL = VECTORS_SQL + """,
pairs AS (
  SELECT a.id AS q, b.id AS c, round(list_dot_product(a.vector, b.vector), 9) AS score,
         a.vector AS qv, b.vector AS cv, a.role AS q_role, b.role AS c_role, b.period AS c_period
  FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rk FROM pairs)"""
