"""Joining fact tables and checking the result."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import TableSpec


def cast_period(df: DataFrame, period: str) -> DataFrame:
    """Period as int; a missing or unreadable period is an error, not a silent null."""
    whole = F.expr(f"try_cast(`{period}` as int)")
    return df.withColumn(
        period,
        F.coalesce(whole, F.raise_error(F.lit(f"'{period}' must be a whole number in every row")).cast("int")),
    )


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k in left.columns and k in right.columns]


def outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on the shared keys. Null keys match null keys; the left table wins on other overlaps."""
    on = shared_keys(left, right, keys)
    if not on:
        raise ValueError("the tables share none of the join keys")
    new = [c for c in right.columns if c not in left.columns]
    a = left.alias("a")
    b = right.select(*on, *new).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on])
    kept = [
        (F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in on else F.col(f"a.{c}")).alias(c)
        for c in left.columns
    ]
    return a.join(b, same, "full").select(*kept, *[F.col(f"b.{c}").alias(c) for c in new])


def merge_facts(tables: Sequence[DataFrame], keys: Sequence[str], unique_keys: bool = False) -> DataFrame:
    """Merge period tables in their order.

    ``unique_keys`` promises that no table has two rows with the same keys. When
    all tables also carry the same keys, the chain of joins becomes one union and
    one aggregation: a single shuffle instead of one pair of shuffles per table.
    """
    on = [k for k in keys if k in tables[0].columns]
    same_keys = all([k for k in keys if k in t.columns] == on for t in tables)
    if not (unique_keys and same_keys):
        return reduce(lambda acc, t: outer_merge(acc, t, keys), tables)
    seen: set[str] = set(on)
    parts, values = [], []
    for t in tables:
        new = [c for c in t.columns if c not in seen]
        seen.update(new)
        values += new
        parts.append(t.select(*on, *new))
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return stacked.groupBy(*on).agg(*[F.max(c).alias(c) for c in values]) if values else stacked.distinct()


def merge_report(df: DataFrame, step: str, min_rows: int = 1) -> DataFrame:
    """One row: size, duplicate rows and suffix columns left behind by overlapping joins."""
    suffixed = [c for c in df.columns if c.endswith(("_x", "_y"))]
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    counted = per_row.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return counted.select(
        F.lit(step).alias("step"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        "duplicate_rows",
        F.lit(bool(suffixed)).alias("has_suffix_columns"),
        (F.col("row_count") >= min_rows).alias("row_count_ok"),
        ((F.col("row_count") > 0) & (F.col("duplicate_rows") == 0) & F.lit(not suffixed)).alias("is_valid"),
    )


def schema_report(tables: Mapping[str, DataFrame | None], specs: Sequence[TableSpec]) -> DataFrame:
    """One row per specified table: existence, missing and extra columns, row count. Nothing is raised here."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    schema = (
        "table string, exists boolean, missing array<string>, extra array<string>, "
        "row_count bigint, row_count_ok boolean, is_valid boolean"
    )
    rows = []
    for spec in specs:
        df = tables.get(spec.name)
        if df is None:
            rows.append(spark.createDataFrame([(spec.name, False, [], [], 0, True, False)], schema))
            continue
        missing = sorted(set(spec.required) - set(df.columns))
        extra = sorted(set(df.columns) - set(spec.required))
        enough = F.col("row_count") >= spec.min_rows
        texts = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
        rows.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(spec.name).alias("table"),
                F.lit(True).alias("exists"),
                texts(missing).alias("missing"),
                texts(extra).alias("extra"),
                "row_count",
                enough.alias("row_count_ok"),
                (enough & F.lit(not missing)).alias("is_valid"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), rows)


def require_valid_schemas(report: DataFrame) -> None:
    """Raise once, with every failing table named (one row per configured table)."""
    bad = report.filter(~F.col("is_valid")).collect()
    if bad:
        raise ValueError("; ".join(
            f"{r['table']}: " + ("not found" if not r["exists"] else f"missing {r['missing']}, rows {r['row_count']}")
            for r in bad
        ))
