"""Merging, checking, profiling and scaling on hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import ProfileConfig, TableSpec
from profilekit.operators.merge import cast_period, merge_facts, merge_report, outer_merge, require_valid_schemas, schema_report
from profilekit.operators.profile import SKETCH_LG, attach_dimension, build_profiles, eligible_entities, entity_meta, nan_to_null, varying_columns
from profilekit.operators.quality import quality_report
from profilekit.operators.scale import (
    add_composites, assemble, cohort_median_fill, cohort_zscore, median_fill, robust_scale, row_profile, standard_z,
)
from profilekit.operators.stats import exact_quantiles

CFG = ProfileConfig("player_id", "season", "player", "pos", cohorts={"old": (1900, 1999), "new": (2000, 2010)})


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture()
def tables(spark):
    a = spark.createDataFrame([(2000, "p1", None, 1.0), (2001, "p1", "T", 2.0), (2000, "p2", "T", 3.0)], "season int, player_id string, team string, x double")
    b = spark.createDataFrame([(2000, "p1", None, 9.0, 5.0), (2002, "p3", "T", 8.0, 6.0)], "season int, player_id string, team string, x double, y double")
    c = spark.createDataFrame([(2000, "p1", 7.0), (2009, "p9", 1.0)], "season int, player_id string, z double")
    return [a, b, c]


def test_null_keys_match_and_first_table_wins(tables):
    out = outer_merge(tables[0], tables[1], ("season", "player_id", "team"))
    assert rows(out, "season", "player_id", "team", "x", "y") == sorted([
        (2000, "p1", None, 1.0, 5.0), (2001, "p1", "T", 2.0, None), (2000, "p2", "T", 3.0, None), (2002, "p3", "T", None, 6.0)], key=str)


def test_fold_of_three_tables_uses_shared_keys_only(tables):
    out = merge_facts(tables, ("season", "player_id", "team"))
    got = {(r.season, r.player_id): r.z for r in out.collect()}
    assert got[(2000, "p1")] == 7.0 and got[(2009, "p9")] == 1.0 and out.count() == 5


def test_unique_key_merge_equals_joins(tables):
    two = tables[:2]
    keys = ("season", "player_id", "team")
    a, b = merge_facts(two, keys), merge_facts(two, keys, unique_keys=True)
    assert rows(a, *a.columns) == rows(b, *a.columns)


def test_renamed_key_that_never_matches_keeps_rows_apart(spark):
    totals = spark.createDataFrame([(2000, "p1", 2000.0, 1.0)], "season int, player_id string, mp double, a double")
    per_game = spark.createDataFrame([(2000, "p1", 30.5, 2.0)], "season int, player_id string, mp double, b double")
    assert merge_facts([totals, per_game], ("season", "player_id", "mp")).count() == 2
    assert merge_facts([totals, per_game], ("season", "player_id")).count() == 1


def test_merge_report_counts_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2)], "k int, v_x int")
    r = merge_report(df, "step").first()
    assert (r.row_count, r.column_count, r.duplicate_rows, r.has_suffix_columns, r.is_valid) == (3, 2, 1, True, False)


def test_bad_period_is_an_error(spark):
    df = spark.createDataFrame([("2000",), (None,)], "season string")
    with pytest.raises(Exception, match="whole number"):
        cast_period(df, "season").collect()
    assert cast_period(df.limit(1), "season").first()[0] == 2000


def test_schema_report_collects_all_failures(spark):
    specs = (TableSpec("a", "a.csv", ("k", "v"), 5), TableSpec("b", "b.csv", ("k",)), TableSpec("c", "c.csv", ("k",), 1))
    report = schema_report({"a": spark.createDataFrame([(1, 2)], "k int, w int"), "b": None, "c": spark.range(3).withColumnRenamed("id", "k")}, specs)
    got = {r["table"]: r for r in report.collect()}
    assert got["a"]["missing"] == ["v"] and got["a"]["extra"] == ["w"] and not got["a"]["row_count_ok"]
    assert not got["b"]["exists"] and got["c"]["is_valid"]
    with pytest.raises(ValueError, match="a: .*b: not found"):
        require_valid_schemas(report)


@pytest.fixture()
def seasons(spark):
    data = []
    for p, first, n in (("p1", 1998, 5), ("p2", 2001, 6), ("p3", 2001, 2)):
        for i in range(n):
            data.append((first + i, p, f"{p} name {i}" if i else None, ["G", "F"][i % 2] if p != "p2" else None, float(i), float("nan") if i == 0 else 1.0))
    return nan_to_null(spark.createDataFrame(data, "season int, player_id string, player string, pos string, x double, y double"))


def test_metadata_and_eligibility(seasons):
    meta = {r.player_id: r for r in entity_meta(seasons, CFG).collect()}
    assert meta["p1"].debut_period == 1998 and meta["p1"].cohort == "old" and meta["p1"].primary_role == "G"
    assert meta["p1"].name == "p1 name 1"  # first non-null name by period
    assert meta["p2"].primary_role == "UNK" and meta["p3"].primary_role == "F"  # tie goes to the smaller
    assert [r.player_id for r in eligible_entities(seasons, "player_id", "season", 5).orderBy("player_id").collect()] == ["p1", "p2"]


def test_the_sketch_of_few_periods_is_small(spark):
    """A sketch of 2^14 registers per entity made the aggregate of many entities spill; counts stay those of the exact way."""
    rows = [(e, 2000 + p if p < 9 else None) for e in range(300) for p in range(10) if p <= e % 11]
    df = spark.createDataFrame([*rows, *rows, (None, 2001), (None, 2002)], "entity long, period int")
    few = eligible_entities(df, "entity", "period", 2, approximate=True)
    assert sorted(map(str, few.collect())) == sorted(map(str, eligible_entities(df, "entity", "period", 2).collect()))
    size = F.length(F.hll_sketch_agg(F.xxhash64("period"), F.lit(SKETCH_LG)))
    assert df.groupBy("entity").agg(size.alias("n")).agg(F.max("n")).first()[0] < 1_000
    assert "approx_count_distinct" not in few._jdf.queryExecution().toString()


def test_profiles_skip_missing_and_default_the_flag(spark, seasons):
    dim = spark.createDataFrame([("p1", 80.0, True), ("p9", 70.0, True)], "player_id string, ht double, hof boolean")
    out = attach_dimension(build_profiles(seasons, CFG, ["x", "y"], 5), dim, "player_id", ["ht"], "hof")
    got = {r.player_id: r for r in out.collect()}
    assert set(got) == {"p1", "p2"} and got["p1"].x == 2.0 and got["p1"].y == 1.0
    assert got["p1"].hof is True and got["p2"].hof is False and got["p2"].ht is None


def small_profile(spark):
    data = pd.DataFrame({
        "id": range(8), "cohort": ["a"] + ["b"] * 2 + ["c"] * 5,
        "x": [1.0, 2, 4, None, 8, 16, 32, 64], "same": [3.0] * 8, "flat": [1.0, 5, 5, 1, 2, 3, 4, None],
    })
    return spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "id int, cohort string, x double, same double, flat double").withColumn("none", F.lit(None).cast("double"))


def test_constant_and_empty_columns_are_left_out(spark):
    assert varying_columns(small_profile(spark), ["x", "same", "flat", "none"]) == ["x", "flat"]


def test_cohort_zscore_edge_cases(spark):
    got = {r.id: r for r in cohort_zscore(small_profile(spark), ["x", "flat"], "cohort").collect()}
    assert got[0].x_era_adj is None  # a cohort of one has no sample deviation
    assert got[1].flat_era_adj == 0.0 and got[2].flat_era_adj == 0.0  # zero deviation counts as one
    c = np.array([8.0, 16, 32, 64])
    assert got[7].x_era_adj == pytest.approx((64 - c.mean()) / c.std(ddof=1))


def test_imputation_and_scaling_match_numpy(spark):
    df = small_profile(spark)
    x = np.array([1.0, 2, 4, 8, 16, 32, 64])
    filled = {r.id: r.x for r in median_fill(df, ["x"]).collect()}
    assert filled[3] == np.median(x)
    by_cohort = {r.id: r.x for r in cohort_median_fill(df, ["x"], "cohort").collect()}
    assert by_cohort[3] == 24.0
    low, mid, high = np.percentile(x, [5, 50, 95])
    scaled = {r.id: r.x for r in robust_scale(df, ["x"]).collect()}
    assert scaled[7] == pytest.approx((64 - mid) / (high - low)) and scaled[3] is None
    z = {r.id: r.x_z for r in standard_z(median_fill(df, ["x"]), ["x"]).collect()}
    full = np.append(x, np.median(x))
    assert z[0] == pytest.approx((1 - full.mean()) / full.std())
    assert robust_scale(df, ["same"]).first().same == 0.0


def test_composites_average_z_and_default_to_zero(spark):
    out = add_composites(small_profile(spark), {"both": ["x", "flat"], "nothing": []})
    r = out.filter("id = 0").first()
    x = np.array([1.0, 2, 4, 12, 8, 16, 32, 64])
    x[3] = np.median([1, 2, 4, 8, 16, 32, 64])
    f = np.array([1.0, 5, 5, 1, 2, 3, 4, 3])
    assert r.both == pytest.approx(((1 - x.mean()) / x.std() + (1 - f.mean()) / f.std()) / 2) and r.nothing == 0.0


@pytest.mark.parametrize("values", [
    list(range(1000)), [0.5] * 700 + list(range(300)), [math.sin(i) * 1e6 for i in range(997)], [1.0, 2.0],
])
def test_bracketed_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    probs = [0.05, 0.5, 0.95]
    found = exact_quantiles(df, ["v"], probs, small_rows=0, bracket_rows=50)[None]["v"]
    assert found == pytest.approx(list(np.percentile(values, [5, 50, 95])))
    assert exact_quantiles(df, ["v"], probs)[None]["v"] == pytest.approx(found)


def test_bracketed_quantiles_by_cohort(spark):
    df = small_profile(spark)
    assert exact_quantiles(df, ["x"], [0.5], by="cohort", small_rows=0, bracket_rows=1) == exact_quantiles(df, ["x"], [0.5], by="cohort")


def test_quantiles_of_many_cohorts_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    groups = np.concatenate([np.zeros(4000), rng.integers(1, 500, 8000)]).astype(int)
    values = pd.DataFrame({"g": [f"c{g}" if g != 7 else None for g in groups], "a": rng.normal(size=len(groups)).round(2), "b": rng.integers(0, 3, len(groups)).astype(float)})
    values.loc[rng.random(len(values)) < 0.1, "a"] = None
    df = spark.createDataFrame([(r.g, None if pd.isna(r.a) else r.a, None if r.g == "c9" else r.b) for r in values.itertuples()], "g string, a double, b double").repartition(6)
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    passes = []
    inner = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: passes.append(1) or inner(self))
    found = exact_quantiles(df, ["a", "b"], probs, by="g", small_rows=0, bracket_rows=200)
    assert len(passes) <= 7  # not one chain per cohort
    wanted = exact_quantiles(df, ["a", "b"], probs, by="g")
    assert found.keys() == wanted.keys() and len(found) > 400 and None in found
    for key, columns in wanted.items():
        for c, numbers in columns.items():
            assert found[key][c] == (pytest.approx(numbers) if None not in numbers else numbers), (key, c)


def test_quantiles_with_infinite_and_missing_numbers(spark):
    values = [math.nan] * 30 + [math.inf] * 5 + [-math.inf] * 5 + [float(i) for i in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    found = exact_quantiles(df, ["v"], [0.0, 0.5, 0.67, 1.0], small_rows=0, bracket_rows=3)[None]["v"]
    assert found[:2] == [-math.inf, pytest.approx(44.5)] and found[2] == math.inf and math.isnan(found[3])
    empty = df.filter("v < -1e300 and v > 0")
    assert exact_quantiles(empty, ["v"], [0.5], small_rows=-1)[None]["v"] == [None]


def test_quality_report_flags_missing_only(spark):
    df = spark.createDataFrame([(None, 0.0)] * 2 + [(1.0, 0.0)] * 3 + [(1.0, 0.0)] * 20 + [(1.0, 100.0)], "a double, b double")
    got = {r["column"]: r for r in quality_report(df, ["a", "b"], 0.05).collect()}
    assert got["a"].missing_count == 2 and got["a"].flagged and got["b"].outlier_count == 1 and not got["b"].flagged


def test_row_profile_orders_by_size(spark):
    df = assemble(spark.createDataFrame([(0.0, 5.0), (2.0, 5.5), (4.0, 9.0)], "a double, b double"), ["a", "b"], "v")
    top = row_profile(df, "v", ["a_era_adj", "b_era_adj"], 1).collect()[2]["top_features"][0]
    assert top.feature == "b" and top.direction == "high"
