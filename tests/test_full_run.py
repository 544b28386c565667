"""The player-season preset from CSV files to exported results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilekit.config import RunParams, TableSpec
from profilekit.operators.merge import require_valid_schemas, schema_report
from profilekit.plans.explore import compare_by_name, entity_profiles, similar_by_name
from profilekit.plans.full_run import run, save
from profilekit.presets.player_seasons import PLAYER_SEASONS as P
from profilekit.sources.tables import bad_row_counts, bad_rows, read_dimension, read_facts, read_table

PLAYERS, SEASONS = 60, 6


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("seasons")
    rng = np.random.default_rng(9)
    style = rng.normal(size=(PLAYERS, 40))
    style += 3 * rng.normal(size=(3, 40))[np.arange(PLAYERS) % 3]
    keys = pd.DataFrame([
        {"season": 1975 + (p % 5) * 9 + s, "player_id": f"p{p:03d}", "player": f"Player {p}", "lg": "L", "team": f"T{p % 4}",
         "pos": ["PG", "C", "SF"][p % 3], "age": 20 + s, "g": 70, "gs": 60, "mp": 2000 + p}
        for p in range(PLAYERS) for s in range(SEASONS)
    ])
    who = keys.player_id.str[1:].astype(int)
    for spec in P.fact_tables:
        df = keys.copy()
        extra = [c for c in spec.required if c not in keys.columns and c not in spec.rename]
        if spec.name == "per_game":
            df = df.rename(columns={"mp": "mp_per_game"})
            extra = ["pts_per_game", "ast_per_game", "trb_per_game", "x3p_per_game", "fga_per_game"]
        if spec.name == "play_by_play":
            extra = ["pg_percent", "c_percent"]
        if spec.name == "season_info":
            df = df.drop(columns=["g", "gs", "mp"])
        for i, c in enumerate(extra):
            column = (len(c) * 7 + i) % 40
            df[c] = style[who, column] + rng.normal(size=len(df)) * 0.2
        if spec.name == "shooting":
            df.loc[df.season < 1985, extra] = np.nan
        df.to_csv(root / spec.file, index=False)
    pd.DataFrame({"player_id": [f"p{p:03d}" for p in range(PLAYERS)], "ht_in_in": 70.0 + np.arange(PLAYERS) % 15, "wt": 200.0,
                  "hof": np.arange(PLAYERS) % 7 == 0}).to_csv(root / P.dimension.file, index=False)
    return str(root)


def test_rows_that_do_not_fit_are_kept_aside(spark, folder, tmp_path):
    spec = TableSpec("t", "t.csv", ("k",), types={"k": "string", "n": "int", "on": "boolean"})
    part = tmp_path / "t.csv"
    part.mkdir()
    (part / "1.csv").write_text("k,n,on,x\na,1,TRUE,0.5\nb,two,false,1\nc,NA,,\n")
    (part / "2.csv").write_text("k,n,on,x\nd,4,true,NaN\ne,5,true\nf,6,true,1,9\n")
    got = {r.k: tuple(r)[1:] for r in read_table(spark, str(tmp_path), spec).collect()}
    assert got == {"a": (1, True, 0.5), "c": (None, None, None), "d": (4, True, None)}
    assert sorted(r.k for r in read_table(spark, str(tmp_path), spec).select("k").collect()) == ["a", "c", "d"]
    bad = bad_rows(spark, str(tmp_path), [spec])
    assert bad.count() == 3
    assert sorted(r.record for r in bad.collect()) == ["b,two,false,1", "e,5,true", "f,6,true,1,9"]
    assert sorted((r.table_name, r.file[-5:], r.n_bad) for r in bad_row_counts(bad).collect()) == [("t", "1.csv", 1), ("t", "2.csv", 2)]
    (part / "3.csv").write_text("n,k,on,x\n4,d,true,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(tmp_path), spec, "k string, n int, on boolean, x double").collect()
    assert bad_rows(spark, folder, [*P.fact_tables, P.dimension]).count() == 0


@pytest.fixture(scope="module")
def result(spark, folder):
    facts = read_facts(spark, folder, P)
    specs = P.fact_tables
    report = schema_report({s.name: f for s, f in zip(specs, facts)}, [s for s in specs if s.name != "per_game"])
    assert report.filter("size(missing) > 0").count() == 0
    with pytest.raises(ValueError):
        require_valid_schemas(report)  # too few rows for the preset's minimum
    return run(facts, read_dimension(spark, folder, P), P, RunParams(n_clusters=3, min_cluster_size=8))


def test_features_follow_the_blocks(result):
    f = result.features
    assert f.vectors.count() == PLAYERS and len(f.names) == len(set(f.names))
    assert {"scoring_score_era_adj", "pts_per_game_era_adj", "ws_48_era_adj"} <= set(f.names)
    assert f.vectors.filter(F.exists("features", lambda x: x.isNull() | F.isnan(x))).count() == 0
    assert f.vectors.select(F.size("features")).distinct().collect()[0][0] == len(f.names)


def test_missing_shooting_is_reported_and_filled(result):
    report = {r["column"]: r for r in result.quality.collect()}
    assert report["avg_dist_fga"].missing_count > 0 and report["per"].missing_count == 0


def test_run_labels_every_entity(result):
    assert result.entities.filter("label is null").count() == 0
    ev = result.evaluation.first()
    assert ev.n_clusters_valid >= 2 and sum(ev.cluster_sizes.values()) + ev.n_noise == PLAYERS
    assert result.summary.count() == result.entities.select("label").distinct().count()
    assert result.consensus.first().n_clusters == ev.n_clusters_valid


def test_questions_to_the_run(result):
    similar = similar_by_name(result.entities, "player_id", "pca", "player 5", 4).collect()
    assert [r["rank"] for r in similar] == [1, 2, 3, 4] and all(r.item_id != "p005" for r in similar)
    assert compare_by_name(result.entities, "player_id", "pca", "Player 1", "Player 4").count() == 1
    with pytest.raises(ValueError):
        similar_by_name(result.entities, "player_id", "pca", "Nobody", 4)
    one = entity_profiles(result.entities, result.profiles, "features", result.features.names, P.labels).filter("name = 'Player 7'").first()
    assert len(one.top_features) == 5 and one.cluster_name


def test_exports_read_back(spark, result, tmp_path):
    save(result, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/entities")
    assert back.count() == PLAYERS and {"pca_1", "x", "y", "label"} <= set(back.columns)
    assert spark.read.json(f"{tmp_path}/cluster_profiles").count() == result.profiles.count()
    assert spark.read.parquet(f"{tmp_path}/similarity").count() == PLAYERS * min(RunParams().neighbours, PLAYERS - 1)
