"""Names and parameters: no Spark needed."""

import pytest

from profilekit.config import RunParams, block_positions, check_manifest, config_hash, find_columns, resolve_blocks, resolve_composites, weight_block
from profilekit.presets.player_seasons import PLAYER_SEASONS as P

COLUMNS = [
    "pts_per_game", "pts_per_100_poss", "usg_percent", "ts_percent", "fg_percent", "e_fg_percent", "fg_percent_from_x3p_range",
    "orb_per_game", "orb_percent", "drb_percent", "trb_percent", "ast_per_game", "ast_per_36_min", "tov_percent",
    "stl_percent", "blk_percent", "dbpm", "dws", "x3p_percent", "x3p_ar", "ft_per_game", "avg_dist_fga", "pg_percent",
    "c_percent", "per", "bpm", "obpm", "ws", "ows", "ws_48",
]


@pytest.mark.parametrize("bad", [
    {"n_clusters": 1}, {"n_clusters": 51}, {"pca_variance": 0.5}, {"pca_variance": 0.995}, {"min_periods": 0},
    {"min_periods": 31}, {"min_cluster_size": 4}, {"seed": -1},
])
def test_parameters_are_checked_before_any_job(bad):
    with pytest.raises(ValueError):
        RunParams(**bad)


def test_config_hash_changes_with_parameters_only():
    assert config_hash(RunParams()) == config_hash(RunParams())
    assert config_hash(RunParams()) != config_hash(RunParams(n_clusters=8))
    assert len(config_hash(RunParams())) == 12


def test_find_columns_keeps_pattern_order_and_ignores_case():
    assert find_columns(["b_X", "a_x", "a_y"], ["Y", "x"]) == ["a_y", "b_X", "a_x"]


def test_blocks_overlap_and_drop_concept_variants():
    blocks = resolve_blocks(COLUMNS, P)
    # fg_percent as part of a name also finds the effective and the zone percentages
    assert {"fg_percent", "e_fg_percent", "fg_percent_from_x3p_range"} <= set(blocks["scoring"])
    assert "pts_per_100_poss" not in blocks["scoring"]
    assert blocks["rebounding"] == ["orb_percent", "drb_percent", "trb_percent"]
    assert blocks["advanced"] == ["per", "bpm", "obpm", "dbpm", "ws", "ows", "dws", "ws_48"]
    # c_percent is part of no other listed name; blocks share columns
    assert set(blocks["scoring"]) & set(blocks["shooting"])


def test_scoring_composite_takes_every_name_with_per():
    blocks = resolve_blocks(COLUMNS, P)
    scoring = resolve_composites(blocks, COLUMNS, P)["scoring_score"]
    assert "fg_percent" in scoring and "ft_per_game" in scoring and "per" in scoring
    assert "bpm" not in scoring
    assert resolve_composites(blocks, COLUMNS, P)["defense_score"].count("dbpm") == 1


@pytest.mark.parametrize("feature, block", [
    ("x3p_percent_era_adj", "advanced"), ("ft_per_game", "advanced"), ("e_fg_percent", "scoring"), ("tov_percent", "playmaking"),
    ("drb_percent", "rebounding"), ("dws", "defense"), ("avg_dist_fga", "shooting"), ("vorp", "advanced"), ("age", "default"),
])
def test_weight_block_first_rule_wins(feature, block):
    assert weight_block(feature, P) == block


def test_search_blocks_substring_and_exact():
    names = ["x3p_percent_era_adj", "per_era_adj", "dws_era_adj"]
    wide = block_positions(names, P.search_blocks)
    assert wide["advanced"] == [0, 1, 2] and wide["defense"] == [2]
    assert block_positions(names, P.search_blocks, match="exact")["advanced"] == [1]


def test_label_table():
    assert len(P.labels) == 114 and len(P.label_priority) == 47


def test_manifest_check_fails_loudly():
    good = {"version": "v", "feature_names": ["a"], "n_vectors": 1, "dimension": 1}
    check_manifest(good)
    for key in good:
        with pytest.raises(ValueError):
            check_manifest({k: v for k, v in good.items() if k != key})
    with pytest.raises(ValueError):
        check_manifest({**good, "dimension": 2})
