"""Queries against their SQL on the test tables.

A spread of queries runs by default; PROFILEKIT_ALL=1 runs every one.
"""

import os

import oracle
import pytest

from profilekit.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("PROFILEKIT_DATA", "/root/testdata/sf0.001")
SPREAD = [
    "merge_facts", "merge_facts_unique_keys", "schema_report", "quality_report", "entity_profiles", "cohort_zscore",
    "cohort_median_impute", "feature_vectors", "similar_customers", "knn_graph", "hybrid_search", "hybrid_search_filtered",
    "feature_attribution", "raw_vector_search", "resolve_names", "suggest_names", "coassociation", "consensus_filter",
    "adjusted_rand", "silhouette", "davies_bouldin", "temporal_stability", "chi_square", "cluster_profiles",
    "cluster_summary", "merged_graph", "capped_pairs", "row_numbers", "recall_mrr", "rank_correlation", "typed_csv_read",
    "normalise_names", "html_rows", "match_coverage", "answer_table",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("PROFILEKIT_ALL") else SPREAD)
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
