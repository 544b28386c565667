"""The registered text queries and the pipeline, on the smallest shared tables."""

import os
import re

import oracle
import pytest

import corpus_pipeline
from profilekit.llm.queries import ORACLES, QUERIES, table

FOLDER = os.environ.get("PROFILEKIT_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_every_number_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), oracle.duck(FOLDER), ORACLES[name]) == ""


def test_stages(spark):
    docs = table(spark, FOLDER, "documents").cache()
    columns = docs.columns
    toxic = {r.doc_id for r in table(spark, FOLDER, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, FOLDER, "labels").where("toxic = 0").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, FOLDER).cache()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == columns and len(ids & clean) >= 0.98 * len(clean) and len(ids & toxic) < 0.7 * len(toxic)

    single = corpus_pipeline.drop_exact_copies(spark, kept, FOLDER).cache()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert single.columns == columns and single.count() == len(set(texts))

    far = corpus_pipeline.drop_near_copies(spark, single, FOLDER).cache()
    rows = [(r.doc_id, r.text) for r in single.collect()]
    from test_dedup import brute_components

    assert far.columns == columns
    assert {r.doc_id for r in far.collect()} == {root for _, root in brute_components(rows, 5, 80).values()}

    mixed = corpus_pipeline.mix_sources(spark, far, FOLDER).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in far.collect()}
    coded = corpus_pipeline.encode(spark, mixed, FOLDER)
    assert coded.count() == mixed.count() and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"]
