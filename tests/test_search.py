"""Nearest neighbours, hybrid search, attribution, lookup and index versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilekit.functions.vector import block_share, top_contributions, unit, well_formed
from profilekit.operators.cell_index import CellParams, build_cells, open_cells
from profilekit.operators.name_index import build_names, containing, open_names, suggest_stored, with_prefix
from profilekit.operators.nearest import assign_cells, cell_summary, nearest, sample_centres, search_cells
from profilekit.operators.search import Scoring, compare_two, edges_above, knn_graph, resolve, search, search_vectors, similar_to, similarity_edges, split_vectors, suggest
from profilekit.sources.index_store import answer_requests, build_index, current_commit, current_version, index_rows, promote, read_index, read_manifest, rebuild
from profilekit.sources.steps import file_names

N, D, K = 700, 8, 5


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, D))
    x[50:300] = x[7]  # a third of all rows are copies of one vector
    x[600] = 0
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


@pytest.fixture(scope="module")
def frame(spark, points):
    pdf = pd.DataFrame({"id": range(N), "vector": points.tolist(), "role": [f"r{i % 5}" for i in range(N)], "period": [2000 + i % 7 for i in range(N)]})
    return spark.createDataFrame(pdf, "id long, vector array<double>, role string, period int").repartition(6).cache()


def brute(points, k, allowed=lambda i, j: True):
    scores = np.round(points @ points.T, 9) + 0.0
    out = set()
    for i in range(len(points)):
        order = [int(j) for j in np.lexsort((np.arange(len(points)), -scores[i])) if j != i and allowed(i, j)][:k]
        out |= {(i, j, r + 1) for r, j in enumerate(order)}
    return out


WAYS = {
    "few_items": {}, "few_queries": {"broadcast_items": 5},
    "tiled": {"broadcast_items": 5, "broadcast_queries": 5, "tile_rows": 100},
}


@pytest.mark.parametrize("way", WAYS)
def test_every_way_is_exact(frame, points, way):
    q = frame.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vec"))
    i = frame.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    got = {(r.query_id, r.item_id, r["rank"]) for r in nearest(q, i, K, **WAYS[way]).collect()}
    assert got == brute(points, K)


@pytest.mark.parametrize("way", WAYS)
def test_limits_inside_the_search(frame, points, way):
    q = frame.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vec"), F.col("role").alias("want_role"), F.lit(2002).alias("min_period"))
    i = frame.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"), "role", "period")
    got = {(r.query_id, r.item_id, r["rank"]) for r in nearest(q, i, K, **WAYS[way]).collect()}
    assert got == brute(points, K, lambda a, b: a % 5 == b % 5 and 2000 + b % 7 >= 2002)


def test_cell_search_recall(frame, points):
    i = frame.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    q = i.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"})
    centres = sample_centres(i, 12, N)
    assigned = assign_cells(i, centres).cache()
    cells = cell_summary(assigned, centres)
    everything = {(r.query_id, r.item_id) for r in search_cells(q, assigned, cells, K + 1, nprobe=12).filter("query_id <> item_id").collect()}
    some = {(r.query_id, r.item_id) for r in search_cells(q, assigned, cells, K + 1, nprobe=5).filter("query_id <> item_id").collect()}
    want = {(a, b) for a, b, _ in brute(points, K)}
    distinct = {(a, b) for a, b in want if not (50 <= a < 300)}
    assert len(everything & distinct) / len(distinct) > 0.97
    assert len(some & distinct) / len(distinct) > 0.5


def test_vectors_are_packed_once_whatever_the_number_of_cells(spark):
    """Random directions: every query looks into every cell, and still no vector is repeated per cell."""
    from profilekit.operators.nearest import _floored, _joined_items, _packed, _placed

    n, rng = 600, np.random.default_rng(4)
    m = rng.normal(size=(n, 24))
    m /= np.linalg.norm(m, axis=1)[:, None]
    i = spark.createDataFrame([(f"x{j:03d}", v.tolist()) for j, v in enumerate(m)], "item_id string, item_vec array<double>")
    q = i.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"})
    centres = sample_centres(i, 20, n)
    assigned = assign_cells(i, centres).drop("angle")
    cells = cell_summary(assign_cells(i, centres), centres)
    placed = _placed(q, cells, None)
    shown = _packed(assigned, "item_id", "item_vec", n, 64).cache()
    asked = _floored(_packed(placed, "query_id", "query_vec", n, 64), shown, placed, 3, 64)
    for blocks, name in ((asked, "query"), (_joined_items(shown, assigned, 64), "item")):
        ids = [x for r in blocks.select(f"{name}_id").collect() for x in r[0]]
        assert sorted(ids) == sorted(set(ids)) and len(ids) == n
        largest, moved = blocks.agg(F.max(F.size(f"{name}_id")), F.sum(F.length(f"{name}_vec"))).first()
        assert 32 < largest <= 64 and moved == n * 24 * 8
    scores = np.sort(np.round(m @ m.T, 9), axis=1)[:, ::-1]
    for r in asked.select("query_id", "floor").collect():
        assert all(f <= scores[int(x[1:]), 2] + 1e-9 for x, f in zip(r.query_id, r.floor))
    got = {(r.query_id, r.item_id, r["rank"]) for r in nearest(q, i, 3, broadcast_queries=5, broadcast_items=5, tile_rows=64).collect()}
    np.fill_diagonal(both := np.round(m @ m.T, 9), -9)
    order = np.argsort(-both, axis=1, kind="stable")[:, :3]
    assert got == {(f"x{a:03d}", f"x{b:03d}", k + 1) for a in range(n) for k, b in enumerate(order[a])}


@pytest.mark.parametrize("spread, length, most", [(0.02, 1.0, None), (0.3, 1.0, None), (0.3, 0.8, None), (0.1, 1.0, 3)])
def test_pile_leaves_out_only_what_cannot_be_among_the_best(spread, length, most):
    """Tight and loose groups, shorter vectors, and queries that may look into three cells only."""
    from profilekit.operators.nearest import Cells, Pile, Side

    rng, k = np.random.default_rng(9), 4
    m = np.repeat(rng.normal(size=(12, 8)), 40, axis=0)
    m += spread * rng.normal(size=m.shape)
    m *= length / np.linalg.norm(m, axis=1)[:, None]
    centres = m[::40]
    cell = (m @ centres.T).argmax(axis=1)
    order = np.argsort(cell, kind="stable")
    m, cell, ids = m[order], cell[order], np.arange(len(m))
    angle = np.arccos(np.clip(m @ centres.T, -1, 1))
    sizes = np.bincount(cell, minlength=12)
    radius = np.array([angle[cell == c, c].max() if sizes[c] else 0.0 for c in range(12)])
    near = np.where(sizes > 0, m @ centres.T, -np.inf)
    reach = np.full(len(m), -2.0) if most is None else -np.sort(-near, axis=1)[:, most - 1]
    pile = Pile(Side(ids, m, {}), np.full(len(m), -2.0), reach, k)
    for start in range(0, len(m), 70):  # blocks that begin and end inside cells
        at = slice(start, start + 70)
        pile.see(Side(ids[at], m[at], {}), cell[at], Cells(centres, sizes, radius))
    best = pile.settle()
    scores = np.round(m @ m.T, 9)
    if most is not None:
        scores[near[:, cell] < reach[:, None] - 1e-12] = -9
    want = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    assert (best.item.reshape(-1, k) == want).all() and (best.query == np.repeat(ids, k)).all()


def test_string_ids_and_partition_independence(spark, frame):
    named = frame.select(F.format_string("p%04d", "id").alias("id"), "vector")
    a = {(r.src, r.dst, r.score) for r in knn_graph(named, "id", "vector", 3).collect()}
    b = {(r.src, r.dst, r.score) for r in knn_graph(named.repartition(2), "id", "vector", 3, broadcast_items=5).collect()}
    assert a == b and len(a) == 3 * N


def test_edges_do_not_depend_on_the_number_of_rows(frame):
    few = frame.filter("id < 20")
    assert similarity_edges(few, "id", "vector").count() == 20 * 19  # fewer than k others
    assert similarity_edges(few, "id", "vector", k=4).count() == 80
    assert similarity_edges(few, "id", "vector", min_score=0.99).filter("score < 0.99").count() == 0
    assert edges_above(similarity_edges(few, "id", "vector"), 0.99).filter("score < 0.99").count() == 0


def test_similar_to_excludes_own_group(frame):
    out = similar_to(frame, "id", "vector", 3, 10, different="role").join(frame, F.col("item_id") == F.col("id")).collect()
    assert len(out) == 10 and all(r.role != "r3" for r in out)


def vectors4(spark):
    v = [("a", [1.0, 0, 0, 0]), ("b", [0.6, 0.8, 0, 0]), ("c", [0.0, 1, 0, 0]), ("z", [0.0, 0, 0, 0]), ("n", [-0.8, 0, 0.6, 0]), ("d", [0.5, 0.5, 0.5, 0.5])]
    return spark.createDataFrame([(i, [float(e) for e in x], r) for (i, x), r in zip(v, ["G", "G", "F", "", "", "F"])], "id string, vector array<double>, role string")


def test_attribution_cases(spark):
    v = vectors4(spark)
    q = v.filter("id = 'a'").select(F.col("vector").alias("q"), F.lit(1).alias("k"))
    pairs = v.withColumn("k", F.lit(1)).join(q, "k")
    got = {r.id: r.t for r in pairs.select("id", top_contributions(F.col("q"), F.col("vector"), ["w", "x", "y", "z"], 2).alias("t")).collect()}
    assert got["c"] == [] and got["z"] == [] and got["n"] == []  # no positive cosine, nothing to explain
    assert got["b"][0].feature == "w" and got["b"][0].contribution == pytest.approx(1.0)
    share = {r.id: r.s for r in pairs.select("id", block_share(F.col("q"), F.col("vector"), [0, 1]).alias("s")).collect()}
    assert share["b"] == pytest.approx(1.0) and share["c"] is None


def test_hybrid_score_by_hand(spark):
    v = vectors4(spark)
    blocks = {"front": [0, 1], "back": [2, 3]}
    out = search(spark.createDataFrame([("a",)], "query_id string"), v, Scoring(blocks), 5, attributions=2)
    got = {r.item_id: r for r in out.collect()}
    assert "a" not in got and sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4, 5]
    assert got["b"].hybrid == pytest.approx(0.6 * 0.6 + 0.35 * (0.6 + 0.0) / 2 + 0.05, abs=1e-6)
    assert got["z"].hybrid == pytest.approx(0.0) and got["n"].role_bonus == 0.0
    weighted = search(spark.createDataFrame([("a",)], "query_id string"), v, Scoring(blocks, block_weights={"front": 0.0, "back": 0.0}), 5)
    assert weighted.filter("item_id = 'b'").first().block_sim == 0.0
    scores = [r.hybrid for r in sorted(got.values(), key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)


def test_post_filter_may_return_fewer_but_pre_filter_does_not(frame):
    asked = frame.filter("id < 3").select(F.col("id").alias("query_id"), F.lit("r4").alias("want_role"))
    scoring = Scoring({"b": [0, 1]})
    pre = search(asked, frame, scoring, 10, mode="pre", attributions=0)
    post = search(asked, frame, scoring, 10, attributions=0)
    assert pre.groupBy("query_id").count().filter("count = 10").count() == 3
    assert post.count() <= pre.count()
    assert post.join(frame.select(F.col("id").alias("item_id"), F.col("role").alias("own")), "item_id").filter("own <> 'r4'").count() == 0


def test_unknown_query_gives_no_rows(spark, frame):
    asked = spark.createDataFrame([(10 ** 9,)], "query_id long")
    assert search(asked, frame, Scoring({"b": [0]}), 5).count() == 0


def test_vector_checks_split_queries(spark):
    q = spark.createDataFrame([("ok", [1.0, 2.0]), ("short", [1.0]), ("nan", [1.0, float("nan")]), ("inf", [1.0, float("inf")]), ("null", None)], "query_id string, vector array<double>")
    good, bad = split_vectors(q, "vector", 2)
    assert [r.query_id for r in good.collect()] == ["ok"] and bad.count() == 4
    assert q.select(well_formed(F.col("vector"), 2).alias("w")).filter("w").count() == 1


def test_raw_vector_search_keeps_self_and_scale(frame):
    asked = frame.filter("id = 10").select(F.col("id").alias("query_id"), F.transform("vector", lambda x: x * 4).alias("vector"))
    top = search_vectors(asked, frame, D, 3, normalise=False).filter("rank = 1").first()
    assert top.item_id == 10 and top.score == pytest.approx(4.0) and top.attributions[0].contribution > 0
    assert search_vectors(asked, frame, D, 3).filter("rank = 1").first().score == pytest.approx(1.0)


def test_resolve_order(spark):
    known = spark.createDataFrame([("1", "Ann Lee"), ("2", "Anna Bell"), ("3", "ann lee"), ("bob", "Zed"), ("5", "Bob")], "id string, name string")
    asked = spark.createDataFrame([(" ann lee ",), ("anna",), ("bob",), ("zz",), ("",), ("AN",)], "query string")
    got = {r.query: (r.id, r.step) for r in resolve(asked, known).collect()}
    assert got[" ann lee "] == ("1", 2) and got["anna"] == ("2", 3) and got["bob"] == ("bob", 1)
    assert got["zz"] == (None, None) and got[""] == (None, None) and got["AN"] == ("1", 3)


def test_suggest_prefix_then_substring(spark):
    known = spark.createDataFrame([("1", "Ann"), ("2", "Joann"), ("3", "anna"), ("4", "Zed")], "id string, name string")
    assert [r.id for r in suggest(known, "AN").orderBy("rank").collect()] == ["1", "3"]
    assert [r.id for r in suggest(known, "oan").collect()] == ["2"]
    assert suggest(known, "qq").count() == 0 and suggest(known, "  ").count() == 0
    assert suggest(known, "an", 1).count() == 1


def test_compare_two(spark):
    v = vectors4(spark).withColumn("label", F.when(F.col("id") == "c", 2).otherwise(1))
    r = compare_two(v, "a", "b").first()
    assert r.cosine == pytest.approx(0.6) and r.same_cluster and not compare_two(v, "a", "c").first().same_cluster


def test_stored_names_answer_like_a_scan(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["ann", "anna", "Joanna", "bo", "Østen", "zed", "a", "an-na", "\U0001f600 anna"]
    listed = [(i, " ".join(rng.choice(words, rng.integers(1, 4)))) for i in range(400)] + [(400 + i, "Anna Bo") for i in range(200)] + [(900, None), (901, ""), (902, "  ")]
    known = spark.createDataFrame(listed, "id long, name string").repartition(5)
    folder = str(tmp_path)
    build_names(known, folder, buckets=5, rows_per_range=40)
    index = open_names(spark, folder, buckets=5)
    assert index.names.count() == len(listed) - 1 and len(index.names.inputFiles()) > 5
    keys = {i: n.strip().lower() for i, n in listed if n is not None}
    for text in ("an", "Anna b", "ø", "joanna z", "\U0001f600", "a", "nna", "na bo", "no such", "o", "%", "an_"):
        low = text.lower()
        assert sorted(r.id for r in with_prefix(index, text).collect()) == sorted(i for i, k in keys.items() if k.startswith(low)), text
        assert sorted(r.id for r in containing(index, text).collect()) == sorted(i for i, k in keys.items() if low in k), text
        got = [(r["rank"], r.id) for r in suggest_stored(index, text, 7).orderBy("rank").collect()]
        assert got == [(r["rank"], r.id) for r in suggest(known.filter("name is not null"), text, 7).orderBy("rank").collect()], text
    assert suggest_stored(index, "  ").count() == 0
    plan = containing(index, "joanna z")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:200]
    prefix = with_prefix(index, "zed")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,zed)" in prefix


def test_stored_names_of_small_and_empty_tables(spark, tmp_path):
    for at, names in enumerate([[], ["a", "bo"]]):
        folder = f"{tmp_path}/{at}"
        build_names(spark.createDataFrame(list(enumerate(names)), "id long, name string"), folder)
        index = open_names(spark, folder)
        assert containing(index, "bob").count() == 0 and with_prefix(index, "b").count() == len(names) // 2


def test_index_versions_and_gate(spark, frame, tmp_path):
    folder = str(tmp_path)
    rows = index_rows(frame, "id", "vector", [F.col("role")])
    names = [f"f{i}" for i in range(D)]

    def ask(index):
        i = index.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
        q = i.filter("item_id < 40").withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"})
        return nearest(q, i, 10)

    with pytest.raises(ValueError):
        read_index(spark, folder)
    first = rebuild(rows, folder, names, ask)
    assert first["promoted"] and current_version(spark, folder) == first["version"]
    assert read_manifest(spark, folder, first["version"])["n_vectors"] == N
    same = rebuild(rows.repartition(3), folder, names, ask)
    assert same["version"] == first["version"] and same["mean_jaccard"] == 1.0
    broken = rows.withColumn("vector", unit(F.transform("vector", lambda x, i: F.when(i < 2, x).otherwise(0.0))))
    rejected = rebuild(broken, folder, names, ask)
    assert not rejected["promoted"] and current_version(spark, folder) == first["version"]
    promote(spark, folder, build_index(broken, folder, names))
    assert current_version(spark, folder) == rejected["version"]


def test_rebuild_never_touches_what_is_live(spark, frame, tmp_path):
    folder, names = str(tmp_path), [f"f{i}" for i in range(D)]
    rows = index_rows(frame, "id", "vector", [F.col("role")])

    def ask(index):
        return knn_graph(index.filter("id < 60"), "id", "vector", 3).select(F.col("src").alias("query_id"), F.col("dst").alias("item_id"), "rank")

    first = rebuild(rows, folder, names, ask)
    before = sorted((r.id, r.role) for r in read_index(spark, folder, first["version"]).collect())
    second = rebuild(rows.withColumn("role", F.lit("other")), folder, names, ask)
    assert second["version"] != first["version"] and second["promoted"]
    assert sorted((r.id, r.role) for r in read_index(spark, folder, first["version"]).collect()) == before
    third = rebuild(read_index(spark, folder).withColumn("more", F.lit(1)), folder, names, ask)
    assert third["promoted"] and read_index(spark, folder).count() == N == read_index(spark, folder, second["version"]).count()


def test_publications_that_meet_are_gated_against_each_other(spark, frame, tmp_path):
    folder, names = str(tmp_path), [f"f{i}" for i in range(D)]
    rows = index_rows(frame, "id", "vector", [F.col("role")])
    broken = rows.withColumn("vector", unit(F.transform("vector", lambda x, i: F.when(i < 2, x).otherwise(0.0))))
    seen, other = [], []

    def ask(index):
        # a reader at any moment finds a version
        seen.append(current_version(spark, folder))
        return knn_graph(index.filter("id < 60"), "id", "vector", 3).select(F.col("src").alias("query_id"), F.col("dst").alias("item_id"), "rank")

    def ask_late(index):
        if not other:  # someone publishes between this build's first look and its commit
            other.append(build_index(broken, folder, names))
            assert promote(spark, folder, other[0])
        return ask(index)

    first = rebuild(rows, folder, names, ask)
    assert current_commit(spark, folder) == (1, first["version"])
    late = rebuild(rows.withColumn("role", F.lit("other")), folder, names, ask_late)
    # close to the first version, not to the one that came between
    assert not late["promoted"] and current_commit(spark, folder) == (2, other[0])
    assert seen and set(seen) <= {first["version"], other[0]}
    assert not promote(spark, folder, late["version"], after=1) and current_version(spark, folder) == other[0]
    assert promote(spark, folder, late["version"], after=2) and current_commit(spark, folder) == (3, late["version"])
    assert [n[-6:] for n in file_names(spark, f"{folder}/commits")] == ["1.json", "2.json", "3.json"]


def test_first_publications_that_meet(spark, frame, tmp_path):
    folder, names = str(tmp_path), [f"f{i}" for i in range(D)]
    rows = index_rows(frame.filter("id < 60"), "id", "vector", [F.col("role")])
    version = build_index(rows, folder, names)
    assert [promote(spark, folder, v, after=0) for v in (version, "late")] == [True, False]
    assert current_commit(spark, folder) == (1, version)


def test_requests_without_answers_are_answered_once(spark, tmp_path):
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "request_key string, n long")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.filter("n = 2").select("request_key", (F.col("n") * 10).alias("answer"))

    path = f"{tmp_path}/answers"
    for _ in range(2):
        assert [tuple(r) for r in answer_requests(asked, path, compute).collect()] == [("b", 20)]
    assert calls == [2, 0]


def test_approximate_search_reaches_its_recall(spark, tmp_path):
    from profilekit.catalog import search_queries

    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=64)], 0) for k in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    i = search_queries.vectors(spark, str(tmp_path))
    q, items = search_queries._sides(i)
    want = {(x.query_id, x.item_id) for x in nearest(q.filter("query_id % 50 = 0"), items, 10).collect()}
    got = {(x.query_id, x.item_id) for x in search_queries._ann(spark, str(tmp_path)).filter("query_id % 50 = 0").collect()}
    assert len(want) == 120 and len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("copies", [0, 400])
def test_stored_cells(spark, tmp_path, copies):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(900, 8))
    if copies:
        rows[:copies] = rows[0]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, r.tolist(), f"r{i % 3}") for i, r in enumerate(rows)], "item_id long, item_vec array<double>, role string")
    asked = items.selectExpr("item_id AS query_id", "item_vec AS query_vec")
    built = build_cells(items, str(tmp_path / "index"), CellParams(max_cells=50, sample_rows=300, recall=0.9))
    index = open_cells(spark, str(tmp_path / "index"))
    assert index.most == built.most and len(index.cells.centres) == 50 and index.cells.sizes.sum() == 900
    want = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in nearest(asked, items, 5).collect()}
    exact = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in nearest(asked, items, 5, cells=index.exact(), tile_rows=64).collect()}
    assert exact == want
    near = {(r.query_id, r.item_id) for r in nearest(asked, items, 5, cells=index).collect()}
    assert sum((q, i) in near for (q, _), (i, _) in want.items()) >= 0.85 * len(want)
    limited = asked.withColumn("want_role", F.lit("r1"))
    pairs = nearest(limited, items, 5, cells=index.exact()).join(items.select("item_id", "role"), "item_id")
    assert pairs.filter("role <> 'r1'").count() == 0


def test_stored_cells_read_only_what_is_visited(spark, tmp_path):
    items = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(200)], "item_id long, item_vec array<double>")
    index = build_cells(items, str(tmp_path / "index"))
    few = index.rows(spark).where(F.col("cell").isin([0, 1]))
    assert "PartitionFilters: [cell" in few._jdf.queryExecution().toString().replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")
    none = build_cells(items.limit(0), str(tmp_path / "none"))
    assert search_vectors(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), items.toDF("id", "vector"), 2, 3, cells=index).count() == 3
    assert nearest(items.toDF("query_id", "query_vec"), items.limit(0), 3, cells=none).count() == 0


def test_copies_are_found_by_hash_and_vectors_are_not_grouped(spark, monkeypatch):
    """Without copies nothing is grouped by vector; one copy, or a zero of another sign, brings the grouping back."""
    from profilekit.operators import nearest as module

    grouped, first_copies = [], module._first_copies
    monkeypatch.setattr(module, "_first_copies", lambda items, k: grouped.append(1) or first_copies(items, k))
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 6))
    m[:, 0] = 0.0
    m /= np.linalg.norm(m, axis=1)[:, None]
    for twice in (False, True):
        if twice:
            m[40] = m[3]
            m[40, 0] = -0.0
        i = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(m)], "item_id long, item_vec array<double>")
        q = i.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"})
        got = {(r.query_id, r.item_id, r["rank"]) for r in nearest(q, i, 4, broadcast_queries=5, broadcast_items=5, tile_rows=16).collect()}
        assert got == brute(m, 4) and len(grouped) == int(twice)
