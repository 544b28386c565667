"""Clusterings, consensus, metrics, labels, graphs, names."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilekit.operators.cluster import kmeans, passes_gate, ward, ward_merges
from profilekit.operators import consensus, features_tree
from profilekit.operators.consensus import adjusted_rand, average_linkage, consensus_labels, drop_low_consensus, label_profiles, own_agreement, profile_linkage
from profilekit.session import materialise
from profilekit.operators.density import bridges, components, density_clusters, euclidean_neighbours, merge_tree, minimum_spanning_forest, reachability_edges
from profilekit.operators.graph import ego_edges, ego_nodes, merge_graphs
from profilekit.operators.labels import cluster_zscores, compare_clusters, name_clusters
from profilekit.operators.names import accepted_links, linked_rows, match_coverage, name_links, unmatched_names, word_pairs
from profilekit.operators.quality import davies_bouldin, evaluate, resampling_stability, silhouette, temporal_stability
from profilekit.operators.stability import ResamplingParams, first_centres, recluster_samples, stability_summary, with_samples
from profilekit.operators.reduce import fit_components, map_points, project
from profilekit.operators.relational import capped_pairs, number_rows
from profilekit.operators.retrieval import compare_baseline, gate, labelled_pairs, recall_and_mrr
from profilekit.functions.text import _plain_or_decomposed, normalise_name


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6)) * 8
    x = np.concatenate([c + rng.normal(size=(60, 6)) * 0.7 for c in centres] + [rng.uniform(-15, 15, size=(12, 6))])
    return x, [i // 60 for i in range(240)] + [-1] * 12


@pytest.fixture(scope="module")
def frame(spark, blobs):
    x, truth = blobs
    pdf = pd.DataFrame({"id": range(len(x)), "v": x.tolist(), "truth": truth})
    return spark.createDataFrame(pdf, "id long, v array<double>, truth int").repartition(3).cache()


def same_partition(df, a, b):
    return adjusted_rand(df, a, b).first().ari


def test_components_match_numpy(frame, blobs):
    x, _ = blobs
    found = fit_components(frame, "v", 0.9)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    share = values[::-1] / values.sum()
    assert found.kept == int((np.cumsum(share) <= 0.9).sum()) + 1
    got = np.array([r.pca for r in project(frame, "v", found).orderBy("id").collect()])
    assert np.abs(np.abs(got) - np.abs(centred @ vectors[:, ::-1][:, :found.kept])).max() < 1e-9
    assert (found.loadings[np.abs(found.loadings).argmax(axis=0), range(found.kept)] > 0).all()
    assert map_points(project(frame, "v", found)).filter("x is null or y is null").count() == 0


def test_clusterings_find_the_blobs(frame):
    assert same_partition(ward(frame, "v", 4, micro=40), "truth", "label") == pytest.approx(1.0)
    dense = density_clusters(frame, "id", "v", min_cluster_size=20)
    assert same_partition(dense, "truth", "label") == pytest.approx(1.0)
    assert dense.filter("truth = -1 and label = -1").count() >= 9 and passes_gate(dense, "label")
    labels, inertia = kmeans(frame, "v", 4)
    assert inertia > 0 and labels.count() == frame.count()


def test_ward_on_points_matches_brute_force():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    groups = [[i] for i in range(40)]
    while len(groups) > 5:
        cost = {}
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                ga, gb = x[groups[a]], x[groups[b]]
                cost[(a, b)] = len(ga) * len(gb) / (len(ga) + len(gb)) * ((ga.mean(0) - gb.mean(0)) ** 2).sum()
        a, b = min(cost, key=cost.get)
        groups[a] += groups.pop(b)
    got = ward_merges(np.ones(40), x, 5)
    assert {frozenset(np.nonzero(got == k)[0].tolist()) for k in range(5)} == {frozenset(g) for g in groups}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(260, 2))] + [(i, i + 1) for i in range(500, 560)]
    e = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.range(600).withColumnRenamed("id", "node")
    up = list(range(600))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    found = {r.node: r.root for r in components(nodes, e).collect()}
    assert found == {x: top(x) for x in range(600)} and found[559] == 500 and found[599] == 599


def test_average_linkage_equals_the_plain_way():
    def plain(agreement, counts, k):
        n, weight, gap = len(counts), counts.astype(float).copy(), np.round(1.0 - agreement, 12)
        np.fill_diagonal(gap, np.inf)
        owner = np.arange(n)
        for _ in range(max(n - k, 0)):
            a, b = sorted(divmod(int(np.round(gap, 9).argmin()), n))
            merged = (weight[a] * gap[a] + weight[b] * gap[b]) / (weight[a] + weight[b])
            merged[[a, b]] = np.inf
            gap[a, :] = gap[:, a] = merged
            gap[b, :] = gap[:, b] = np.inf
            weight[a] += weight[b]
            owner[owner == b] = a
        return np.unique(owner, return_inverse=True)[1]

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 30, 80):
        tuples = rng.integers(-1, 4, size=(n, 3))
        agreement = sum((c[:, None] == c[None, :]) & (c[:, None] != -1) for c in tuples.T) / 3
        counts = rng.integers(1, 9, n)
        for k in (1, 3):
            assert average_linkage(agreement.copy(), counts, k).tolist() == plain(agreement.copy(), counts, k).tolist()


LABELS = [(0, 0, 0), (0, 0, 0), (0, 0, -1), (0, 1, 0), (1, 1, 1), (1, 1, 1), (1, 1, -1), (1, 0, 1), (2, 2, 2), (2, 2, -1), (-1, -1, -1), (0, 2, 1)]


def rowwise_agreement(rows):
    x = np.array(rows)
    c = np.zeros((len(x), len(x)))
    for col in x.T:
        c += (col[:, None] == col[None, :]) & (col[:, None] != -1)
    np.fill_diagonal(c, 0)
    return c / x.shape[1]


def test_consensus_on_tuples_equals_rows_sorted_by_tuple(spark):
    rng = np.random.default_rng(4)
    rows = sorted(tuple(int(v) for v in r) for r in rng.integers(-1, 3, size=(60, 3)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a int, b int, c int")
    got = [r.consensus for r in consensus_labels(df, ["a", "b", "c"], 4).orderBy("id").collect()]
    tuples = sorted(set(rows))
    x = np.array(tuples)
    c = np.zeros((len(x), len(x)))
    for col in x.T:
        c += (col[:, None] == col[None, :]) & (col[:, None] != -1)
    by_tuple = average_linkage(c / 3, np.array([rows.count(t) for t in tuples]), 4)
    assert got == [int(by_tuple[tuples.index(r)]) for r in rows]


def test_own_agreement_by_hand(spark):
    rows = LABELS
    cluster = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 0]
    df = spark.createDataFrame([(i, *r, k) for i, (r, k) in enumerate(zip(rows, cluster))], "id int, a int, b int, c int, k int")
    agreement = rowwise_agreement(rows)
    got = {r.id: r.agreement for r in own_agreement(df, ["a", "b", "c"], "k").collect()}
    for i, k in enumerate(cluster):
        others = [j for j, kk in enumerate(cluster) if kk == k and j != i]
        assert got[i] == (pytest.approx(agreement[i, others].mean()) if others else None)
    final = {r.id: r.label for r in drop_low_consensus(df, ["a", "b", "c"], "k").collect()}
    assert final[10] == 3 and final[11] == -1  # a cluster of one keeps its label, weak agreement does not


def test_adjusted_rand_needs_more_than_ten_rows(spark):
    df = spark.createDataFrame([(i % 2, i % 2) for i in range(10)], "a int, b int")
    assert adjusted_rand(df, "a", "b").first().ari is None
    bigger = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    assert adjusted_rand(bigger, "a", "b").first().ari == pytest.approx(1.0)


def test_silhouette_and_davies_bouldin_match_definitions(frame, blobs):
    x, truth = blobs
    keep = np.array(truth) != -1
    x, t = x[keep], np.array(truth)[keep]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = 1 - u @ u.T
    values = []
    for i in range(len(x)):
        own = [dist[i, j] for j in range(len(x)) if t[j] == t[i] and j != i]
        far = min(dist[i, t == k].mean() for k in set(t) if k != t[i])
        values.append((far - np.mean(own)) / max(far, np.mean(own)))
    assert silhouette(frame, "v", "truth") == pytest.approx(np.mean(values))
    c = np.array([x[t == k].mean(0) for k in range(4)])
    s = np.array([np.linalg.norm(x[t == k] - c[k], axis=1).mean() for k in range(4)])
    worst = [max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(4) if j != i) for i in range(4)]
    assert davies_bouldin(frame, "v", "truth").first()[0] == pytest.approx(np.mean(worst))
    one = frame.withColumn("one", F.lit(0))
    assert silhouette(one, "v", "one") is None and "warning" in evaluate(one, "v", "one").columns


def test_temporal_stability_skips_gaps_and_noise(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 5, 1), ("b", 1, -1), ("b", 2, 0), ("b", 3, 0), ("c", 9, 1)]
    r = temporal_stability(spark.createDataFrame(rows, "e string, p int, l int"), "e", "p", "l").first()
    assert (r.consecutive_pairs, r.stable_transitions) == (3, 2) and r.share_stable == pytest.approx(2 / 3)


def test_resampling_is_repeatable(frame):
    once = [resampling_stability(frame, "id", lambda d: kmeans(d, "v", 4, max_iter=20)[0], n_iterations=2)["mean_ari"] for _ in range(2)]
    assert once[0] == once[1] > 0.5


def test_names_and_comparison(spark):
    df = spark.createDataFrame([(0, [5.0, 1.0, 0.0]), (0, [6.0, 1.0, 0.1]), (1, [-5.0, -1.0, 0.0]), (1, [-6.0, -1.0, 0.1]), (-1, [0.0, 0.0, 3.0])], "label int, v array<double>")
    z = cluster_zscores(df, "v", "label", ["a_era_adj", "b_era_adj", "c_era_adj"])
    named = {r.label: r.name for r in name_clusters(z, "label", {("a", "high"): "Tall", ("b", "high"): "Tall", ("a", "low"): "Short"}, ("b", "a"), 2).collect()}
    assert named[0] == "Tall" and set(named[1].split(" • ")) == {"Short", "b-low"} and -1 not in named
    assert compare_clusters(z, "label", 0, 1, 1).first().feature in ("a", "b")


def test_graph_merge_keeps_one_undirected_edge(spark):
    results = spark.createDataFrame([("a", "b", 0.95, 1), ("a", "c", 0.85, 2), ("b", "a", 0.95, 1), ("b", "d", 0.1, 2)], "query_id string, item_id string, hybrid double, rank int")
    edges = ego_edges(results)
    points = spark.createDataFrame([("a", 3, "G"), ("b", 1, "F")], "id string, label int, role string")
    nodes = ego_nodes(edges, points)
    assert nodes.filter("center = 'a' and is_center").first().id == "a" and nodes.filter("id = 'c'").first().label == -1
    merged, kept = merge_graphs(nodes, edges, "a")
    assert {(r.source, r.target, r.strength) for r in kept.collect()} == {("a", "b", "strong"), ("a", "c", "medium"), ("b", "d", "weak")}
    assert {(r.id, r.is_center, r.expanded) for r in merged.collect()} == {("a", True, True), ("b", False, True), ("c", False, False), ("d", False, False)}


def test_retrieval_metrics_by_hand(spark):
    results = spark.createDataFrame([("q1", f"x{i}", i) for i in range(1, 8)] + [("q2", "y", 1), ("q3", "z", 1)], "query_id string, item_id string, rank int")
    pairs = spark.createDataFrame([("q1", "x4"), ("q1", "x6"), ("q2", "nope"), ("q9", "y")], "query_id string, expected_id string")
    r = recall_and_mrr(results, pairs).first()
    assert r.n_queries == 2 and r.recall_at_1 == 0.0 and r.recall_at_5 == 0.5 and r.mrr == pytest.approx(0.125)
    old = spark.createDataFrame([("q1", ["a", "b", "c"]), ("q2", ["a"]), ("gone", ["a"])], "query_id string, ids array<string>")
    new = spark.createDataFrame([("q1", ["a", "b", "d"]), ("q2", ["a"])], "query_id string, ids array<string>")
    verdict = gate(compare_baseline(old, new)).first()
    assert verdict.n_tested == 2 and verdict.mean_jaccard == pytest.approx(0.75) and verdict.n_alerts == 1 and not verdict.passed


def test_capped_pairs_are_the_first_pairs_in_order(spark):
    df = spark.createDataFrame([(g, m) for g, n in (("a", 30), ("b", 3), ("c", 1)) for m in range(n)], "g string, m int")
    got = sorted((r.g, r.a, r.b) for r in capped_pairs(df, "g", "m", F.lit(65)).collect())
    every = [("a", i, j) for i in range(30) for j in range(i + 1, 30)][:65] + [("b", i, j) for i in range(3) for j in range(i + 1, 3)]
    assert got == every
    assert labelled_pairs(df.withColumn("l", F.ascii("g")), "m", "l", 20).count() == 10


def test_row_numbers_are_consecutive(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r.number for r in number_rows(df, [F.col("k")]).orderBy("k").collect()]
    assert got == list(range(1000))


def test_names_normalise(spark):
    names = ["Dončić", "O'Neal Jr.", "J.R. Smith", "  Two   Spaces ", "Gary Payton II", "Şengün III"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(normalise_name(F.col("name"))).collect()] == ["doncic", "oneal", "jr smith", "two spaces", "gary payton", "sengun"]


def test_word_pairs_of_slices_add_up(spark, monkeypatch):
    from collections import Counter

    texts = ["a b  a\tb\n", "", " ", "one", None, "a b", "É\x0bx y\u00a0z", "b a b " * 3_000_000]
    want = Counter()
    for t in filter(None, texts):
        w = [x for x in t.translate(str.maketrans("\t\n\r\f", "    ")).split(" ") if x]
        want.update(f"{x} {y}" for x, y in zip(w, w[1:]))
    found = word_pairs(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text").collect()
    got = Counter()
    for r in found:
        got[r["name"]] += r["n"]
    assert got == want
    assert len(found) < len(texts) * 4  # counted inside tasks: pairs do not leave them one by one


def test_plain_names_take_the_short_way_to_the_same_key(spark):
    names = ["A  b", "x\x0by Jr.", " O'Neal\tIII ", "jr", "a jr.\n", "a.b' sr", "\x1ca", "é  b Iv.", "ΟΔΟΣ Jr", "", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[0] for r in df.select(normalise_name(F.col("name"))).collect()]
    assert got == ["a b", "x y", "oneal", "jr", "a", "ab", "\x1ca", "e b", "οδος", "", None]
    first = df.select(_plain_or_decomposed(".'")(F.col("name"))).collect()
    assert [r[0] for r in first[:7]] == got[:7]  # done beside the decomposition, no expression of Spark is left for them


def test_html_rows_allow_list_and_coverage(spark):
    img = r'<img alt="([^"]*)" src="([^"]*)"'
    html = [
        '<img alt="Luka Dončić Headshot" src="https://cdn.example.com/260x190/1.png"><img alt="" src="https://cdn.example.com/x.png">',
        '<img alt="Nikola Jokić headshot" src="http://cdn.example.com/2.png"><img alt="No Source" src="">',
        '<img alt="Bad" src="javascript:alert(1)"><img alt="Foreign" src="https://evil.org/a.png"><img alt="Luka Doncic" src="https://CDN.example.com/9.png"><img alt="Bare" src="https://cdn.example.com">',
    ]
    pages = spark.createDataFrame(list(enumerate(html)), "page int, html string")
    rows = linked_rows(pages, "html", img, 1, 2, ["page"])
    assert rows.count() == 6
    links = name_links(accepted_links(rows, ["cdn.example.com"]), ["page", "position"])
    assert [(r.key, r.url) for r in links.collect()] == [("luka doncic", "https://cdn.example.com/1040x760/1.png")]
    known = spark.createDataFrame([("Luka Dončić",), ("Nikola Jokić",), ("",)], "name string")
    r = match_coverage(known, links).first()
    assert (r.total, r.matched, r.coverage) == (2, 1, 50.0)
    assert [x.name for x in unmatched_names(known, links).collect()] == ["Nikola Jokić"]


def brute_forest(edges):
    """Kruskal by (w, a, b)."""
    top, out = {}, []

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            top[find(b)] = find(a)
            out.append((a, b, w))
    return out


def brute_leaves(ids, forest, least):
    """Leaf clusters of single linkage: every component as a set, merged edge by edge."""
    comp = {i: i for i in ids}
    members, split, leaf = {i: {i} for i in ids}, {i: False for i in ids}, {}
    for a, b, _ in sorted(forest, key=lambda e: (e[2], e[0], e[1])):
        x, y = comp[a], comp[b]
        if len(members[x]) < len(members[y]):
            x, y = y, x
        if len(members[y]) >= least:
            for z in (x, y):
                if not split[z]:
                    leaf.update({i: z for i in members[z]})
            split[x] = True
        members[x] |= members.pop(y)
        for i in members[x]:
            comp[i] = x
    for x, own in members.items():
        if len(own) >= least and not split[x]:
            leaf.update({i: x for i in own})
    groups = {}
    for i, x in leaf.items():
        groups.setdefault(x, set()).add(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("task_edges", [10**6, 90])
def test_density_equals_single_linkage_on_the_graph(spark, task_edges):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, s, size=(n, 3)) for c, s, n in (((0, 0, 0), 0.2, 60), ((2, 0, 0), 0.3, 50), ((2.5, 1.2, 0), 0.1, 25), ((9, 9, 9), 1.5, 40))])
    points = np.concatenate([points, np.repeat(points[:1], 30, axis=0), [[50.0, 50, 50]]])
    frame = spark.createDataFrame([(2**60 + 7 * i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").repartition(3)
    near = materialise(euclidean_neighbours(frame, "id", "v", 6))
    edges = [(r.a, r.b, r.w) for r in reachability_edges(near, 3).collect()]
    forest = minimum_spanning_forest(reachability_edges(near, 3), task_edges)
    want = brute_forest(edges)
    assert sorted((r.a, r.b, r.w) for r in forest.collect()) == sorted(want)
    if task_edges > 10**5:  # over several levels equal weights have another order among them
        found = {}
        for r in merge_tree(frame.selectExpr("id AS node"), forest, 8, task_edges).filter("cluster IS NOT NULL").collect():
            found.setdefault(r.cluster, set()).add(r.node)
        assert sorted(map(sorted, found.values())) == brute_leaves([2**60 + 7 * i for i in range(len(points))], want, 8)
    sizes = {r.label: r["count"] for r in density_clusters(frame, "id", "v", 8, 3, k=6, task_edges=task_edges).groupBy("label").count().collect()}
    assert all(n >= 8 for label, n in sizes.items() if label >= 0) and sum(sizes.values()) == len(points)
    assert [sizes[i] for i in range(max(sizes) + 1)] == sorted((n for label, n in sizes.items() if label >= 0), reverse=True)


def test_merge_tree_over_levels_with_distinct_weights(spark):
    rng = np.random.default_rng(3)
    weights = rng.permutation(399) / 399
    edges = [(i + 1, int(rng.integers(0, i + 1)), float(w)) for i, w in enumerate(weights)]
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    table = spark.createDataFrame(edges, "a long, b long, w double")
    nodes = spark.range(405).withColumnRenamed("id", "node")
    want = brute_leaves(range(405), edges, 5)
    for task_edges in (10**6, 150):
        found = {}
        for r in merge_tree(nodes, table, 5, task_edges).filter("cluster IS NOT NULL").collect():
            found.setdefault(r.cluster, set()).add(r.node)
        assert len(want) > 3 and sorted(map(sorted, found.values())) == want


@pytest.mark.parametrize("seed", range(40))
def test_profile_linkage_equals_the_matrix_version(seed):
    r = np.random.default_rng(seed)
    algorithms = int(r.integers(1, 4))
    tuples = np.unique(r.integers(-1, r.integers(1, 5), size=(int(r.integers(2, 60)), algorithms)), axis=0)
    counts = r.integers(1, 9, size=len(tuples))
    agreement = sum(((c[:, None] == c[None, :]) & (c[:, None] != -1)).astype(float) for c in tuples.T) / algorithms
    for k in (1, 2, 3, 6):
        want = average_linkage(agreement.copy(), counts, k)
        assert (profile_linkage(label_profiles(tuples, algorithms), counts, k) == want).all()


def test_first_partners_from_spark_give_the_same_consensus(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, *[int(x) for x in r.integers(-1, 6, size=3)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, x int, y int, z int")
    want = {c.id: c.consensus for c in consensus_labels(frame, ["x", "y", "z"], 5).collect()}
    monkeypatch.setattr(consensus, "FEW_TUPLES", 1)
    assert {c.id: c.consensus for c in consensus_labels(frame, ["x", "y", "z"], 5).collect()} == want


def test_samples_reclustered_together_equal_one_by_one(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 0.6, size=(70, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 2, 1))])
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").repartition(4)
    params = ResamplingParams(k=3, n_iterations=6, seed=9)
    got = {r["sample"]: r for r in recluster_samples(frame, "id", "v", params).collect()}
    member = {r.id: r.member for r in with_samples(frame, "id", "v", params).collect()}
    few = frame.orderBy(F.xxhash64(F.lit(9), F.col("id")), "id").select("id").collect()
    order, random, labels = [r.id for r in few], np.random.default_rng(9), {}
    for i in range(7):
        own = np.array([j for j in order if member[j][i]])
        centres = first_centres(points[own], 3, random)
        for _ in range(200):
            label = ((points[own][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([points[own][label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(3)])
        labels[i] = dict(zip(own.tolist(), label.tolist()))
    for i in range(1, 7):
        shared = sorted(labels[i])
        pairs = spark.createDataFrame([(labels[0][j], labels[i][j]) for j in shared], "a int, b int")
        assert len(shared) == 168 == got[i].n_rows and abs(adjusted_rand(pairs, "a", "b").first().ari - got[i].ari) < 1e-9
    total = stability_summary(recluster_samples(frame, "id", "v", params)).first()
    assert total.n_valid_iterations == 6 and abs(total.mean_ari - np.mean([r.ari for r in got.values()])) < 1e-12
    assert recluster_samples(frame.limit(0), "id", "v", params).count() == 0
    assert stability_summary(recluster_samples(frame.limit(4), "id", "v", params)).first().n_valid_iterations == 0


@pytest.mark.parametrize("most,task_rows", [(40, 10**6), (40, 37), (1000, 50)])
def test_features_keep_all_sums(spark, monkeypatch, most, task_rows):
    monkeypatch.setattr(features_tree, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 4)), np.repeat(rng.normal(size=(1, 4)), 150, axis=0)])
    frame = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>").repartition(5)
    found = features_tree.clustering_features(frame, "v", most).collect()
    assert len(found) <= most and sum(r.n for r in found) == 450
    assert np.allclose(sum(np.array(r.total) for r in found), points.sum(axis=0)) and np.isclose(sum(r.square for r in found), (points ** 2).sum())
    if most > 301:
        assert sorted(r.n for r in found) == [1.0] * 300 + [150.0]
    again = features_tree.clustering_features(frame.repartition(2), "v", most).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_ward_is_exact_with_a_feature_per_row(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 0.5, size=(25, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 0))])
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    labels = {r.id: r.label for r in ward(frame, "v", 5).collect()}
    want = ward_merges(np.ones(len(points)), points, 5)
    pairs = {(labels[i], int(w)) for i, w in enumerate(want)}
    assert len(pairs) == 5 == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert ward(frame.limit(0), "v", 2).count() == 0


def test_bridges_are_the_lightest_edges_between_clusters(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.4, size=(20, 2)) for c in ((0, 0), (6, 0), (6, 7), (30, 0))])
    core = np.sort(((points[:, None] - points[None]) ** 2).sum(axis=2) ** 0.5, axis=1)[:, 3]
    rows = [(i, p.tolist(), float(core[i]), i // 20) for i, p in enumerate(points)]
    found = bridges(spark.createDataFrame(rows, "node long, p array<double>, core double, cluster int"))
    gap = np.maximum(((points[:, None] - points[None]) ** 2).sum(axis=2) ** 0.5, np.maximum(core[:, None], core[None]))
    between = [(float(gap[20 * a:20 * a + 20, 20 * b:20 * b + 20].min()), a, b) for a in range(4) for b in range(a)]
    want = sum(w for _, _, w in brute_forest([(b, a, w) for w, a, b in between]))
    got = brute_forest([(r.a // 20, r.b // 20, r.w) for r in found.collect()])
    assert len(got) == 3 and sum(w for _, _, w in got) == pytest.approx(want)


@pytest.mark.parametrize("way", ["few", "boxes", "names"])
def test_bridges_take_every_row_into_account(spark, way):
    """Touching clusters whose lightest edges are those of single rows: more clusters and rows than any sample would hold."""
    rng = np.random.default_rng(12)
    n, per = 60, 15
    points = np.concatenate([rng.normal(c, 0.7, size=(per, 3)) for c in rng.uniform(0, 6, size=(n, 3))])
    points = np.concatenate([points, points[:per]])  # copies under another cluster
    label = np.arange(len(points)) // per
    core = np.round(0.2 * rng.random(len(points)), 1)  # many equal weights
    name = (lambda i: f"n{i:04d}") if way == "names" else int
    kind = "string" if way == "names" else "long"
    frame = spark.createDataFrame([(name(i), p.tolist(), float(core[i]), name(label[i])) for i, p in enumerate(points)], f"node {kind}, p array<double>, core double, cluster {kind}")
    found = bridges(frame.repartition(4)) if way == "few" else bridges(frame.repartition(4), few_rows=10, block_rows=64)
    gap = np.maximum(((points[:, None] - points[None]) ** 2).sum(axis=2) ** 0.5, np.maximum(core[:, None], core[None]))
    between = [(int(b), int(a), float(gap[per * a:per * a + per, per * b:per * b + per].min())) for a in range(n + 1) for b in range(a)]
    number = {name(i): int(label[i]) for i in range(len(points))}
    rows = found.collect()
    for r in rows:
        i, j = int(str(r.a).lstrip("n")), int(str(r.b).lstrip("n"))
        assert number[r.a] != number[r.b] and r.w == pytest.approx(gap[i, j], abs=1e-7)
    got = brute_forest([(min(number[r.a], number[r.b]), max(number[r.a], number[r.b]), r.w) for r in rows])
    assert len(got) == n and sum(w for _, _, w in got) == pytest.approx(sum(w for _, _, w in brute_forest(between)), abs=1e-6)
