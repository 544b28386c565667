"""The search by boxes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilekit.operators import boxes, nearest as module
from profilekit.operators.nearest import nearest


def best(points, k):
    scores = np.round(points @ points.T, 9) + 0.0
    out = set()
    for i in np.flatnonzero(np.isfinite(points).all(axis=1)):
        order = [int(j) for j in np.lexsort((np.arange(len(points)), -scores[i])) if j != i and np.isfinite(scores[i, j])][:k]
        out |= {(int(i), j, r + 1) for r, j in enumerate(order)}
    return out


def frames(spark, points, name=int):
    kind = "long" if name is int else "string"
    items = spark.createDataFrame([(name(i), p.tolist()) for i, p in enumerate(points)], f"item_id {kind}, item_vec array<double>").repartition(5)
    return items.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"}), items


@pytest.mark.parametrize("spread, length, rows", [(0.02, 1.0, 64), (0.5, 1.0, 30), (0.5, 0.3, 64), (0.0, 1.0, 16)])
def test_boxes_find_the_best(spark, monkeypatch, spread, length, rows):
    """Tight, loose and equal groups, vectors of other lengths, a row of zeros and one that is not a number; never the sweep over all tiles."""
    def never(*_):
        raise AssertionError("all tiles were compared")

    monkeypatch.setattr(module, "_sweep", never)
    rng = np.random.default_rng(11)
    points = np.repeat(rng.normal(size=(30, 6)), 20, axis=0)
    points += spread * rng.normal(size=points.shape)
    points *= (length + (1 - length) * rng.random(size=(len(points), 1))) / np.linalg.norm(points, axis=1)[:, None]
    points[7], points[9, 2] = 0.0, np.nan
    queries, items = frames(spark, points)
    got = nearest(queries, items, 4, broadcast_queries=5, broadcast_items=5, tile_rows=rows)
    assert {(r.query_id, r.item_id, r["rank"]) for r in got.collect()} == best(points, 4)


def test_boxes_with_names_and_few_items(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(40, 3))
    points /= np.linalg.norm(points, axis=1)[:, None]
    queries, items = frames(spark, points, lambda i: f"n{i:02d}")
    found = boxes.search(queries, items.filter("item_id < 'n03'"), 5, 40, 3, 8)
    want = {(f"n{i:02d}", f"n{j:02d}") for i in range(40) for j in range(3)}
    assert {(r.query_id, r.item_id) for r in found.collect()} == want
    assert boxes.search(queries, items.limit(0), 5, 40, 0, 8).count() == 0


def test_blocks_hold_every_row_once_and_groups_need_few(spark):
    """Near copies that differ in their last digits: a group needs the blocks around it, not all of them."""
    rng = np.random.default_rng(6)
    points = np.repeat(rng.normal(size=(64, 8)), 32, axis=0)
    points /= np.linalg.norm(points, axis=1)[:, None]
    points *= 1 + 1e-15 * rng.integers(0, 9, size=(len(points), 1))
    _, items = frames(spark, points)
    tree = boxes.learn_tree(items, "item_id", "item_vec", len(points), 64)
    blocks = boxes.pack(boxes.in_cells(items, tree, "item_vec"), tree, "item_id", "item_vec", len(points), 64).cache()
    ids = [i for r in blocks.collect() for i in r.item_id]
    assert sorted(ids) == list(range(len(points))) and blocks.agg(F.max("n")).first()[0] <= 64
    seen, compared = [], []
    for r in blocks.collect():
        matrix = np.frombuffer(r.data).reshape(r.n, -1)
        assert np.array_equal(matrix, points[r.item_id]) and r.ends[-1] == r.n
        seen.append((np.array(r.item_id), matrix, np.array(r.ends)))
    own, want = seen[0], best(points, 3)
    group = boxes.Search(own[0], own[1], np.full(len(own[0]), -2.0), own[2], tree, 4)
    group.see(*own)
    group.settle()
    for other in seen[1:]:
        # Only blocks that hold copies of the group's rows add hits.
        before = group.held
        group.see(*other)
        compared.append(group.held > before)
    found = group.settle()
    got = {(int(own[0][q]), int(i)) for q, i in zip(found.query, found.item)}
    assert {(a, b) for a, b, _ in want if a in set(own[0].tolist())} <= got
    assert sum(compared) <= len(seen) / 4
