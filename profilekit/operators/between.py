"""The lightest edge of every cluster to another one, over all pairs of rows, by boxes.

An edge weighs as much as the distance of its ends or the core of either, whichever is largest. Edges inside blocks and those of
one row per cluster give every cluster an edge that the lightest cannot outweigh. After that only rows whose core is no larger are looked
at, and only boxes that are no farther and do not hold rows of the same cluster alone.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from profilekit.functions.vector import to_matrix
from profilekit.operators.boxes import (
    AXES, BLOCK_ROWS, GROUP_ROWS, ROOM, STEP_SCORES, Tree, box_table, gap_squares, grouped, joined, leaf_boxes, list_of, matrix_of, met, pack, point_squares,
)
from profilekit.session import materialise

#: Rows of a block that are compared with each other, and clusters whose first rows all others are compared with.
NEAR_ROWS = 512
FEW_CLUSTERS = 512


def weights(p: np.ndarray, q: np.ndarray, core_p: np.ndarray, core_q: np.ndarray) -> np.ndarray:
    """Weights of edges, the same whichever end comes first."""
    return np.maximum(np.sqrt(np.square(p - q).sum(axis=1)), np.maximum(core_p, core_q))


def _lightest(cluster, w, a, b, other):
    """The first of each cluster in the order of (w, a, b)."""
    low, high = np.where(a <= b, a, b), np.where(a <= b, b, a)
    order = np.lexsort((high, low, w, cluster))
    first = order[np.r_[True, cluster[order][1:] != cluster[order][:-1]]] if len(order) else order
    return cluster[first], w[first], low[first], high[first], other[first]


def _crossing(cluster, node, p, core, with_cluster, with_node, with_p, with_core):
    """Each row's lightest edge to rows of other clusters, of each cluster the first."""
    gap = np.square(p).sum(axis=1)[:, None] + np.square(with_p).sum(axis=1)[None, :] - 2.0 * p @ with_p.T
    w = np.maximum(np.maximum(np.sqrt(np.maximum(gap, 0.0)), with_core[None, :]), core[:, None])
    w[cluster[:, None] == with_cluster[None, :]] = np.inf
    near = w.argmin(axis=1)
    rows = np.flatnonzero(np.isfinite(w[np.arange(len(near)), near]))
    near = near[rows]
    return _lightest(cluster[rows], weights(p[rows], with_p[near], core[rows], with_core[near]), node[rows], with_node[near], with_cluster[near])


class Meeting:
    """The lightest edges so far of the clusters of one group's rows."""

    def __init__(self, node, matrix, core, cluster, bar, ends, tree: Tree):
        self.node, self.matrix, self.core, self.tree = node, matrix, core, tree
        self.names, self.code = np.unique(cluster, return_inverse=True)
        self.bar = np.full(len(self.names), np.inf)
        np.minimum.at(self.bar, self.code, bar)
        self.best: dict[int, tuple] = {}
        turned, self.middle = tree.turned(matrix), matrix.mean(axis=0)
        centred = matrix - self.middle
        self.square = np.square(centred).sum(axis=1)
        # One more number, so that a product is a . b - b^2 / 2.
        self.short = np.c_[centred, np.full(len(centred), -0.5)].astype(np.float32)
        self.ahead = np.ascontiguousarray(turned[:, :AXES], dtype=np.float32)
        self.length = max(float(np.square(turned).sum(axis=1).max(initial=0.0)), float(self.square.max(initial=0.0)))
        self.starts, self.low, self.high = leaf_boxes(turned, ends)
        self.sizes = np.diff(np.r_[self.starts, len(matrix)])

    def see(self, node, matrix, core, cluster, ends) -> None:
        turned, centred = self.tree.turned(matrix), matrix - self.middle
        starts, low, high = leaf_boxes(turned, ends)
        square = np.square(centred).sum(axis=1)
        short = np.c_[centred, square].astype(np.float32)
        at = np.minimum(np.searchsorted(self.names, cluster), len(self.names) - 1)
        code = np.where(self.names[at] == cluster, at, -1)
        room = 4 * ROOM * (self.length + max(float(square.max()), float(np.square(turned).sum(axis=1).max())))
        limit = self.bar[self.code]
        far = np.maximum.reduceat(limit, self.starts)
        near = gap_squares(self.low, self.high, low.min(axis=0)[None], high.max(axis=0)[None])[:, 0] <= np.square(far) + room
        rows = np.flatnonzero(np.repeat(near, self.sizes))
        rows = rows[np.maximum(self.core[rows], core.min()) <= limit[rows]]
        below, above = low[:, :AXES].astype(np.float32), high[:, :AXES].astype(np.float32)
        rows = rows[point_squares(self.ahead[rows], below.min(axis=0), above.max(axis=0)) <= np.square(limit[rows]) + room]
        if len(rows) == 0:
            return
        gap = gap_squares(self.ahead[rows], self.ahead[rows], below, above).T
        for leaf, (start, stop) in enumerate(zip(starts, np.r_[starts[1:], len(matrix)])):
            limit = self.bar[self.code[rows]]
            found = (gap[leaf] <= np.square(limit) + room) & (self.core[rows] <= limit)
            if (code[start:stop] == code[start]).all() and code[start] >= 0:
                found &= self.code[rows] != code[start]
            found, step = rows[found], max(16, STEP_SCORES // int(stop - start))
            for some in (found[i:i + step] for i in range(0, len(found), step)):
                limit = self.bar[self.code[some]]
                bar = (self.square[some] - np.square(limit) - room) / 2
                qi, ii = np.nonzero(self.short[some] @ short[start:stop].T >= bar.astype(np.float32)[:, None])
                qi, ii = some[qi], start + ii
                kept = (self.code[qi] != code[ii]) & (core[ii] <= self.bar[self.code[qi]])
                self._take(qi[kept], ii[kept], node, matrix, core, cluster)

    def _take(self, qi, ii, node, matrix, core, cluster) -> None:
        for start in range(0, len(qi), 262_144):
            q, i = qi[start:start + 262_144], ii[start:start + 262_144]
            w = weights(self.matrix[q], matrix[i], self.core[q], core[i])
            kept = w <= self.bar[self.code[q]]
            q, i, w = q[kept], i[kept], w[kept]
            for c, *edge in zip(*(x.tolist() for x in _lightest(self.code[q], w, self.node[q], node[i], cluster[i]))):
                if tuple(edge) < self.best.get(c, (np.inf,)):
                    self.best[c], self.bar[c] = tuple(edge), min(self.bar[c], edge[0])

    def edges(self):
        codes = sorted(self.best)
        found = list(zip(*(self.best[c] for c in codes))) or [()] * 4
        return [self.names[codes].tolist() if codes else [], *map(list, found)]


def lightest_between(rows: DataFrame, tree: Tree, n_rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(cluster, w, a, b, other)``: of equal weights the smaller (a, b). ``rows``: ``node, p, core, cluster, cell``, of two clusters or more."""
    spark = rows.sparkSession
    node, name = rows.schema["node"].dataType, rows.schema["cluster"].dataType
    ddl = f"cluster {name.simpleString()}, w double, a {node.simpleString()}, b {node.simpleString()}, other {name.simpleString()}"
    types = [to_arrow_type(name), pa.float64(), to_arrow_type(node), to_arrow_type(node), to_arrow_type(name)]

    def given(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(found, types)], ["cluster", "w", "a", "b", "other"])

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("cluster").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("cluster", "e.*")

    shown = materialise(pack(rows.select("node", "p", "core", "cluster", "cell"), tree, "node", "p", n_rows, block_rows))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                all_rows = [list_of(batch, "cluster", row), list_of(batch, "node", row), matrix_of(batch, row), list_of(batch, "core", row)]
                for start in range(0, len(all_rows[0]), NEAR_ROWS):
                    part = [x[start:start + NEAR_ROWS] for x in all_rows]
                    yield given(x.tolist() for x in _crossing(*part, *part))

    # One row of each cluster meets those of a few: an edge for every cluster.
    ones = rows.groupBy("cluster").agg(F.min(F.struct("node", "p", "core")).alias("r")).select("cluster", "r.*")
    few = ones.orderBy(F.xxhash64("cluster"), "cluster").limit(FEW_CLUSTERS).toArrow()

    def columns(table) -> list[np.ndarray]:
        texts = lambda c: np.asarray(table.column(c).to_pylist(), dtype=str) if pa.types.is_string(table.column(c).type) or pa.types.is_large_string(table.column(c).type) else np.asarray(table.column(c))
        return [texts("cluster"), texts("node"), to_matrix(table.column("p")), np.asarray(table.column("core"))]

    some = spark.sparkContext.broadcast(columns(few))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                yield given(x.tolist() for x in _crossing(*columns(batch.slice(start, 4096)), *some.value))

    bars = materialise(least(shown.select("cluster", "node", "data", "n", "core").mapInArrow(inside, ddl).unionByName(ones.mapInArrow(first, ddl))))

    own = rows.join(bars.select("cluster", F.col("w").alias("bar")), "cluster").filter(F.col("core") <= F.col("bar"))
    own = own.select(F.col("node").alias("q_node"), "p", F.col("core").alias("q_core"), F.col("cluster").alias("q_cluster"), "bar", "cell")
    asked = materialise(pack(own, tree, "q_node", "p", n_rows, block_rows))
    groups, n_groups = grouped(asked, GROUP_ROWS)
    one = F.when(F.array_min("cluster") == F.array_max("cluster"), F.array_min("cluster"))
    boxes = box_table(shown.withColumns({"least": F.array_min("core"), "only": one}), "least", "only")
    shared = spark.sparkContext.broadcast((
        tree, boxes.column("block").to_numpy(), to_matrix(boxes.column("low")), to_matrix(boxes.column("high")), boxes.column("least").to_numpy(),
        np.asarray(boxes.column("only").to_pylist(), dtype=object)))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number, low, high, least_core, only = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                starts, below, above = leaf_boxes(tree.turned(matrix_of(batch, row)), list_of(batch, "ends", row))
                far = np.maximum.reduceat(list_of(batch, "bar", row), starts)[:, None]
                gap = np.sqrt(gap_squares(below, above, low, high))
                visit = (gap <= far * (1 + 1e-9) + 1e-12) & (least_core[None, :] <= far)
                mine = set(list_of(batch, "q_cluster", row).tolist())
                if len(mine) == 1:
                    visit &= (only != mine.pop())[None, :]
                near = np.where(visit, -gap, -np.inf).max(axis=0)
                hit = np.flatnonzero(near > -np.inf)
                group = np.full(len(hit), batch.column("group")[row].as_py(), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(number[hit]), pa.array(near[hit])], ["group", "block", "near"])

    placed = asked.select("block", "n", "ends", "data", "bar", "q_cluster").join(F.broadcast(groups), "block")
    needs = materialise(placed.mapInArrow(needed, "group int, block long, near double").groupBy("group", "block").agg(F.max("near").alias("near")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, group = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                ends, take = list_of(batch, "ends", row), lambda *names: [list_of(batch, n, row) for n in names]  # noqa: B023
                if batch.column("kind")[row].as_py() == 0:
                    ids, *rest = take("q_node", "q_core", "q_cluster", "bar")
                    waiting.append((ids, np.array(matrix_of(batch, row)), *rest, ends))
                    continue
                if group is None:
                    group, waiting = Meeting(*joined(waiting), shared.value[0]), None
                ids, core, cluster = take("node", "core", "cluster")
                group.see(ids, matrix_of(batch, row), core, cluster, ends)
        if group is not None:
            yield given(group.edges())

    found = met(asked, shown, groups, n_groups, needs, ("q_node", "q_core", "q_cluster", "bar"), ("node", "core", "cluster"), run, ddl)
    return materialise(least(found.unionByName(bars)))
