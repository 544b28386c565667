"""Rows in boxes: exact searches that leave out whole boxes of rows.

A tree of cuts, learned from a sample, deals rows to cells; inside a cell exact cuts make blocks and, within them, leaves of a few
rows. Cuts run along the main axes of the sample, and every leaf knows the box its rows lie in, so a search needs only the
leaves whose box is near enough. What is learned from the sample decides how rows are dealt, never what is found.

A search runs in groups of neighbouring blocks: each group gets the blocks of the other side that any of its rows can need, the
nearest first, one after the other, so a task holds its own rows and one block of the others, whatever the size of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.functions.vector import to_matrix
from profilekit.session import materialise

BLOCK_ROWS = 2048
LEAF_ROWS = 128
#: Cells of the tree and rows it is learned from.
MOST_CELLS = 4096
SAMPLE_ROWS = 65_536
#: Rows of a cell that a task cuts into blocks at once, and rows of one group.
HELD_ROWS = 32_768
GROUP_ROWS = 262_144
PART_ROWS = 131_072
#: Runs of neighbouring blocks in a group.
RUNS = 8
#: How often a block may be moved on average, if there are no more cores.
MOVES = 32
#: Hits that a group keeps, about.
GROUP_HITS = 4_194_304
#: What a bound may be short of by rounding, and numbers of one block of scores.
SLACK = 1e-8
#: Rounding of singles, as a share of squared lengths; main axes that rows are compared along before any product.
ROOM = 4e-6
AXES = 8
STEP_SCORES = 4_194_304


@dataclass
class Tree:
    """Main axes, and cuts of a complete binary tree: node n has the children 2n and 2n + 1, cells are the nodes of the last level."""

    axes: np.ndarray
    along: np.ndarray
    cuts: np.ndarray

    def turned(self, matrix: np.ndarray) -> np.ndarray:
        return matrix @ self.axes

    def cell(self, matrix: np.ndarray) -> np.ndarray:
        turned, node = self.turned(matrix), np.ones(len(matrix), dtype=np.int64)
        rows = np.arange(len(matrix))
        while len(node) and node[0] < len(self.cuts):
            node = 2 * node + (turned[rows, self.along[node]] > self.cuts[node])
        return (node - len(self.cuts)).astype(np.int32)


def learn_tree(rows: DataFrame, key: str, vec: str, n_rows: int, block_rows: int) -> Tree:
    """A tree with about ``block_rows`` rows a cell, from a repeatable sample."""
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(n_rows, 1))
    kept = rows.select(vec, F.xxhash64(key, vec).alias("_h")).filter(F.pmod("_h", F.lit(1_000_000_007)) <= int(share * 1_000_000_007))
    sample = to_matrix(kept.orderBy("_h").limit(SAMPLE_ROWS).select(vec).toArrow().column(vec))
    sample = sample[np.isfinite(sample).all(axis=1)]
    spread = sample.T @ sample
    axes = np.linalg.eigh(spread)[1][:, ::-1] if np.isfinite(spread).all() else np.eye(len(spread))
    levels = max(0, math.ceil(math.log2(max(1.0, min(MOST_CELLS, n_rows / block_rows, len(sample))))))
    along, cuts = np.zeros(2 ** levels, dtype=np.int64), np.zeros(2 ** levels)
    held = {1: sample @ axes}
    for node in range(1, 2 ** levels):
        part = held.pop(node)
        if len(part):
            along[node] = part.var(axis=0).argmax()
            cuts[node] = np.median(part[:, along[node]])
        right = part[:, along[node]] > cuts[node]
        held[2 * node], held[2 * node + 1] = part[~right], part[right]
    return Tree(np.ascontiguousarray(axes), along, cuts)


def in_cells(rows: DataFrame, tree: Tree, vec: str) -> DataFrame:
    """Add the ``cell`` of each row; rows with numbers that are not finite, which no search finds, are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = to_matrix(batch.column(vec))
            if batch.num_rows and not np.isfinite(matrix).all():
                finite = np.isfinite(matrix).all(axis=1)
                batch, matrix = batch.filter(pa.array(finite)), matrix[finite]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.cell(matrix))], [*batch.schema.names, "cell"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, cell int")


def halves(turned: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
    """``at`` cut at medians until no piece has more than ``most`` rows."""
    if len(at) <= most:
        return [at]
    part = turned[at]
    wide = part[:, part.var(axis=0).argmax()]
    half = len(at) // 2
    order = np.argpartition(wide, half)
    return halves(turned, at[order[:half]], most) + halves(turned, at[order[half:]], most)


def pack(rows: DataFrame, tree: Tree, key: str, vec: str, n_rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks ``(cell, block, n, ends, data, low, high, longest, <a list per other column>)`` of rows with a ``cell``.

    ``data`` is the matrix of the vectors, leaf after leaf; ``ends`` says where leaves end; ``low`` and ``high`` are the block's box and
    ``longest`` the square of its longest row.
    """
    names = [c for c in rows.columns if c not in (vec, "cell")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / PART_ROWS))
    # Ranges of (cell, hash): a cell with a third of all rows is many partitions.
    dealt = rows.repartitionByRange(parts, "cell", F.xxhash64(key)).sortWithinPartitions("cell")
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    held_rows, leaf_rows = max(HELD_ROWS, block_rows), max(1, min(LEAF_ROWS, block_rows // 2))

    def blocks(waiting: list[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        matrix = to_matrix(table.column(vec))
        turned = shared.value.turned(matrix)
        place = TaskContext.get().partitionId() << 32
        for number, at in enumerate(halves(turned, np.arange(len(matrix)), block_rows)):
            leaves = halves(turned, at, leaf_rows)
            order = np.concatenate(leaves)
            some, box = table.select(names).take(pa.array(order)), turned[at]
            whole = [pa.array([len(order)], pa.int32()), pa.array([np.cumsum([len(x) for x in leaves]).astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([matrix[order].tobytes()], pa.binary()), pa.array([box.min(axis=0)], pa.list_(pa.float64())), pa.array([box.max(axis=0)], pa.list_(pa.float64()))]
            whole.append(pa.array([np.einsum("ij,ij->i", box, box).max()]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), some.column(n).combine_chunks()) for n in names]
            yield pa.RecordBatch.from_arrays(
                [table.column("cell").combine_chunks()[:1], pa.array([place + first + number], pa.int64()), *whole, *lists],
                ["cell", "block", "n", "ends", "data", "low", "high", "longest", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, last, number = [], 0, None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for start, stop in zip(edges, edges[1:]):
                while start < stop:
                    if held and (cell[start] != last or held >= held_rows):
                        for out in blocks(waiting, number):
                            number += 1
                            yield out
                        waiting, held = [], 0
                    taken = min(stop - start, held_rows - held)
                    waiting.append(batch.slice(start, taken))
                    start, held, last = start + taken, held + taken, cell[start]
        if held:
            yield from blocks(waiting, number)

    lists = ", ".join(f"`{n}` array<{rows.schema[n].dataType.simpleString()}>" for n in names)
    return dealt.mapInArrow(run, f"cell int, block long, n int, ends array<int>, data binary, low array<double>, high array<double>, longest double, {lists}")


def matrix_of(batch: pa.RecordBatch, row: int) -> np.ndarray:
    data = np.frombuffer(batch.column("data")[row].as_buffer(), np.float64)
    return data.reshape(batch.column("n")[row].as_py(), -1)


def list_of(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """A list column's values; strings as a numpy array of texts."""
    values = batch.column(name)[row].values
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return np.asarray(values.to_pylist(), dtype=str)
    return values.to_numpy(zero_copy_only=False)


def leaf_boxes(turned: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the leaves, and the corners of their boxes."""
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    return starts, np.minimum.reduceat(turned, starts), np.maximum.reduceat(turned, starts)


def gap_squares(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Squared distances of boxes, every a with every b."""
    out = np.zeros((len(low_a), len(low_b)), dtype=low_a.dtype)
    for j in range(low_a.shape[1]):
        gap = np.maximum(low_b[None, :, j] - high_a[:, None, j], low_a[:, None, j] - high_b[None, :, j])
        out += np.square(np.maximum(gap, 0.0, out=gap), out=gap)
    return out


def point_squares(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to one box."""
    gap = np.maximum(low - points, points - high)
    np.maximum(gap, 0.0, out=gap)
    return np.einsum("ij,ij->i", gap, gap)


def grouped(blocks: DataFrame, group_rows: int) -> tuple[DataFrame, int]:
    """``(block, group)`` and the number of groups, about as many rows in each.

    Neighbouring blocks need the same others; but a crowded region is work for more than one group, so each group has several runs of neighbours.
    """
    spark = blocks.sparkSession
    found = blocks.select("cell", "block", "n").toArrow().sort_by([("cell", "ascending"), ("block", "ascending")])
    rows = found.column("n").to_numpy().astype(np.int64)
    groups = min(len(rows), max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows.sum() / group_rows)))
    run = (np.cumsum(rows) - rows) * (RUNS * groups) // max(rows.sum(), 1)
    names, group = np.unique(run % max(groups, 1), return_inverse=True)
    return spark.createDataFrame(pa.table([found.column("block"), pa.array(group.astype(np.int32))], names=["block", "group"])), len(names)


def met(
    asked: DataFrame, shown: DataFrame, groups: DataFrame, n_groups: int, needs: DataFrame,
    ask_names: Sequence[str], show_names: Sequence[str], run: Callable, ddl: str,
) -> DataFrame:
    """``run`` over the partitions of all groups: first the group's own blocks (``kind`` 0), then those it needs (1), the nearest first.

    ``needs``: ``group, block, near``, the largest ``near`` first.
    """
    types = {f.name: f.dataType for f in [*asked.schema.fields, *shown.schema.fields]}

    def side(blocks: DataFrame, kind: int, own: Sequence[str]) -> DataFrame:
        mine = lambda c: F.col(c) if c in own else F.lit(None).cast(types[c])
        return blocks.select("group", F.lit(kind).alias("kind"), "near", "block", "n", "ends", "data", *[mine(c).alias(c) for c in (*ask_names, *show_names)])

    own = side(asked.join(F.broadcast(groups), "block").withColumn("near", F.lit(0.0)), 0, ask_names)
    others = side(shown.join(needs, "block"), 1, show_names)
    dealt = own.unionByName(others).repartitionById(n_groups, F.col("group")).sortWithinPartitions("kind", F.desc("near"), "block")
    return dealt.mapInArrow(run, ddl)


# ------------------------------------------------------------ nearest by inner product

class Search:
    """The best ``k`` items so far of the queries of one group, and the score each has to beat."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, floor: np.ndarray, ends: np.ndarray, tree: Tree, k: int):
        self.ids, self.matrix, self.floor, self.k, self.tree = ids, matrix, floor.copy(), k, tree
        self.square = np.einsum("ij,ij->i", matrix, matrix)
        turned, self.short = tree.turned(matrix), matrix.astype(np.float32)
        self.ahead, self.most = np.ascontiguousarray(turned[:, :AXES], dtype=np.float32), self.square.max(initial=0.0)
        self.starts, self.low, self.high = leaf_boxes(turned, ends)
        self.sizes = np.diff(np.r_[self.starts, len(matrix)])
        self.longest = np.maximum.reduceat(self.square, self.starts)
        self.least = np.minimum.reduceat(self.floor, self.starts)
        self.parts, self.held, self.full, self.last = [], 0, np.zeros(len(matrix), dtype=bool), None

    def see(self, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> None:
        from profilekit.operators.nearest import MARGIN, Hits

        starts, low, high = leaf_boxes(self.tree.turned(matrix), ends)
        longest = np.maximum.reduceat(np.einsum("ij,ij->i", matrix, matrix), starts)
        short, ahead = matrix.astype(np.float32), (low[:, :AXES].astype(np.float32), high[:, :AXES].astype(np.float32))
        below, above, top = low.min(axis=0), high.max(axis=0), longest.max()
        # |a - b|^2 = a^2 + b^2 - 2ab: no product between two boxes is more than this.
        most = (self.longest + top - gap_squares(self.low, self.high, below[None], above[None])[:, 0]) / 2
        rows = np.flatnonzero(np.repeat(most >= self.least - SLACK, self.sizes))
        # Singles first, with room for their rounding; what they let through is computed again in doubles.
        room = ROOM * (top + self.most)
        allowed = 2 * (room - self.floor[rows]) + self.square[rows]
        near = point_squares(self.ahead[rows], ahead[0].min(axis=0), ahead[1].max(axis=0)) <= allowed + top
        rows, allowed = rows[near], allowed[near]
        if len(rows) == 0:
            return
        near = (gap_squares(self.ahead[rows], self.ahead[rows], *ahead) <= allowed[:, None] + longest[None, :]).T
        for leaf, (start, stop) in enumerate(zip(starts, np.r_[starts[1:], len(matrix)])):
            found = rows[near[leaf]]
            step = max(16, STEP_SCORES // int(stop - start))
            for at in (found[i:i + step] for i in range(0, len(found), step)):
                scores = self.short[at] @ short[start:stop].T
                bar = self.floor[at]
                free = np.flatnonzero(bar < -1.5)
                if len(free) and scores.shape[1] > self.k:
                    bar[free] = -np.partition(-scores[free], self.k - 1, axis=1)[:, self.k - 1] - room
                qi, ii = np.nonzero(scores >= (bar - room).astype(np.float32)[:, None])
                qi, ii = at[qi], start + ii
                score = np.einsum("ij,ij->i", self.matrix[qi], matrix[ii])
                new = score >= self.floor[qi] - MARGIN
                qi, ii, score = qi[new], ii[new], np.round(score[new], 9) + 0.0
                if self.last is not None:
                    # With k items known, an equal score needs a smaller id.
                    new = ~self.full[qi] | (score > self.floor[qi]) | ((score == self.floor[qi]) & (ids[ii] < self.last[qi]))
                    qi, ii, score = qi[new], ii[new], score[new]
                self.parts.append(Hits(qi, ids[ii], score))
                self.held += len(qi)
                if self.held > (2 * self.k if self.last is not None else self.k) * len(self.floor):
                    self.settle()

    def settle(self):
        """Keep the best and raise the floors."""
        from profilekit.operators.nearest import _merge

        if not self.parts:
            return None
        best = _merge(self.parts, self.k)
        self.parts, self.held = [best], len(best.query)
        counts = np.bincount(best.query, minlength=len(self.floor))
        full = np.flatnonzero(counts >= self.k)
        place = np.cumsum(counts)[full] - 1
        if len(full):
            # A floor from elsewhere may be above: then the k-th item is still to come.
            settled = best.score[place] >= self.floor[full]
            full, place = full[settled], place[settled]
            self.floor[full] = best.score[place]
            if self.last is None or self.last.dtype != best.item.dtype:
                self.last = np.zeros(len(self.floor), dtype=best.item.dtype)
            self.full[:] = False
            self.full[full], self.last[full] = True, best.item[place]
            self.least = np.minimum.reduceat(self.floor, self.starts)
        return best


def _floors(asked: DataFrame, shown: DataFrame, k: int) -> DataFrame:
    """Query blocks with the score to beat: the ``k``-th best in the first block of items of their cell, -2 without as many."""
    first = F.broadcast(shown.groupBy("cell").agg(F.min("block").alias("block")))
    opening = shown.join(first, ["cell", "block"], "left_semi").select("cell", F.col("data").alias("item_data"), F.col("n").alias("item_n"))
    kept = ["cell", "block", "n", "ends", "data", "query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, q = batch.slice(row, 1), matrix_of(batch, row)
                floor = np.full(len(q), -2.0)
                n = batch.column("item_n")[row].as_py()
                if n is not None and n >= k:
                    items = np.frombuffer(batch.column("item_data")[row].as_buffer(), np.float64).reshape(n, -1)
                    for start in range(0, len(q), 512):
                        scores = q[start:start + 512] @ items.T
                        floor[start:start + 512] = np.round(-np.partition(-scores, k - 1, axis=1)[:, k - 1], 9) + 0.0
                one = pa.ListArray.from_arrays(pa.array([0, len(floor)], pa.int32()), pa.array(floor))
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, one], [*kept, "floor"])

    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.join(opening, "cell", "left").mapInArrow(
        run, f"cell int, block long, n int, ends array<int>, data binary, query_id {kind}, floor array<double>")


def box_table(blocks: DataFrame, *more: str) -> pa.Table:
    """Numbers and boxes of all blocks, on the driver: one small row per block."""
    return blocks.select("block", "low", "high", *more).toArrow()


def search(queries: DataFrame, items: DataFrame, k: int, n_queries: int, n_items: int, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """Top-k by inner product, ``(query_id, item_id, score)``.

    None where boxes leave out so little that blocks would be moved too often.
    """
    from profilekit.operators.nearest import _emit, _pair_schema

    spark = items.sparkSession
    ddl, schema = _pair_schema(queries, items)
    if n_queries == 0 or n_items == 0:
        return spark.createDataFrame([], ddl)
    tree = learn_tree(items, "item_id", "item_vec", n_items, block_rows)
    shown = materialise(pack(in_cells(items, tree, "item_vec"), tree, "item_id", "item_vec", n_items, block_rows))
    asked = materialise(_floors(pack(in_cells(queries, tree, "query_vec"), tree, "query_id", "query_vec", n_queries, block_rows), shown, k))
    groups, n_groups = grouped(asked, max(block_rows, min(GROUP_ROWS, GROUP_HITS // k)))
    boxes = box_table(shown, "longest")
    if n_groups == 0 or boxes.num_rows == 0:
        return spark.createDataFrame([], ddl)
    shared = spark.sparkContext.broadcast((
        tree, boxes.column("block").to_numpy(), to_matrix(boxes.column("low")), to_matrix(boxes.column("high")), boxes.column("longest").to_numpy()))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number, low, high, top = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                q = matrix_of(batch, row)
                starts, below, above = leaf_boxes(tree.turned(q), list_of(batch, "ends", row))
                longest = np.maximum.reduceat(np.einsum("ij,ij->i", q, q), starts)
                least = np.minimum.reduceat(list_of(batch, "floor", row), starts)
                most = (longest[:, None] + top[None, :] - gap_squares(below, above, low, high)) / 2
                near = np.where(most >= least[:, None] - SLACK, most, -np.inf).max(axis=0)
                hit = np.flatnonzero(near > -np.inf)
                group = np.full(len(hit), batch.column("group")[row].as_py(), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(number[hit]), pa.array(near[hit])], ["group", "block", "near"])

    own = asked.select("block", "n", "ends", "data", "floor").join(F.broadcast(groups), "block")
    needs = materialise(own.mapInArrow(needed, "group int, block long, near double").groupBy("group", "block").agg(F.max("near").alias("near")))
    if needs.count() > max(MOVES, 2 * spark.sparkContext.defaultParallelism) * boxes.num_rows:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, group = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                ends = list_of(batch, "ends", row)
                if batch.column("kind")[row].as_py() == 0:
                    waiting.append((list_of(batch, "query_id", row), np.array(matrix_of(batch, row)), list_of(batch, "floor", row), ends))
                    continue
                if group is None:
                    group, waiting = Search(*joined(waiting), shared.value[0], k), None
                group.see(list_of(batch, "item_id", row), matrix_of(batch, row), ends)
        found = group.settle() if group is not None else None
        if found is not None:
            for at in range(0, len(found.query), 65_536):
                yield from _emit(group, found.rows(at, at + 65_536), schema).to_batches()

    return met(asked, shown, groups, n_groups, needs, ("query_id", "floor"), ("item_id",), run, ddl)


def joined(blocks: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Blocks one after the other; the last column says where leaves end."""
    *columns, ends = zip(*blocks)
    before = np.cumsum([0, *(e[-1] for e in ends[:-1])])
    return [*map(np.concatenate, columns), np.concatenate([e + b for e, b in zip(ends, before)])]
