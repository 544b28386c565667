"""Exact and cell-restricted top-k by inner product of unit vectors.

Four ways to the same answer, chosen by checked sizes:

* few items: they are broadcast, every query is answered inside its task;
* few queries: they are broadcast, every task keeps a running top-k per query;
* otherwise short vectors are searched by boxes (:mod:`profilekit.operators.boxes`);
* where those leave out too little, both sides meet in tiles of bounded size. Items are assigned to
  cells around sampled centres; a first pass over a tile of each query's own cell
  gives the score to beat, a second pass compares only with cells whose angular bound
  can still beat it. Tiles are packed into one row each and every tile of queries goes
  through the tiles of items inside a task, so vectors are moved a fixed number of
  times; a cell holding a third of all rows is many tiles, and copies of one vector,
  which hashes find, are searched once.

Scores are rounded to nine places and ties go to the smaller id, so the result
does not depend on partitioning.

Queries: ``query_id, query_vec`` and optionally ``want_role, min_period, max_period``
(null means no restriction). Items: ``item_id, item_vec`` and optionally ``role, period``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilekit.functions.vector import to_matrix
from profilekit.session import materialise

BROADCAST_QUERIES = 16_384
BROADCAST_ITEMS = 65_536
BROADCAST_VALUES = 8_388_608
TILE_ROWS = 4096
STEP_SCORES = 8_388_608
STEP_ROWS = 2048
MAX_CELLS = 1024
BLOCK_VALUES = 262_144
PART_ROWS = 65_536
PART_VALUES = 16_777_216
#: Longer vectors are not searched by boxes: in so many directions hardly any box lies far enough away.
BOX_WIDTH = 32
QUERY_LIMITS = ("want_role", "min_period", "max_period")
ITEM_LIMITS = ("role", "period")
MARGIN = 2e-9


@dataclass
class Side:
    """Rows of one side inside a task."""

    ids: np.ndarray
    matrix: np.ndarray
    limits: dict[str, np.ndarray]

    @staticmethod
    def read(table, id_name: str, vec_name: str, limit_names: Sequence[str]) -> "Side":
        present = [n for n in limit_names if n in table.schema.names]
        return Side(
            _plain(table.column(id_name)),
            to_matrix(table.column(vec_name)),
            {n: np.asarray(table.column(n).to_pylist(), dtype=object) for n in present},
        )

    def rows(self, start: int, stop: int) -> "Side":
        return Side(self.ids[start:stop], self.matrix[start:stop], {n: v[start:stop] for n, v in self.limits.items()})


@dataclass
class Hits:
    """Flat (query position, item id, score) triples."""

    query: np.ndarray
    item: np.ndarray
    score: np.ndarray

    def rows(self, start: int, stop: int) -> "Hits":
        return Hits(self.query[start:stop], self.item[start:stop], self.score[start:stop])

    def cut(self, k: int) -> "Hits":
        order = np.lexsort((self.item, -self.score, self.query))
        q = self.query[order]
        first = np.searchsorted(q, q, side="left")
        keep = order[np.arange(len(q)) - first < k]
        return Hits(self.query[keep], self.item[keep], self.score[keep])


def _plain(column) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.asarray(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _allowed(q: Side, i: Side) -> np.ndarray | None:
    """Which query may see which item; ``None`` when nothing is restricted."""
    mask = None
    if "want_role" in q.limits:
        want, have = q.limits["want_role"], i.limits["role"]
        codes = {v: n for n, v in enumerate(dict.fromkeys([*want, *have]))}
        free = np.array([v is None for v in want])
        w, h = np.array([codes[v] for v in want]), np.array([codes[v] for v in have])
        mask = free[:, None] | (w[:, None] == h[None, :])
    for name, keep in (("min_period", np.greater_equal), ("max_period", np.less_equal)):
        if name in q.limits:
            bound = np.array([np.nan if v is None else float(v) for v in q.limits[name]])
            period = np.array([np.nan if v is None else float(v) for v in i.limits["period"]])
            part = np.isnan(bound)[:, None] | keep(period[None, :], bound[:, None])
            mask = part if mask is None else mask & part
    return mask


def _best(q: Side, i: Side, k: int) -> Hits:
    """Each query's ``k`` best items of one block, by (score, id)."""
    scores = q.matrix @ i.matrix.T
    mask = _allowed(q, i)
    if mask is not None:
        scores = np.where(mask, scores, -np.inf)
    if scores.shape[1] > k:
        bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        qi, ii = np.nonzero(scores >= (bar - MARGIN)[:, None])
    else:
        qi, ii = np.nonzero(scores > -np.inf)
    flat = scores[qi, ii]
    real = np.isfinite(flat)
    return Hits(qi[real], i.ids[ii[real]], np.round(flat[real], 9) + 0.0).cut(k)


def _merge(parts: list[Hits], k: int) -> Hits:
    return Hits(
        np.concatenate([p.query for p in parts]),
        np.concatenate([p.item for p in parts]),
        np.concatenate([p.score for p in parts]),
    ).cut(k)


def _emit(q: Side, hits: Hits, schema: pa.Schema) -> pa.Table:
    return pa.table(
        [
            pa.array(q.ids[hits.query].tolist(), schema.field(0).type),
            pa.array(hits.item.tolist(), schema.field(1).type),
            pa.array(hits.score, schema.field(2).type),
        ],
        schema=schema,
    )


def _step(other_rows: int) -> int:
    """Rows per step so that one block of scores stays within ``STEP_SCORES`` numbers."""
    return max(16, STEP_SCORES // max(other_rows, 1))


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def _pair_schema(queries: DataFrame, items: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    q, i = queries.schema["query_id"].dataType, items.schema["item_id"].dataType
    text = f"query_id {q.simpleString()}, item_id {i.simpleString()}, score double"
    return text, pa.schema([("query_id", to_arrow_type(q)), ("item_id", to_arrow_type(i)), ("score", pa.float64())])


def _columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def _collected(df: DataFrame, id_name: str, vec_name: str, limit_names: Sequence[str]) -> Side:
    return Side.read(df.toArrow(), id_name, vec_name, limit_names)


def _fits(df: DataFrame, vec_name: str, rows: int) -> bool:
    """True when a side has few enough rows and numbers to be broadcast.

    ``head`` stops reading after the first partitions that hold enough rows, which a
    limit inside a larger plan would not.
    """
    widths = df.select(F.size(vec_name)).head(rows + 1)
    return len(widths) <= rows and sum(w[0] or 0 for w in widths) <= BROADCAST_VALUES


def top_by_score(pairs: DataFrame, k: int) -> DataFrame:
    """Keep each query's ``k`` best pairs and number them."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    exclude_self: bool = True,
    broadcast_queries: int = BROADCAST_QUERIES,
    broadcast_items: int = BROADCAST_ITEMS,
    tile_rows: int = TILE_ROWS,
    cells=None,
) -> DataFrame:
    """Exact top-k: ``(query_id, item_id, score, rank)``.

    With ``cells``, a stored :class:`~profilekit.operators.cell_index.CellIndex` of the items, only the cells it
    allows are searched: approximate, with the recall measured when it was built.
    """
    fetch = k + 1 if exclude_self else k
    queries = queries.select(*_columns(queries, ("query_id", "query_vec", *QUERY_LIMITS)))
    if cells is not None:
        from profilekit.operators.cell_index import search_cells_stored

        pairs = search_cells_stored(queries, cells, fetch, tile_rows).drop("rank")
        return top_by_score(pairs.filter(F.col("query_id") != F.col("item_id")) if exclude_self else pairs, k)
    items = items.select(*_columns(items, ("item_id", "item_vec", *ITEM_LIMITS)))
    few_queries = _fits(queries, "query_vec", broadcast_queries)
    if _fits(items, "item_vec", broadcast_items):
        # a small file is one partition: spread queries known to be few over all cores
        cores = queries.sparkSession.sparkContext.defaultParallelism
        pairs = _few_items(queries.repartition(cores) if few_queries else queries, items, fetch)
    elif few_queries:
        pairs = _few_queries(queries, items, fetch)
    else:
        pairs = _tiled(queries, items, fetch, tile_rows)
    if exclude_self:
        pairs = pairs.filter(F.col("query_id") != F.col("item_id"))
    return top_by_score(pairs, k)


# ------------------------------------------------------------ broadcast ways

def _few_queries(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    ddl, schema = _pair_schema(queries, items)
    side = _collected(queries, "query_id", "query_vec", QUERY_LIMITS)
    if len(side.ids) == 0:
        return queries.sparkSession.createDataFrame([], ddl)
    shared = queries.sparkSession.sparkContext.broadcast(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kept = shared.value, None
        step = _step(len(q.ids))
        for batch in batches:
            block = Side.read(batch, "item_id", "item_vec", ITEM_LIMITS)
            for start in range(0, len(block.ids), step):
                found = _best(q, block.rows(start, start + step), k)
                kept = found if kept is None else _merge([kept, found], k)
        if kept is not None:
            yield from _emit(q, kept, schema).to_batches()

    return items.mapInArrow(run, ddl)


def _few_items(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    ddl, schema = _pair_schema(queries, items)
    side = _collected(items, "item_id", "item_vec", ITEM_LIMITS)
    if len(side.ids) == 0:
        return queries.sparkSession.createDataFrame([], ddl)
    shared = queries.sparkSession.sparkContext.broadcast(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_side = shared.value
        step = _step(len(items_side.ids))
        for batch in batches:
            block = Side.read(batch, "query_id", "query_vec", QUERY_LIMITS)
            for start in range(0, len(block.ids), step):
                part = block.rows(start, start + step)
                yield from _emit(part, _best(part, items_side, k), schema).to_batches()

    return queries.mapInArrow(run, ddl)


# ------------------------------------------------------------------ tiled way

def _first_copies(items: DataFrame, k: int) -> DataFrame:
    """At most ``k`` copies of one vector can appear in a top-k, those with the smallest ids."""
    same = [c for c in items.columns if c != "item_id"]
    order = Window.partitionBy(*same).orderBy("item_id")
    return items.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= k).drop("_copy")


def _counted(side: DataFrame, same: Sequence[str]) -> tuple[int, bool]:
    """Rows, and whether two of them may agree in ``same``: only hashes are shuffled, never vectors."""
    hashes = side.groupBy(F.xxhash64(*same).alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    found = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return found["rows"], found["most"] > 1


def sample_centres(items: DataFrame, count: int, n_items: int, vec: str = "item_vec", key: str = "item_id") -> np.ndarray:
    """A repeatable sample of item vectors, at most ``MAX_CELLS`` of them.

    A hash filter keeps about twice as many rows as wanted, whatever the number of
    items, before the smallest hashes are taken.
    """
    wanted = min(count, MAX_CELLS)
    share = min(1.0, (2 * wanted + 50) / max(n_items, 1))
    kept = items.select(key, vec, F.xxhash64(key).alias("_h")).filter(
        F.pmod("_h", F.lit(1_000_000_007)) <= int(share * 1_000_000_007)
    )
    return to_matrix(kept.orderBy("_h", key).limit(wanted).select(vec).toArrow().column(vec))


def cell_count(n_items: int) -> int:
    return max(1, min(MAX_CELLS, int(math.sqrt(n_items))))


def _angles(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(matrix @ centres.T, -1.0, 1.0))


def assign_cells(items: DataFrame, centres: np.ndarray, vec: str = "item_vec") -> DataFrame:
    """Add the nearest centre and the angle to it."""
    shared = items.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            angles = _angles(to_matrix(batch.column(vec)), shared.value)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])],
                [*batch.schema.names, "cell", "angle"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInArrow(run, f"{ddl}, cell int, angle double")


@dataclass
class Cells:
    """Centres with the size and the widest angle of each cell."""

    centres: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray


def cell_summary(assigned: DataFrame, centres: np.ndarray) -> Cells:
    sizes, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for row in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
        sizes[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    return Cells(centres, sizes, radius)


def _placed(queries: DataFrame, cells: Cells, most: int | None) -> DataFrame:
    """Add each query's nearest cell and its reach: the cosine of the last of the ``most`` nearest cells, -2 with all allowed."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        limited = most is not None and most < (c.sizes > 0).sum()
        step = min(STEP_ROWS, _step(len(c.centres)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                near = np.where(c.sizes > 0, to_matrix(part.column("query_vec")) @ c.centres.T, -np.inf)
                reach = -np.partition(-near, most - 1, axis=1)[:, most - 1] if limited else np.full(len(near), -2.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near.argmax(axis=1).astype(np.int32)), pa.array(reach)], [*part.schema.names, "cell", "reach"])

    return queries.mapInArrow(run, f"{ddl}, cell int, reach double")


def _lists(df: DataFrame, names: Sequence[str]) -> str:
    """Columns of packed rows: a list per column; vectors are the bytes of one matrix."""
    return ", ".join(f"`{n}` array<{df.schema[n].dataType.simpleString()}>" for n in names)


def _packed(rows: DataFrame, key: str, vec: str, n_rows: int, tile_rows: int) -> DataFrame:
    """Rows of one cell as blocks: up to ``tile_rows`` of them, and ``BLOCK_VALUES`` numbers, in one row."""
    names = [c for c in rows.columns if c not in (vec, "cell")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / PART_ROWS))
    # Ranges of (cell, hash): a cell with a third of all rows is many partitions.
    dealt = rows.repartitionByRange(parts, "cell", F.xxhash64(key)).sortWithinPartitions("cell")

    def block(waiting: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(n).combine_chunks()) for n in names]
        data = pa.array([to_matrix(table.column(vec)).tobytes()], pa.binary())
        place = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays(
            [*lists, data, table.column("cell").combine_chunks()[:1], pa.array([place], pa.int64())], [*names, vec, "cell", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, last, number, most = [], 0, None, 0, tile_rows
        for batch in batches:
            if batch.num_rows == 0:
                continue
            width = max(len(batch.column(vec)[0] or ()), 1)
            most = max(16, min(tile_rows, BLOCK_VALUES // width))
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for start, stop in zip(edges, edges[1:]):
                while start < stop:
                    if held and (cell[start] != last or held >= most):
                        yield block(waiting, number)
                        waiting, held, number = [], 0, number + 1
                    taken = min(stop - start, most - held)
                    waiting.append(batch.slice(start, taken))
                    start, held, last = start + taken, held + taken, cell[start]
        if held:
            yield block(waiting, number)

    return dealt.mapInArrow(run, f"{_lists(rows, names)}, `{vec}` binary, cell int, block long")


def _unpacked(batch: pa.RecordBatch, row: int, id_name: str, vec_name: str, limit_names: Sequence[str]) -> Side:
    ids = batch.column(id_name)[row].values
    matrix = np.array(np.frombuffer(batch.column(vec_name)[row].as_buffer(), np.float64)).reshape(len(ids), -1)
    present = [n for n in limit_names if n in batch.schema.names]
    return Side(_plain(ids), matrix, {n: np.asarray(batch.column(n)[row].values.to_pylist(), dtype=object) for n in present})


def _joined(blocks: Iterator[pa.RecordBatch], vec: str, tile_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of several cells, of up to ``tile_rows`` rows: ``cell`` becomes a list, ``block`` the number of the first."""

    def one(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        names = [n for n in waiting[0].schema.names if n not in (vec, "cell", "block")]
        lists = [pa.concat_arrays([w.column(n)[0].values for w in waiting]) for n in names]
        sizes = [len(w.column(names[0])[0]) for w in waiting]
        lists.append(pa.array(np.repeat([w.column("cell")[0].as_py() for w in waiting], sizes).astype(np.int32)))
        whole = [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for values in lists]
        data = pa.array([b"".join(w.column(vec)[0].as_py() for w in waiting)], pa.binary())
        return pa.RecordBatch.from_arrays([*whole, data, waiting[0].column("block")[:1]], [*names, "cell", vec, "block"])

    waiting, held, size = [], 0, 0
    for batch in blocks:
        for row in range(batch.num_rows):
            part = batch.slice(row, 1)
            rows, data = len(part.column(0)[0]), len(part.column(vec)[0].as_buffer())
            if held and (held + rows > tile_rows or size + data > 8 * BLOCK_VALUES):
                yield one(waiting)
                waiting, held, size = [], 0, 0
            waiting.append(part)
            held, size = held + rows, size + data
    if held:
        yield one(waiting)


def _joined_items(packed: DataFrame, items: DataFrame, tile_rows: int) -> DataFrame:
    names = [c for c in packed.columns if c not in ("item_vec", "cell", "block")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _joined(batches, "item_vec", tile_rows):
            yield out.select([*names, "cell", "item_vec", "block"])

    return packed.mapInArrow(run, f"{_lists(items, names)}, cell array<int>, item_vec binary, block long")


def _floored(asked: DataFrame, shown: DataFrame, queries: DataFrame, k: int, tile_rows: int) -> DataFrame:
    """Blocks of queries with the score to beat: the ``k``-th best in the first block of their own cell, -2 without as many."""
    first = F.broadcast(shown.groupBy("cell").agg(F.min("block").alias("block")))
    opening = shown.join(first, ["cell", "block"], "left_semi").drop("block")
    names = [c for c in asked.columns if c not in ("query_vec", "cell", "block")]
    order = [*names, "floor", "cell", "query_vec", "block"]

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                q = _unpacked(part, 0, "query_id", "query_vec", QUERY_LIMITS)
                floor = np.full(len(q.ids), -2.0)
                if part.column("item_id")[0].is_valid:
                    pile = Pile(q, floor, np.full(len(floor), -2.0), k)
                    pile.compare(_unpacked(part, 0, "item_id", "item_vec", ITEM_LIMITS), np.arange(len(floor)), None)
                    pile.settle()
                    floor = pile.floor
                kept = part.select([*names, "query_vec", "cell", "block"])
                one = pa.ListArray.from_arrays(pa.array([0, len(floor)], pa.int32()), pa.array(floor))
                yield pa.RecordBatch.from_arrays([one, *kept.columns], ["floor", *kept.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _joined(floors(batches), "query_vec", tile_rows):
            yield out.select(order)

    return asked.join(opening, "cell", "left").mapInArrow(
        run, f"{_lists(queries, names)}, floor array<double>, cell array<int>, query_vec binary, block long")


class Pile:
    """The best ``k`` items so far of one block of queries, the score that each query has to beat and how far it may look."""

    def __init__(self, q: Side, floor: np.ndarray, reach: np.ndarray, k: int):
        self.q, self.floor, self.reach, self.k = q, floor.copy(), reach, k
        self.parts: list[Hits] = []
        self.held = 0

    def see(self, i: Side, cell: np.ndarray, cells: Cells) -> None:
        """Compare with a block of items, in the order of their cells, leaving out cells that cannot beat the floor."""
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        stops = np.r_[starts[1:], len(cell)]
        own = cell[starts]
        near = np.clip(self.q.matrix @ cells.centres[own].T, -1.0, 1.0)
        inside = near >= self.reach[:, None] - 1e-12
        visit = inside & (np.cos(np.maximum(np.arccos(near) - cells.radius[own], 0.0)) >= self.floor[:, None] - 1e-6)
        rows, runs = np.flatnonzero(visit.any(axis=1)), np.flatnonzero(visit.any(axis=0))
        if len(rows) == 0:
            return
        # Where few of the pairs of queries and cells are left, cell by cell; otherwise all in one product.
        each = [(np.flatnonzero(visit[:, r]), runs[j:j + 1]) for j, r in enumerate(runs)] if visit.sum() < len(rows) * len(runs) / 4 else [(rows, runs)]
        for some, chosen in each:
            at = np.concatenate([np.arange(starts[r], stops[r]) for r in chosen])
            allowed = None if inside[np.ix_(some, chosen)].all() else np.repeat(inside[:, chosen], stops[chosen] - starts[chosen], axis=1)
            part = i if len(at) == len(cell) else Side(i.ids[at], i.matrix[at], {n: v[at] for n, v in i.limits.items()})
            self.compare(part, some, allowed)

    def compare(self, i: Side, rows: np.ndarray, allowed: np.ndarray | None) -> None:
        step = _step(len(i.ids))
        for start in range(0, len(rows), step):
            at = rows[start:start + step]
            q = Side(self.q.ids[at], self.q.matrix[at], {n: v[at] for n, v in self.q.limits.items()})
            scores = q.matrix @ i.matrix.T
            mask = _allowed(q, i)
            if allowed is not None:
                mask = allowed[at] if mask is None else mask & allowed[at]
            if mask is not None:
                scores = np.where(mask, scores, -np.inf)
            bar = self.floor[at] - MARGIN
            free = np.flatnonzero(bar < -1.5)
            if len(free) and scores.shape[1] > self.k:
                bar[free] = -np.partition(-scores[free], self.k - 1, axis=1)[:, self.k - 1] - MARGIN
            qi, ii = np.nonzero(scores >= bar[:, None])
            flat = scores[qi, ii]
            real = np.isfinite(flat)
            self.parts.append(Hits(at[qi[real]], i.ids[ii[real]], np.round(flat[real], 9) + 0.0))
            self.held += int(real.sum())
            if self.held > 4 * self.k * len(self.q.ids):
                self.settle()

    def settle(self) -> Hits:
        """Keep the best and raise the floors."""
        best = _merge(self.parts, self.k)
        self.parts, self.held = [best], len(best.query)
        counts = np.bincount(best.query, minlength=len(self.floor))
        full = np.flatnonzero(counts >= self.k)
        self.floor[full] = np.maximum(self.floor[full], best.score[np.cumsum(counts)[full] - 1])
        return best


def _sweep(queries: DataFrame, items: DataFrame, cells: Cells, k: int, most: int | None, n_queries: int, tile_rows: int) -> DataFrame:
    """Top-k of items ``item_id, item_vec, cell``: every block of queries goes through all blocks of items.

    Vectors are moved a fixed number of times, whatever the number of cells a query looks into: blocks of both sides meet in the tasks.
    A task holds one block of each side and the best ``k`` items of the block's queries, and goes through at most ``PART_VALUES`` numbers.
    """
    ddl, schema = _pair_schema(queries, items)
    if not cells.sizes.any() or n_queries == 0:
        return queries.sparkSession.createDataFrame([], ddl)
    placed = _placed(queries, cells, most)
    shown = materialise(_packed(items, "item_id", "item_vec", int(cells.sizes.sum()), tile_rows))
    asked = _packed(placed, "query_id", "query_vec", n_queries, tile_rows)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    left = _floored(asked, shown, placed, k, tile_rows).withColumnsRenamed({"cell": "query_cell", "block": "query_block"})
    right = materialise(_joined_items(shown, items, tile_rows))
    width = cells.centres.shape[1]
    right = right.coalesce(max(1, math.ceil(int(cells.sizes.sum()) * width / PART_VALUES)))
    left = left.repartition(max(2 * cores, math.ceil(n_queries / PART_ROWS)))
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, pile = shared.value, None, None
        for batch in batches:
            for row, block in enumerate(batch.column("query_block").to_pylist()):
                if block != now:
                    if pile is not None and pile.held:
                        yield from _emit(pile.q, pile.settle(), schema).to_batches()
                    q = _unpacked(batch, row, "query_id", "query_vec", QUERY_LIMITS)
                    floor, reach = (batch.column(n)[row].values.to_numpy() for n in ("floor", "reach"))
                    now, pile = block, Pile(q, floor, reach, k)
                pile.see(_unpacked(batch, row, "item_id", "item_vec", ITEM_LIMITS), batch.column("cell")[row].values.to_numpy(), c)
        if pile is not None and pile.held:
            yield from _emit(pile.q, pile.settle(), schema).to_batches()

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, ddl)


def search_cells(queries: DataFrame, assigned: DataFrame, cells: Cells, k: int, nprobe: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Approximate top-k: only the ``nprobe`` nearest cells of each query are searched."""
    return top_by_score(_sweep(queries, assigned.drop("angle"), cells, k, nprobe, queries.count(), tile_rows), k)


def _boxed(queries: DataFrame, items: DataFrame, k: int, n_queries: int, n_items: int, tile_rows: int) -> DataFrame | None:
    """The search by boxes, None for long vectors, limits, and where boxes leave out too little."""
    from profilekit.operators import boxes

    first = items.select(F.size("item_vec")).first()
    if first is None or not 0 < (first[0] or 0) <= BOX_WIDTH or _columns(queries, QUERY_LIMITS) or _columns(items, ITEM_LIMITS):
        return None
    return boxes.search(queries, items, k, n_queries, n_items, min(tile_rows, boxes.BLOCK_ROWS))


def _tiled(queries: DataFrame, items: DataFrame, k: int, tile_rows: int) -> DataFrame:
    queries, items = materialise(queries), materialise(items)
    same = [c for c in queries.columns if c != "query_id"]
    n_queries, has_copies = _counted(queries, same)
    reps = asked = queries
    if has_copies:
        reps = materialise(queries.groupBy(*same).agg(F.min("query_id").alias("query_id"), F.count(F.lit(1)).alias("copies")))
        n_queries, has_copies = reps.count(), reps.filter(F.col("copies") > 1).limit(1).count() > 0
        asked = reps.drop("copies")

    n_items, repeated = _counted(items, [c for c in items.columns if c != "item_id"])
    if repeated:
        items = materialise(_first_copies(items, k))
        n_items = items.count()
    pairs = _boxed(asked, items, k, n_queries, n_items, tile_rows)
    if pairs is None:
        centres = sample_centres(items, cell_count(n_items), n_items)
        assigned = assign_cells(items, centres)
        cells = cell_summary(assigned, centres)
        pairs = _sweep(asked, assigned.drop("angle"), cells, k, None, n_queries, tile_rows)
    if not has_copies:
        return pairs
    pairs = materialise(top_by_score(pairs, k).drop("rank"))
    owners = queries.alias("q").join(
        reps.select(F.col("query_id").alias("rep"), *[F.col(c).alias(f"_{c}") for c in same]).alias("r"),
        [F.col(f"q.{c}").eqNullSafe(F.col(f"_{c}")) for c in same],
    ).select("q.query_id", "rep")
    return owners.join(pairs.withColumnRenamed("query_id", "rep"), "rep").select("query_id", "item_id", "score")
