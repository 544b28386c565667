"""Column statistics that stay distributed: moments in one pass, exact quantiles by bracketing.

Results are a few numbers per column (and per cohort), so they come back to the
driver and enter later plans as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS_PER_PASS = 100
COLUMNS_PER_SKETCH = 25
SMALL_ROWS = 200_000
BRACKET_ROWS = 20_000
#: Size of a sketch; its ranks are off by less than half a percent, nearly always. A miss costs a round, never the answer.
SKETCH_K = 1_024
SLACK = 0.01
#: Values read from a sketch, at evenly spaced ranks.
GRID = 64
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Moments:
    count: int
    mean: float | None
    std_pop: float | None
    std_samp: float | None
    low: float | None
    high: float | None


def _chunks(columns: Sequence[str]) -> list[Sequence[str]]:
    return [columns[i:i + COLUMNS_PER_PASS] for i in range(0, len(columns), COLUMNS_PER_PASS)]


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    out: dict[str, Moments] = {}
    for part in _chunks(columns):
        aggs = [
            F.struct(
                F.count(c), F.avg(c), F.stddev_pop(c), F.stddev_samp(c),
                F.min(c).cast("double"), F.max(c).cast("double"),
            ).alias(f"m{i}")
            for i, c in enumerate(part)
        ]
        row = df.agg(*aggs).first()
        out.update({c: Moments(*row[i]) for i, c in enumerate(part)})
    return out


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: str | None = None,
    small_rows: int = SMALL_ROWS,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[object, dict[str, list[float | None]]]:
    """Exact, linearly interpolated quantiles per column, optionally per value of ``by``.

    Returns ``{group: {column: [quantile per prob]}}`` with group ``None`` when
    ``by`` is not given. ``by`` must be a column of configured, bounded values
    such as a cohort: its quantiles come back to the driver.

    ``percentile`` keeps every distinct value of a group in one task, so it is
    used only up to ``small_rows`` rows. Above that every wanted rank is pinned down
    by narrowing an open interval: a mergeable sketch per group and column proposes two
    values around the rank, one pass counts the rows below, at and between them, and the
    rank falls into a much smaller interval or on one of the values. Only intervals of at
    most ``bracket_rows`` rows are gathered and sorted. All columns and all groups share
    the passes, so their number depends on the largest group, not on how many there are.

    Null values are left out, NaN counts as the largest value, a null group is a group.
    """
    total = df.count()
    groups = [] if by is None else [by]
    if total <= small_rows:
        out: dict[object, dict[str, list[float | None]]] = {}
        for part in _chunks(columns):
            aggs = [F.percentile(F.col(c).cast("double"), list(probs)).alias(f"q{i}") for i, c in enumerate(part)]
            for row in df.groupBy(*groups).agg(*aggs).collect():
                key = row[by] if by else None
                out.setdefault(key, {}).update(
                    {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(part)}
                )
        return out

    out = {}
    for i in range(0, len(columns), COLUMNS_PER_SKETCH):
        for key, found in _pinned_quantiles(df, columns[i:i + COLUMNS_PER_SKETCH], probs, by, bracket_rows).items():
            out.setdefault(key, {}).update(found)
    return out


@dataclass
class _Target:
    """One wanted rank of one column of one group: rows strictly between ``low`` and ``high``, ``below`` of them before it."""

    rank: int
    size: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def at(self) -> int:
        return self.rank - self.below

    def proposal(self, grid: Sequence[float] | None) -> tuple[float, float]:
        """Two values around the rank. A sketch leaves NaN out, so without a grid only NaN, the largest value, is left."""
        if grid is None:
            return math.nan, math.nan
        share, last = self.at / self.size, len(grid) - 1
        low, high = math.floor((share - SLACK) * last), math.ceil((share + SLACK) * last)
        return grid[min(max(low, 0), last)], grid[min(max(high, 0), last)]

    def narrow(self, a: float, b: float, under: int, at_a: int, between: int, at_b: int) -> None:
        """Move to the part of the interval that holds the rank."""
        steps = [(under, None, self.low, a), (at_a, a, None, None), (between, None, a, b), (at_b, b, None, None)]
        steps.append((self.size - under - at_a - between - at_b, None, b, self.high))
        for rows, value, low, high in steps:
            if self.at < rows:
                self.value, self.low, self.high, self.size = value, low, high, rows
                return
            self.below += rows


def _with_numbers(rows: DataFrame, numbers: dict[object, dict[str, list]], by: str | None) -> DataFrame:
    """Adds the arrays of each row's group. They travel as one row per group, broadcast while they are small."""
    names = list(next(iter(numbers.values())))
    if by is None:
        only = next(iter(numbers.values()))
        return rows.withColumns({n: F.array(*[F.lit(v).cast("double") for v in only[n]]) for n in names})
    schema = T.StructType([T.StructField("_key", rows.schema["_group"].dataType)] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
    small = rows.sparkSession.createDataFrame([(key, *[[None if v is None else float(v) for v in found[n]] for n in names]) for key, found in numbers.items()], schema)
    if 8 * sum(len(v) for found in numbers.values() for v in found.values()) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return rows.join(small, F.col("_group").eqNullSafe(F.col("_key"))).drop("_key")


def _inside(column: int, target: int) -> Column:
    """The value where it lies in the open interval of the target."""
    v, low, high = F.col(f"_v{column}"), F.get("_low", F.lit(target)), F.get("_high", F.lit(target))
    return F.when(v.isNotNull() & (low.isNull() | (v > low)) & (high.isNull() | (v < high)), v)


def _grid(value: Column) -> Column:
    """Values at evenly spaced ranks from a mergeable sketch; null when there are none."""
    sketch = F.kll_sketch_agg_double(value, SKETCH_K)
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def _pinned_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: str | None, bracket_rows: int) -> dict[object, dict[str, list[float | None]]]:
    group = F.lit(None) if by is None else F.col(by)
    rows = df.select(group.alias("_group"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    keys = [] if by is None else ["_group"]

    def per_group(frame: DataFrame, aggregates: list[Column]) -> dict[object, tuple]:
        named = [a.alias(f"a{i}") for i, a in enumerate(aggregates)]
        return {r[0] if by else None: tuple(r)[len(keys):] for r in frame.groupBy(*keys).agg(*named).collect()}

    first = per_group(rows, [F.count(f"_v{i}") for i in range(len(columns))] + [_grid(F.col(f"_v{i}")) for i in range(len(columns))])
    # Every group has the same list of targets: per column and prob the rank below and the rank above.
    places = [(i, p, above) for i in range(len(columns)) for p in probs for above in (0, 1)]
    targets: dict[object, list[_Target]] = {}
    for key, found in first.items():
        targets[key] = [
            _Target(min(int(p * (found[i] - 1)) + above, found[i] - 1), found[i]) if found[i] else _Target(0, 0, value=math.nan)
            for i, p, above in places
        ]

    def wide(t: _Target) -> bool:
        return t.value is None and t.size > bracket_rows

    def numbers(keep: Callable[[_Target], bool], **more: Callable[[object, int], float | None]) -> dict[object, dict[str, list]]:
        return {
            key: {"_low": [t.low for t in found], "_high": [t.high for t in found], **{n: [f(key, j) for j in range(len(found))] for n, f in more.items()}}
            for key, found in targets.items() if any(map(keep, found))
        }

    grids = {key: [found[len(columns) + i] for i, _, _ in places] for key, found in first.items()}
    while any(wide(t) for found in targets.values() for t in found):
        asked = sorted({j for found in targets.values() for j, t in enumerate(found) if wide(t)})
        if grids is None:
            state = _with_numbers(rows, numbers(wide), by)
            got = per_group(state, [_grid(_inside(places[j][0], j)) for j in asked])
            grids = {key: dict(zip(asked, found)) for key, found in got.items()}
        cuts = {key: {j: found[j].proposal(grids[key][j]) for j in asked if wide(found[j])} for key, found in targets.items()}
        state = _with_numbers(rows, numbers(
            wide, _a=lambda key, j: cuts[key].get(j, (None, None))[0], _b=lambda key, j: cuts[key].get(j, (None, None))[1]), by)
        tests = []
        for j in asked:
            v, a, b = _inside(places[j][0], j), F.get("_a", F.lit(j)), F.get("_b", F.lit(j))
            tests += [v < a, v == a, (v > a) & (v < b), (v == b) & (a != b)]
        counted = per_group(state, [F.count(F.when(test, 1)) for test in tests])
        for key, found in counted.items():
            for n, j in enumerate(asked):
                if j in cuts[key]:
                    targets[key][j].narrow(*cuts[key][j], *found[4 * n:4 * n + 4])
        grids = None

    open_ = sorted({j for found in targets.values() for j, t in enumerate(found) if t.value is None})
    if open_:
        state = _with_numbers(rows, numbers(lambda t: t.value is None, _at=lambda key, j: None if targets[key][j].value is not None else targets[key][j].at), by)
        picked = per_group(state, [
            F.get(F.array_sort(F.collect_list(F.when(F.get("_at", F.lit(j)).isNotNull(), _inside(places[j][0], j)))), F.first(F.get("_at", F.lit(j))).cast("int")) for j in open_
        ])
        for key, found in picked.items():
            for value, j in zip(found, open_):
                if targets[key][j].value is None:
                    targets[key][j].value = value

    out: dict[object, dict[str, list[float | None]]] = {}
    for key, found in targets.items():
        out[key] = {c: [] for c in columns}
        for (i, p, _), below, above in zip(places[::2], found[::2], found[1::2]):
            n = first[key][i]
            position = p * (n - 1)
            share = position - int(position)
            out[key][columns[i]].append(None if not n else below.value if not share or below.value == above.value else below.value + (above.value - below.value) * share)
    return out


def fill_literals(columns: Mapping[str, float | None]) -> dict[str, Column]:
    """``coalesce(column, number)`` per column."""
    return {
        c: (F.coalesce(F.col(c).cast("double"), F.lit(float(v))) if v is not None else F.col(c))
        for c, v in columns.items()
    }
