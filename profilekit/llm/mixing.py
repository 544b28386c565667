"""Mixing sources to target weights: budgets down a domain - language - source tree, then seeded token prefixes.

1. Tokens of every leaf are summed (pre-aggregated per task).
2. The token budget goes down the tree by weight. What a leaf cannot take (its tokens times ``max_epochs``) goes to
   its siblings by weight, and only what all of them cannot take goes to the siblings of their parent, and so on.
3. A leaf takes whole epochs of its documents as long as its budget lasts, and of the last epoch the documents,
   in the order of a seeded hash, that start before the budget ends. So a leaf overshoots by less than one document.

The last document of a prefix is found by refining hash ranges: sums per leaf and 1,024 ranges, then only the
range in which the budget ends, until it holds few documents. No leaf is ever sorted or gathered, however
large; the cuts are one row per leaf (their number is checked), so choosing documents is a filter in the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.llm.common import BLANK_CLASS
from profilekit.session import materialise

LEVELS = ("domain", "lang", "source")
RANGE_BITS = 10
#: A hash range with at most so many rows is summed exactly, document by document.
FEW_ROWS = 4_096
MAX_LEAVES = 100_000


@dataclass(frozen=True)
class MixParams:
    """Weights by level and name (1 where none is given), the budget as a share of all tokens, and the seed."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    budget_share: float = 1.0
    max_epochs: int = 4
    seed: int = 17


def word_count(text: str | Column = "text") -> Column:
    """Words: what white space separates."""
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")).cast("long")


def source_group(source: str = "source", groups: int = 4) -> Column:
    """A domain for tables that have none: sources by the number in their name."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number == "", F.lit("group")).otherwise(F.concat(F.lit("group"), (number.cast("long") % groups).cast("string")))


def share_out(total: int, weights: list[Fraction], limits: list[int]) -> list[int]:
    """Whole-number shares of ``total`` by weight, none above its limit; what one cannot take goes to the others by weight.

    What rounding leaves over goes one by one to the first that can take it. Children of weight 0 get something only
    when the others are full. The shares sum to ``min(total, sum(limits))``.
    """
    shares = [0] * len(limits)
    for group in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        left = min(total - sum(shares), sum(limits[i] for i in group))
        open_, fixed = list(group), 0
        while open_:
            whole = sum((weights[i] if weights[i] > 0 else Fraction(1)) for i in open_)
            wanted = {i: (left - fixed) * (weights[i] if weights[i] > 0 else Fraction(1)) / whole for i in open_}
            full = [i for i in open_ if wanted[i] >= limits[i]]
            if not full:
                for i in open_:
                    shares[i] = int(wanted[i])
                break
            for i in full:
                shares[i] = limits[i]
                fixed += limits[i]
            open_ = [i for i in open_ if i not in set(full)]
        rest = left - sum(shares[i] for i in group)
        while rest > 0:  # less than one each
            for i in group:
                extra = min(rest, limits[i] - shares[i], 1)
                shares[i] += extra
                rest -= extra
    return shares


def budgets(leaves: Mapping[tuple, int], total: int, weight_of: Callable[[int, tuple], Fraction], max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf (a path of names, one per level), from its supply."""
    def down(paths: list[tuple], level: int, amount: int) -> dict[tuple, int]:
        if level == len(paths[0]):
            return {paths[0]: amount}
        children: dict[str, list[tuple]] = {}
        for path in paths:
            children.setdefault(path[level], []).append(path)
        names = sorted(children)
        limits = [sum(leaves[p] * max_epochs for p in children[n]) for n in names]
        shares = share_out(amount, [weight_of(level, children[n][0][:level + 1]) for n in names], limits)
        out: dict[tuple, int] = {}
        for name, share in zip(names, shares):
            out |= down(children[name], level + 1, share)
        return out

    return down(sorted(leaves), 0, total) if leaves else {}


def _keyed(df: DataFrame, domain: Column, id_col: str, text_col: str) -> DataFrame:
    """Adds what the choice needs, under names that tables do not have."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.withColumns({
        "_domain": name(domain), "_lang": name(F.col("lang")), "_source": name(F.col("source")),
        "_id": F.col(id_col).cast("long"), "_tokens": word_count(text_col),
    })


_KEYS = ["_domain", "_lang", "_source"]


def _order(seed: int) -> Column:
    """Place of a document in an epoch: a hash of seed, epoch and id, as a number from 0 to 2**60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_epochs"), F.coalesce("_id", F.lit(-1)), F.col("_id").isNull()), 4)


def _cuts(light: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    """plan plus, per leaf, the last (hash, id) that its last epoch takes; null where that epoch takes nothing."""
    rows = materialise(
        light.join(F.broadcast(plan), _KEYS).where("_rest > 0").withColumn("_h", _order(params.seed))
        .groupBy(*_KEYS, "_h", "_id").agg(F.sum("_tokens").alias("_tokens")))
    # Budget still to fill inside the range of each leaf; the range is the first bits of the hash.
    inside = plan.where("_rest > 0").select(*_KEYS, F.col("_rest").alias("_need"))
    bits = 0
    while True:
        largest = rows.groupBy(*_KEYS).count().agg(F.max("count").alias("n")).first()["n"] or 0
        if largest <= FEW_ROWS or bits >= 60:
            break
        bits += RANGE_BITS
        part = F.shiftrightunsigned("_h", 60 - bits)
        sums = rows.groupBy(*_KEYS, part.alias("_part")).agg(F.sum("_tokens").alias("_sum"))
        upto = Window.partitionBy(*_KEYS).orderBy("_part")
        ends = (
            sums.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")).join(F.broadcast(inside), _KEYS)
            .where(F.col("_before") < F.col("_need"))
            .groupBy(*_KEYS).agg(F.max("_part").alias("_part"), F.max_by("_before", "_part").alias("_before"), F.max("_need").alias("_need"))
        )
        ends = materialise(ends.select(*_KEYS, "_part", (F.col("_need") - F.col("_before")).alias("_need")))
        rows = materialise(rows.withColumn("_part", part).join(F.broadcast(ends.select(*_KEYS, "_part")), [*_KEYS, "_part"]).drop("_part"))
        inside = ends.select(*_KEYS, "_need")
    upto = Window.partitionBy(*_KEYS).orderBy("_h", "_id")
    last = (
        rows.withColumn("_before", F.sum("_tokens").over(upto) - F.col("_tokens")).join(F.broadcast(inside), _KEYS)
        .where(F.col("_before") < F.col("_need")).groupBy(*_KEYS)
        .agg(F.max(F.struct("_h", "_id")).alias("_last"))
    )
    return materialise(plan.join(last, _KEYS, "left"))


def mix(df: DataFrame, params: MixParams = MixParams(), domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen rows of ``df``, all columns, plus ``mix_domain``, ``mix_tokens`` and ``mix_epoch``; a row is repeated once per epoch that takes it.

    Defined cases: null domains, languages and sources are the empty name; null and empty texts have no tokens, and a leaf
    without tokens gives no rows; rows that share an id within a leaf are taken together; columns of the
    table keep their names and values, also where they look like those of this module; an empty
    table gives an empty table. More than MAX_LEAVES leaves are refused before anything is chosen.
    """
    spark = df.sparkSession
    keyed = _keyed(df, source_group() if domain is None else domain, id_col, text_col)
    light = materialise(keyed.select(*_KEYS, "_id", "_tokens"))
    supply = light.groupBy(*_KEYS).agg(F.sum("_tokens").alias("n")).where("n > 0").limit(MAX_LEAVES + 1).collect()
    if len(supply) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    leaves = {tuple(r[k] for k in _KEYS): r["n"] for r in supply}

    def weight_of(level: int, path: tuple) -> Fraction:
        return Fraction(params.weights.get(LEVELS[level], {}).get(path[-1], 1))

    total = int(Fraction(params.budget_share) * sum(leaves.values()))
    given = budgets(leaves, total, weight_of, params.max_epochs)
    plan = spark.createDataFrame(
        [(*path, given[path] // leaves[path], given[path] % leaves[path]) for path in sorted(leaves)] or [("", "", "", 0, 0)],
        "_domain string, _lang string, _source string, _epochs long, _rest long")
    cuts = _cuts(light, plan, params)
    h, last = _order(params.seed), F.col("_last")
    again = (h < last["_h"]) | ((h == last["_h"]) & (last["_id"].isNotNull() | F.col("_id").isNull())
                                & (F.coalesce("_id", F.lit(-(1 << 63))) <= F.coalesce(last["_id"], F.lit(-(1 << 63)))))
    times = F.col("_epochs") + F.when(F.coalesce(again, F.lit(False)), 1).otherwise(0)
    chosen = keyed.join(F.broadcast(cuts), _KEYS).withColumn("_times", times).where("_times > 0")
    return chosen.select(
        *df.columns, F.col("_domain").alias("mix_domain"), F.col("_tokens").alias("mix_tokens"),
        F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))).alias("mix_epoch"))
