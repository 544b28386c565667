"""URL filters by a trie over reversed host labels and path segments.

A rule is a host and the start of a path. It fits its host and all subdomains, for URLs whose path starts with the
rule's. Of the rules that fit, the longest decides: most characters of host and path together, then the longer
host; where the same host and path are both allowed and blocked, blocked wins. URLs that no rule fits
get the default verdict.

Up to ``max_trie_chars`` characters of rules make one trie, which is broadcast; its size is checked on the
driver before anything is collected whole. A longer list is joined instead: by host, then by host and path start. A few
hosts hold most URLs, so both joins keep hot keys out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema
from profilekit.llm.spread import spread_join
from profilekit.session import materialise

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlFilterParams:
    """The verdict without a rule, and how many characters of rules one broadcast trie may hold."""

    default: str = ALLOW
    max_trie_chars: int = 64_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; path: from there to ``? #`` or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table of rules."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


@dataclass
class PathNode:
    """Whole segments lead on; of the last segment of a rule only the start has to fit."""

    segments: dict[str, "PathNode"] = field(default_factory=dict)
    starts: dict[str, str] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


@dataclass
class HostNode:
    labels: dict[str, "HostNode"] = field(default_factory=dict)
    paths: PathNode | None = None


class UrlTrie:
    """Host labels from the right, then path segments from the left."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()):
        self.root = HostNode()
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, HostNode())
        node.paths = node.paths or PathNode()
        *whole, start = path.split("/")
        at = node.paths
        for segment in whole:
            at = at.segments.setdefault(segment, PathNode())
        if at.starts.get(start) != BLOCK:
            at.starts[start] = verdict
        at.lengths = sorted({*at.lengths, len(start)}, reverse=True)

    def longest(self, host: str, path: str) -> tuple[str, str, str] | None:
        """(verdict, host, path) of the rule that decides, if any fits."""
        best, stop, node = None, len(host), self.root
        while stop >= 0:
            begin = host.rfind(".", 0, stop) + 1
            node = node.labels.get(host[begin:stop])
            if node is None:
                break
            found = _longest_start(node.paths, path) if node.paths else None
            if found:
                size, verdict = found
                rank = (len(host) - begin + size, len(host) - begin)
                if best is None or rank > best[0]:
                    best = rank, (verdict, host[begin:], path[:size])
            stop = begin - 1
        return best[1] if best else None


def _longest_start(node: PathNode, path: str) -> tuple[int, str] | None:
    """(characters, verdict) of the longest start of ``path`` below ``node``."""
    found, begin = None, 0
    while node is not None:
        stop = path.find("/", begin)
        segment = path[begin:stop if stop >= 0 else len(path)]
        for length in node.lengths:
            if length <= len(segment) and segment[:length] in node.starts:
                found = begin + length, node.starts[segment[:length]]
                break
        if stop < 0:
            break
        node, begin = node.segments.get(segment), stop + 1
    return found


_DDL = "row_id long, host string, path string, rule string, verdict string"


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], params: UrlFilterParams) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = shared.value, arrow_schema(_DDL)
        for batch in batches:
            named, verdicts = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = trie.longest(host, path)
                named.append(found[1] + found[2] if found else None)
                verdicts.append(found[0] if found else params.default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(named, pa.string()), pa.array(verdicts, pa.string())], schema=schema)

    return urls.mapInArrow(judge, _DDL)


def _by_join(urls: DataFrame, rules: DataFrame, params: UrlFilterParams) -> DataFrame:
    """The same verdicts for lists of any length: hosts first, then starts of the path at lengths their rules have."""
    rules = materialise(rules.groupBy("host", "path").agg(F.min(F.col("verdict") != BLOCK).alias("open")))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths"))
    places = materialise(urls.select("host", "path").distinct())
    label = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.concat_ws(".", F.slice(label, i, F.size(label))))
    asked = materialise(places.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode(suffix).alias("host")))
    known = spread_join(asked, lengths, ["host"])
    starts = materialise(
        known.select("_host", "_path", "host", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n"))
        .withColumn("path", F.col("_path").substr(F.lit(1), F.col("_n"))).drop("_n"))
    fits = spread_join(starts, rules, ["host", "path"])
    rank = F.struct(F.length("host") + F.length("path"), F.length("host"))
    best = (
        fits.groupBy("_host", "_path")
        .agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "open"), rank).alias("_best"))
        .select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
                F.when(F.col("_best.open"), ALLOW).otherwise(BLOCK).alias("_verdict")))
    judged = spread_join(materialise(urls), best, ["host", "path"], "left")
    return judged.select("row_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(params.default)).alias("verdict"))


def judge_urls(df: DataFrame, rules: DataFrame, params: UrlFilterParams = UrlFilterParams(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``df``: its id, host, path, rule (host and path, null without one) and verdict.

    ``rules`` has verdict (allow or block), host and path. Defined cases: a null URL or one without ``://`` has an empty host and
    path; hosts are compared in lower case, paths as they are; a rule without host fits empty hosts only; null parts of
    rules are empty and null verdicts block; a null id stays null; repeated rows are judged each;
    other columns are ignored; an empty table gives an empty table and no rules the default for all.
    """
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col).cast("long").alias("row_id"), host.alias("host"), path.alias("path"))
    rules = rules.select(
        F.when(F.lower("verdict") == ALLOW, ALLOW).otherwise(BLOCK).alias("verdict"),
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    size = rules.agg(F.sum(F.length("host") + F.length("path") + 8).alias("n")).first()["n"] or 0
    if size <= params.max_trie_chars:
        found = _by_trie(urls, [tuple(r) for r in rules.collect()], params)
    else:
        found = _by_join(urls, rules, params)
    return found.withColumnRenamed("row_id", id_col)
