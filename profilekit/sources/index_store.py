"""Versioned index tables: vectors with metadata, a manifest per version, numbered commits that name the current one."""

from __future__ import annotations

import json
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit.config import check_manifest
from profilekit.functions.vector import as_double, unit
from profilekit.operators.retrieval import capture_baseline, compare_baseline, gate
from profilekit.sources.steps import create_file, file_names, move_path, path_exists, remove_path

MANIFEST_SCHEMA = "version string, feature_names array<string>, n_vectors bigint, dimension int, built_at timestamp"


def fingerprint(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """12 hex digits over all ids and vectors, the same whatever the row order or partitioning."""
    rounded = F.transform(F.col(vector), lambda x: F.round(x, 6))
    row = F.xxhash64(F.col(id_col).cast("string"), F.to_json(rounded)).cast("decimal(38,0)")
    return df.agg(F.sum(row).alias("s"), F.count(F.lit(1)).alias("n")).select(
        F.substring(F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string")), 256), 1, 12).alias("version")
    )


def index_rows(df: DataFrame, id_col: str, vector: str, metadata: Sequence[Column] = ()) -> DataFrame:
    """Unit vectors with their metadata."""
    return df.select(F.col(id_col).alias("id"), unit(as_double(F.col(vector))).alias("vector"), *metadata)


def content_version(rows: DataFrame, features: Sequence[str]) -> str:
    """12 hex digits over every column of every row and the feature names, the same whatever the row order."""
    shown = [F.transform("vector", lambda x: F.round(x, 6)).alias(c) if c == "vector" else F.col(c) for c in sorted(rows.columns)]
    row = F.xxhash64(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    names = F.lit(json.dumps([*sorted(rows.columns), "", *features]))
    return rows.agg(F.sum(row).alias("s"), F.count(F.lit(1)).alias("n")).select(
        F.substring(F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string"), names), 256), 1, 12)
    ).first()[0]


def build_index(rows: DataFrame, folder: str, features: Sequence[str]) -> str:
    """Write a new version and its manifest; returns the version. Nothing that exists is touched.

    Rows are written aside first, so the version is the hash of what was written, and ``rows`` may come from the
    index itself. A version that is already there, complete, stays as it is.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    aside = f"{folder}/aside/{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    written = spark.read.parquet(aside)
    version = content_version(written, features)
    path, manifest_path = f"{folder}/entities/version={version}", f"{folder}/manifest/version={version}"
    if path_exists(spark, f"{path}/_SUCCESS"):
        remove_path(spark, aside)
    else:
        move_path(spark, aside, path)
    if not path_exists(spark, f"{manifest_path}/_SUCCESS"):
        n = spark.read.parquet(path).count()
        manifest = spark.createDataFrame([(version, list(features), n, len(features))], "version string, feature_names array<string>, n_vectors bigint, dimension int")
        manifest.withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(manifest_path)
    return version


def read_manifest(spark: SparkSession, folder: str, version: str) -> dict[str, object]:
    row = spark.read.schema(MANIFEST_SCHEMA).json(f"{folder.rstrip('/')}/manifest/version={version}").first()
    manifest = row.asDict() if row else {}
    check_manifest(manifest)
    return manifest


def read_index(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """One version; the filter on the partition column keeps other versions unread."""
    wanted = version or current_version(spark, folder)
    if wanted is None:
        raise ValueError("the index has no current version")
    return spark.read.parquet(f"{folder.rstrip('/')}/entities/version={wanted}")


def current_commit(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and version of the latest publication; (0, None) before the first."""
    names = [n for n in file_names(spark, f"{folder.rstrip('/')}/commits") if n.endswith(".json")]
    if not names:
        return 0, None
    record = json.loads(spark.read.text(f"{folder.rstrip('/')}/commits/{names[-1]}", wholetext=True).first()[0])
    return int(names[-1].removesuffix(".json")), record["version"]


def current_version(spark: SparkSession, folder: str) -> str | None:
    return current_commit(spark, folder)[1]


def promote(spark: SparkSession, folder: str, version: str, after: int | None = None) -> bool:
    """Publish a version as commit ``after + 1``; False when another publication has that number already.

    Commits are small numbered files that are never changed, and the highest one counts: a reader sees the version before
    or the one after, never none. Without ``after`` the version is published behind whatever is current.
    """
    while True:
        base = current_commit(spark, folder)[0] if after is None else after
        record = json.dumps({"version": version, "after": base})
        if create_file(spark, f"{folder.rstrip('/')}/commits/{base + 1:012d}.json", record):
            return True
        if after is not None:
            return False


def rebuild(rows: DataFrame, folder: str, features: Sequence[str], searcher, k: int = 10) -> dict[str, object]:
    """Build a version and promote it only when its answers stay close to the current version's.

    ``searcher`` maps an index to results ``(query_id, item_id, rank)`` of the canonical queries. When another version is
    published meanwhile, the gate is asked again against that one, so no version is promoted over one it was not compared with.
    """
    spark = rows.sparkSession
    number, before = current_commit(spark, folder)
    version = build_index(rows, folder, features)
    while True:
        result = {"version": version, "promoted": True, "mean_jaccard": None, "n_alerts": 0}
        if before is not None:
            old, new = (capture_baseline(searcher(read_index(spark, folder, v)), k) for v in (before, version))
            verdict = gate(compare_baseline(old, new)).first()
            result |= {"promoted": verdict["passed"], "mean_jaccard": verdict["mean_jaccard"], "n_alerts": verdict["n_alerts"]}
        if not result["promoted"] or promote(spark, folder, version, number):
            return result
        number, before = current_commit(spark, folder)


def index_info(rows: DataFrame) -> DataFrame:
    """Rows, dimension and the size estimate 4 bytes per number plus 32 links of 8 bytes per row."""
    return rows.agg(F.count(F.lit(1)).alias("vector_count"), F.max(F.size("vector")).cast("long").alias("dimension")).withColumn(
        "memory_bytes", F.col("vector_count") * F.col("dimension") * 4 + F.col("vector_count") * 32 * 8
    )


def unanswered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests whose key has no stored answer yet."""
    return requests.join(answers.select("request_key").distinct(), "request_key", "left_anti")


def answer_requests(requests: DataFrame, path: str, compute) -> DataFrame:
    """Stored answers plus newly computed ones; new answers are appended to the table.

    ``requests`` carry ``request_key``, which includes the index version. ``compute`` maps
    requests to answers with their key. The table has one row per request with all of its
    answers, also where there are none, so nothing is computed twice.
    """
    spark = requests.sparkSession
    asked = requests.dropDuplicates(["request_key"])
    missing = unanswered(asked, spark.read.parquet(path)) if path_exists(spark, path) else asked
    found = compute(missing)
    lists = found.groupBy("request_key").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "request_key"])).alias("answers"))
    rows = missing.select("request_key").join(lists, "request_key", "left")
    rows.withColumn("answers", F.coalesce("answers", F.array().cast(lists.schema["answers"].dataType))).write.mode("append").parquet(path)
    stored = spark.read.parquet(path).join(requests.select("request_key").distinct(), "request_key", "left_semi")
    return stored.select("request_key", F.explode("answers").alias("answer")).select("request_key", "answer.*")
