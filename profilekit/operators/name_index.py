"""A stored name table for prefix and substring lookups.

* ``names``: every entity, sorted by lower-case name in key ranges. A prefix is a range of keys, so the file and row-group
  statistics leave only the pieces that overlap it.
* ``grams``: distinct names under each of their three-character pieces, partitioned by a hash of the piece. A lookup reads the
  pieces of the text, takes the rarest, and compares only the names under that one with the text.

Names that many entities share stand once under a piece; the entities come back from ``names`` by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit.functions.scalar import contains_text, starts_with_text
from profilekit.operators.relational import top_per_group
from profilekit.session import materialise
from profilekit.sources.steps import path_exists

GRAM = 3
#: Rows of a name file, on average; the number of ranges follows from it.
ROWS_PER_RANGE = 1_000_000


@dataclass(frozen=True)
class NameIndex:
    names: DataFrame
    grams: DataFrame
    buckets: int


def name_key(name: Column | str) -> Column:
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build_names(entities: DataFrame, folder: str, buckets: int = 64, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Writes ``(id, name)``; rows without a name are left out, names shorter than a piece have no pieces.

    Nothing is sorted as a whole: Spark samples range limits, and a name that very many entities share is spread over
    ranges by its ids.
    """
    folder = folder.rstrip("/")
    known = materialise(entities.select("id", "name", name_key("name").alias("key")).filter("key IS NOT NULL"))
    ranges = max(1, -(-known.count() // rows_per_range))
    known.repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id").write.parquet(f"{folder}/names")
    places = F.sequence(F.lit(1), F.length("key") - (GRAM - 1))
    pieces = (
        known.select("key").distinct().filter(F.length("key") >= GRAM)
        .select("key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("key", i, F.lit(GRAM))))).alias("gram"))
        .withColumn("bucket", _bucket(F.col("gram"), buckets))
    )
    # by gram and key, so a piece that a third of all names hold is several tasks
    spread = pieces.repartitionByRange(ranges * 4, "bucket", "gram", "key").sortWithinPartitions("bucket", "gram", "key")
    spread.write.partitionBy("bucket").parquet(f"{folder}/grams")


def open_names(spark: SparkSession, folder: str, buckets: int = 64) -> NameIndex:
    folder = folder.rstrip("/")
    names = spark.read.parquet(f"{folder}/names")
    nothing = "key string, gram string, bucket int"
    # a table of short names only has no pieces and thus no folders to learn a schema from
    grams = spark.read.schema(nothing).parquet(f"{folder}/grams") if path_exists(spark, f"{folder}/grams") else spark.createDataFrame([], nothing)
    return NameIndex(names, grams, buckets)


def with_prefix(index: NameIndex, text: str) -> DataFrame:
    """Entities whose name starts with the text."""
    low = text.strip().lower()
    # no name that starts with the text sorts behind the text and the largest character
    inside = F.col("key").between(F.lit(low), F.lit(low + "\U0010ffff" * 8))
    return index.names.filter(inside & starts_with_text(F.col("key"), F.lit(low)))


def containing(index: NameIndex, text: str) -> DataFrame:
    """Entities whose name contains the text. Texts shorter than a piece have no entry, so all names are compared."""
    low = text.strip().lower()
    if len(low) < GRAM:
        return index.names.filter(contains_text(F.col("key"), F.lit(low)))
    grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    places = index.grams.sparkSession.createDataFrame([(g,) for g in grams], "gram string")
    numbers = {r.gram: r.b for r in places.select("gram", _bucket(F.col("gram"), index.buckets).alias("b")).collect()}

    def listed(wanted: list[str]) -> DataFrame:
        return index.grams.filter(F.col("bucket").isin(sorted({numbers[g] for g in wanted})) & F.col("gram").isin(wanted))

    sizes = {r.gram: r["count"] for r in listed(grams).groupBy("gram").count().collect()}
    if len(sizes) < len(grams):  # a piece that no name has
        return index.names.limit(0)
    rarest = min(grams, key=lambda g: (sizes[g], g))
    keys = listed([rarest]).filter(contains_text(F.col("key"), F.lit(low))).select("key")
    return index.names.join(keys, "key", "left_semi").select(index.names.columns)


def suggest_stored(index: NameIndex, query: str, limit: int = 10) -> DataFrame:
    """Names that start with the query, in name order; only when there are none, names that contain it."""
    if not query.strip():
        return index.names.select("id", "name", F.lit(0).alias("rank")).limit(0)
    for found in (with_prefix, containing):
        best = materialise(found(index, query).orderBy("key", "id").limit(limit))
        if not best.isEmpty():
            break
    return top_per_group(best.withColumn("_all", F.lit(1)), ["_all"], [F.col("key"), F.col("id")], limit).select("id", "name", "rank")
