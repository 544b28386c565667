"""Fact tables, dimensions, exports and baselines."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.config import ProfileConfig, TableSpec
from profilekit.functions.scalar import text_flag
from profilekit.operators.merge import cast_period
from profilekit.operators.profile import nan_to_null
from profilekit.operators.relational import first_per_key

BASELINE_SCHEMA = "query_id string, ids array<string>"
BAD_RECORD, BAD_FILE = "_bad_record", "_bad_file"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, or of the files of a folder, which must agree."""
    return spark.read.option("header", True).csv(path).columns


def declared_schema(columns: Sequence[str], spec: TableSpec) -> T.StructType:
    """The types that ``spec`` declares, in the order of the file."""
    return T.StructType([T.StructField(c, T.StructType.fromDDL(f"x {spec.types.get(c, spec.other)}")[0].dataType) for c in columns])


def _csv(spark: SparkSession, path: str, schema: T.StructType, missing: str) -> DataFrame:
    """Typed rows; one that does not fit keeps its text in the last column, with the file it stands in."""
    with_text = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("nullValue", missing).option("mode", "PERMISSIVE")
    # a header that does not name the declared columns in their places is an error, not shifted numbers
    reader = reader.option("enforceSchema", False).option("columnNameOfCorruptRecord", BAD_RECORD)
    rows = reader.schema(with_text).csv(path).withColumn(BAD_FILE, F.col("_metadata.file_path"))
    # A scan only converts columns that are asked for, so what fits would depend on the query. The condition, true for
    # every row, asks for all of them.
    return rows.filter(F.hash(*schema.names) >= F.lit(-(1 << 31)))


def _path(folder: str, spec: TableSpec) -> str:
    return f"{folder.rstrip('/')}/{spec.file}"


def _schema(spark: SparkSession, folder: str, spec: TableSpec, schema: T.StructType | str | None) -> T.StructType:
    if schema is None:
        return declared_schema(header_of(spark, _path(folder, spec)), spec)
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_table(spark: SparkSession, folder: str, spec: TableSpec, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV or Parquet by file name. A CSV has the types that ``spec`` declares, unless a schema is given: no pass to guess them.

    Rows of a CSV that do not fit are left out here and returned by :func:`bad_rows`.
    """
    if spec.file.endswith(".parquet"):
        return nan_to_null(spark.read.parquet(_path(folder, spec)))
    rows = _csv(spark, _path(folder, spec), _schema(spark, folder, spec, schema), spec.missing)
    return nan_to_null(rows.filter(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD, BAD_FILE))


def bad_rows(spark: SparkSession, folder: str, specs: Sequence[TableSpec], schemas: Mapping[str, object] | None = None) -> DataFrame:
    """``(table_name, file, record)`` of all CSV rows that do not fit: unreadable values, too few or too many fields."""
    parts = [
        _csv(spark, _path(folder, spec), _schema(spark, folder, spec, (schemas or {}).get(spec.name)), spec.missing)
        .filter(F.col(BAD_RECORD).isNotNull())
        .select(F.lit(spec.name).alias("table_name"), F.col(BAD_FILE).alias("file"), F.col(BAD_RECORD).alias("record"))
        for spec in specs if not spec.file.endswith(".parquet")
    ]
    empty = spark.createDataFrame([], "table_name string, file string, record string")
    return reduce(DataFrame.unionByName, parts, empty)


def bad_row_counts(bad: DataFrame) -> DataFrame:
    """Bad rows per table and file."""
    return bad.groupBy("table_name", "file").agg(F.count(F.lit(1)).alias("n_bad"))


def read_facts(spark: SparkSession, folder: str, cfg: ProfileConfig, schemas: Mapping[str, object] | None = None) -> list[DataFrame]:
    """All fact tables: period as int, columns renamed, table order kept."""
    out = []
    for spec in cfg.fact_tables:
        df = read_table(spark, folder, spec, (schemas or {}).get(spec.name))
        df = df.withColumnsRenamed(dict(spec.rename))
        out.append(cast_period(df, cfg.period) if cfg.period in df.columns else df)
    return out


def read_dimension(spark: SparkSession, folder: str, cfg: ProfileConfig, schema: object = None) -> DataFrame:
    wanted = [cfg.entity, *cfg.dimension_measures, *([cfg.flag] if cfg.flag else [])]
    return read_table(spark, folder, cfg.dimension, schema).select(*wanted)


def read_points(spark: SparkSession, path: str | list[str], columns: Mapping[str, str], key: str, optional: Mapping[str, str] | None = None) -> DataFrame:
    """Tolerant typed CSV read: rows that fail a cast are left out, the last row per key wins.

    ``columns`` maps names to ``string, int, whole, double`` or ``flag``; ``whole`` also reads
    numbers written with a fraction. ``optional`` columns take their default when empty.
    "Last" means files in path order, then the order within the file.
    """
    raw = spark.read.option("header", True).csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    raw = raw.withColumn("_at", place)
    kinds = {
        "string": lambda c: F.col(c),
        "int": lambda c: F.expr(f"try_cast(trim(`{c}`) as int)"),
        "whole": lambda c: F.expr(f"try_cast(try_cast(trim(`{c}`) as double) as int)"),
        "double": lambda c: F.expr(f"try_cast(trim(`{c}`) as double)"),
        "flag": lambda c: text_flag(F.col(c)),
    }
    typed = raw.select("_at", *[kinds[k](c).alias(c) for c, k in columns.items()], *[
        F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c) for c, v in (optional or {}).items()
    ])
    return first_per_key(typed.dropna(subset=list(columns)), [key], [F.col("_at").desc()]).drop("_at")


def write_points(df: DataFrame, path: str, pca: str = "pca", first: int = 5, fmt: str = "csv") -> None:
    """Entities with labels, map position and the first components; list columns are left out."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    parts = [F.get(F.col(pca), F.lit(i)).alias(f"pca_{i + 1}") for i in range(first)] if pca in df.columns else []
    out = df.select(*flat, *parts)
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_nested(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_edges(edges: DataFrame, path: str, buckets: int = 64) -> None:
    """Similarity edges, partitioned by a bucket of the source so one entity's edges are one folder away."""
    bucketed = edges.withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(buckets)).cast("int"))
    bucketed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_edges(spark: SparkSession, path: str, sources: Sequence[object] | None = None, buckets: int = 64) -> DataFrame:
    """All edges, or those of a few sources with partition pruning."""
    df = spark.read.parquet(path)
    if sources is None:
        return df
    kind = df.schema["src"].dataType
    wanted = [F.pmod(F.xxhash64(F.lit(s).cast(kind)), F.lit(buckets)) for s in sources]
    numbers = list(spark.range(1).select(*[w.alias(f"b{i}") for i, w in enumerate(wanted)]).first())
    return df.filter(F.col("bucket").isin(*numbers) & F.col("src").isin(*sources))


def write_baseline(baseline: DataFrame, path: str) -> None:
    baseline.select(F.col("query_id").cast("string"), F.col("ids").cast("array<string>")).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE_SCHEMA).json(path)


def write_links(links: DataFrame, path: str) -> None:
    """Name -> link, one JSON object per line in name order."""
    links.select("name", "url").orderBy("name").write.mode("overwrite").json(path)
