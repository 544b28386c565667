"""Exact duplicates by counting quotient filters.

Every row's normalised text gets a 64-bit fingerprint. A partition stores its fingerprints
in counting quotient filters: the high bits (the quotient) name a slot, the remainders of a
slot are kept sorted, each with its count. Such filters merge without loss by merging sorted
remainders and adding counts. The filters are cut into ranges of quotients; a range is
what one task merges, and the number of ranges follows the number of rows, so a range
stays small, while a text that fills a third of the table is one remainder per partition.

A fingerprint with a merged count of one needs no more work. Rows of the others go to
byte verification: they are grouped by the whole normalised text, compared byte for byte and
pre-aggregated in each task, so that copies are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import BLANK_CLASS, arrow_schema, id_and_text
from profilekit.session import materialise

#: Fingerprints in one range of quotients, on average.
RANGE_ENTRIES = 1 << 16
#: Spark's hash seed gives the first half; nothing here depends on its value.
_FILTER_DDL = "slot int, remainders binary, counts binary"


def normalise(text):
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, BLANK_CLASS + "+", " ")


def quotient_bits(rows: int) -> int:
    """Bits of the quotient that name a range: ranges of RANGE_ENTRIES, one at least."""
    return max(0, int(np.ceil(np.log2(max(1, rows) / RANGE_ENTRIES))))


def filter_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and their counts: the filter's runs, slot after slot."""
    values, counts = np.unique(fingerprints.astype(np.uint64, copy=False), return_counts=True)
    return values, counts.astype(np.int64)


def merge_filters(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge filters by sorted remainders; counts of equal remainders add up, nothing is lost."""
    if not sum(len(p[0]) for p in parts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[first], np.add.reduceat(counts, first)


def cut_by_quotient(values: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(quotient, remainders, counts) of each range that holds something."""
    slots = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    keep = np.uint64((1 << (64 - bits)) - 1)
    starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else []
    for start, stop in zip(starts, [*starts[1:], len(slots)]):
        yield int(slots[start]), values[start:stop] & keep, counts[start:stop]


def partition_filters(fingerprints: DataFrame, bits: int) -> DataFrame:
    """One filter per partition of ``fingerprints`` (a long column), cut into ranges."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            whole.append(filter_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(whole) >= 16:
                whole = [merge_filters(whole)]
        values, counts = merge_filters(whole)
        rows = list(cut_by_quotient(values, counts, bits))
        schema = arrow_schema(_FILTER_DDL)
        for start in range(0, len(rows), 64):
            part = rows[start:start + 64]
            yield pa.RecordBatch.from_pydict(
                {"slot": [r[0] for r in part], "remainders": [r[1].tobytes() for r in part], "counts": [r[2].tobytes() for r in part]},
                schema=schema)

    return fingerprints.mapInArrow(build, _FILTER_DDL)


def merged_filter(filters: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """(fingerprint, n): the merged filter's entries with a count of ``least`` or more."""

    def merge(frame):
        import pandas as pd

        slot = np.uint64(int(frame["slot"].iat[0]))
        values, counts = merge_filters([
            (np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64)) for r, c in zip(frame["remainders"], frame["counts"])
        ])
        high = slot << np.uint64(64 - bits) if bits else np.uint64(0)
        often = counts >= least
        return pd.DataFrame({"fingerprint": (values[often] | high).view(np.int64), "n": counts[often]})

    return filters.groupBy("slot").applyInPandas(merge, "fingerprint long, n long")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Defined cases: null texts count as empty, and empty texts equal each other; the row
    with the smallest doc_id of a group stays; rows that share that doc_id and text are
    all marked kept (they cannot be told apart); a null doc_id stays only in a group without other
    ids; other columns are ignored; an empty table gives an empty table.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("text", normalise(F.col("text")))
    rows = rows.withColumn("fingerprint", F.xxhash64("text"))
    light = materialise(rows.select("doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256")))
    bits = quotient_bits(light.count())
    often = materialise(merged_filter(partition_filters(light.select("fingerprint"), bits), bits, 2).select("fingerprint"))
    # The whole text is the grouping key, so equal means equal bytes.
    verified = materialise(
        rows.join(often, "fingerprint", "left_semi")
        .groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return light.join(verified, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one per group of equal texts.

    Of repeated rows, which share the smallest id and the text, one stays; which of them is open where other columns differ.
    """
    kept = materialise(
        exact_groups(df, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumnsRenamed({"doc_id": "_kept_id", "text_sha256": "_kept_text"}))
    text = F.sha2(normalise(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    marked = df.withColumn("_own_text", text)
    same = (F.col("_own_text") == F.col("_kept_text")) & F.col(id_col).eqNullSafe(F.col("_kept_id"))
    several = kept.where("_rows > 1")
    if several.isEmpty():
        return marked.join(kept, same, "left_semi").select(*df.columns)
    single = marked.join(kept.where("_rows = 1"), same, "left_semi")
    repeated = marked.join(several, same, "left_semi").dropDuplicates([id_col, "_own_text"])
    return single.unionByName(repeated).select(*df.columns)
