"""Names, links and their coverage."""

from __future__ import annotations

from typing import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.functions.scalar import allowed_url, replace_part, strip_suffix
from profilekit.functions.text import normalise_name
from profilekit.operators.relational import first_per_key

# Thumbnail and full size in image links, the suffix of image titles.
THUMBNAIL, FULL_SIZE = "260x190", "1040x760"
TITLE_SUFFIX = r"\s+Headshot"
#: Rows and bytes of text that are cut into words at once.
STEP_ROWS, STEP_BYTES = 4_096, 4 << 20


def linked_rows(pages: DataFrame, html: str, pattern: str, name_group: int, link_group: int, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., position, name, url)`` for every element of ``pattern``; rows without name or link are dropped.

    The whole page is searched. Both groups come from the same matches, so they stay paired.
    """
    names = F.regexp_extract_all(html, F.lit(pattern), F.lit(name_group))
    links = F.regexp_extract_all(html, F.lit(pattern), F.lit(link_group))
    rows = pages.select(*keep, F.posexplode(F.arrays_zip(names.alias("n"), links.alias("l"))).alias("position", "e"))
    return rows.select(
        *keep, "position",
        F.trim(strip_suffix(F.trim(F.col("e.n")), TITLE_SUFFIX)).alias("name"), F.trim(F.col("e.l")).alias("url"),
    ).filter((F.col("name") != "") & (F.col("url") != ""))


def accepted_links(rows: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """Only links on the allow-list, thumbnails replaced by the full size."""
    return rows.filter(allowed_url(F.col("url"), hosts)).withColumn("url", replace_part(F.col("url"), THUMBNAIL, FULL_SIZE))


def word_pairs(texts: DataFrame, text: str) -> DataFrame:
    """``(name, n)``: every two words that follow each other in a text, as one name, and how often; null texts have none.

    Pairs are counted as Arrow columns, slice by slice, so fewer rows than words leave a task. A name has one row per slice: add
    them up.
    """

    def counted(part: pa.Array) -> pa.RecordBatch:
        for blank in "\t\n\r\f":
            part = pc.replace_substring(part, blank, " ")
        lists = pc.split_pattern(part, " ")
        words, owner = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.not_equal(words, "")
        words, owner = words.filter(real), owner.filter(real)
        together = pc.equal(owner[:-1], owner[1:])
        names = pc.value_counts(pc.binary_join_element_wise(words[:-1].filter(together), words[1:].filter(together), " "))
        return pa.RecordBatch.from_arrays([names.field("values"), names.field("counts")], ["name", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, start = batch.column(0), 0
            while start < len(column):
                part = column.slice(start, STEP_ROWS)
                while len(part) > 1 and pc.sum(pc.binary_length(part)).as_py() > STEP_BYTES:
                    part = part.slice(0, len(part) // 2)
                yield counted(part)
                start += len(part)

    return texts.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "name string, n long")


def name_links(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One link per normalised name, the first by ``order``."""
    keyed = rows.withColumn("key", normalise_name(F.col("name")))
    return first_per_key(keyed, ["key"], [F.col(c) for c in order]).select("key", "name", "url")


def link_for(names: DataFrame, links: DataFrame, name: str = "name") -> DataFrame:
    """Left join to the link by normalised name."""
    return names.withColumn("key", normalise_name(F.col(name))).join(links.select("key", "url"), "key", "left")


def match_coverage(names: DataFrame, links: DataFrame, name: str = "name", count: str | None = None) -> DataFrame:
    """One row: names, matched names, percent. ``count`` holds how often a row's name occurs, if names are added up already."""
    looked_up = link_for(names.filter(F.col(name) != ""), links, name)
    n = F.lit(1) if count is None else F.col(count)
    total, matched = F.sum(n), F.coalesce(F.sum(F.when(F.col("url").isNotNull(), n)), F.lit(0))
    return looked_up.agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("total"), matched.cast("long").alias("matched"),
        F.coalesce(matched / total * 100, F.lit(0.0)).alias("coverage"),
    )


def unmatched_names(names: DataFrame, links: DataFrame, name: str = "name", report: int = 50) -> DataFrame:
    """The first names without a link, in name order, for a report."""
    keyed = names.filter(F.col(name) != "").withColumn("key", normalise_name(F.col(name)))
    return keyed.join(links.select("key"), "key", "left_anti").select(name).distinct().orderBy(name).limit(report)
