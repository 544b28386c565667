"""How filters interact: what each removes, alone and in every order, from a sparse document-term matrix.

1. Every task cuts its rows into shards of bounded text and builds one matrix a shard in compressed rows (CSR): words
   are numbered within the shard, entries are counts. Next to it go the keys of the rows and the flags that need the
   text itself. Only the distinct words of a shard are shuffled, in arrays by hash bucket, never the tokens.
2. The distinct words of all shards get dense global numbers: buckets one after the other, words in
   order within their bucket. Each shard gets back one array of numbers a bucket, the new columns of its matrix.
3. Row sums of the renumbered matrix are word counts, nonzero counts are distinct words; they decide A and B.
4. Flags of a row depend on its text alone, but for E, which needs the smallest id with that text. So rows are added up
   by text digest, part and labels before anything is joined, and a text that fills a third of the table is
   a few rows. What remains is a count per part and set of failed filters, on which all orders are worked out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import permutations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilekit.llm.spread import spread_join
from profilekit.session import materialise

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MARKS = b"#$%&*|"


@dataclass(frozen=True)
class AuditParams:
    """Thresholds of the filters; how much text one shard and how many words of shards one bucket of the dictionary hold."""

    least_words: int = 100
    distinct_percent: int = 80
    upper_percent: int = 10
    shard_bytes: int = 12_000_000
    bucket_words: int = 500_000


# --- shards -------------------------------------------------------------------------------------------------

_SHARD = (
    "shard long, doc_id array<long>, part array<string>, digest array<binary>, flags binary, "
    "indptr binary, indices binary, data binary, words array<string>"
)
_SHARD_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("part", pa.list_(pa.string())), ("digest", pa.list_(pa.binary())), ("flags", pa.binary()),
    ("indptr", pa.binary()), ("indices", pa.binary()), ("data", pa.binary()), ("words", pa.list_(pa.string())),
])


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as differences (modulo 2**32), byte plane after byte plane: small steps leave planes of zeros, which compress away."""
    steps = np.diff(numbers.astype(np.uint32), prepend=np.uint32(0))
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32).astype(np.int64)


def coded_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row, word) of every token. Arrow's ASCII white space is the contract's: space and \\x09 to \\x0D."""
    tokens = pc.ascii_split_whitespace(texts)
    rows, words = pc.list_parent_indices(tokens).to_numpy(), tokens.flatten()
    real = pc.not_equal(words, "")
    return rows[real.to_numpy(zero_copy_only=False)].astype(np.int64), words.filter(real).dictionary_encode()


def csr_of(rows: np.ndarray, words: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, sorted word numbers of each row, counts) of tokens (row, word)."""
    cells, counts = np.unique(rows * max(1, width) + words, return_counts=True)
    return np.searchsorted(cells, np.arange(height + 1, dtype=np.int64) * max(1, width)), cells % max(1, width), counts


def byte_counts(texts: pa.Array, kinds: list[np.ndarray]) -> list[np.ndarray]:
    """For each table of 256 flags: how many bytes of each text it marks."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    at = offsets - offsets[0] if len(texts) else offsets
    return [np.diff(np.r_[0, np.cumsum(kind[body], dtype=np.int64)][at]) for kind in kinds]


def _table(marked: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(marked)] = 1
    return table


_UPPER, _MARKED, _FIRST = _table(range(65, 91)), _table(MARKS), _table([*range(0x80), *range(0xC0, 0x100)])


def text_flags(texts: pa.Array, params: AuditParams) -> np.ndarray:
    """Bits of C and D for each text; characters are counted by their first bytes."""
    upper, marked, points = byte_counts(texts, [_UPPER, _MARKED, _FIRST])
    return (4 * (100 * upper > params.upper_percent * points) + 8 * (marked > 0)).astype(np.uint8)


class _Shard:
    """Rows of one shard as they come in; only coded tokens and distinct words are kept."""

    def __init__(self):
        self.rows, self.height, self.bytes = [], 0, 0
        self.parts: list[tuple[pa.RecordBatch, np.ndarray, list[bytes], pa.DictionaryArray]] = []

    def add(self, rows: pa.RecordBatch, size: int, params: AuditParams) -> None:
        texts = rows.column("text")
        at, words = coded_tokens(texts)
        self.rows.append(at + self.height)
        digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
        self.parts.append((rows.drop_columns(["text"]), text_flags(texts, params), digests, words))
        self.height += rows.num_rows
        self.bytes += size

    def row(self) -> pa.RecordBatch:
        words = pa.chunked_array([p[3] for p in self.parts]).unify_dictionaries()
        dictionary = words.chunk(0).dictionary
        coded = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64)
        indptr, indices, data = csr_of(np.concatenate(self.rows), coded, self.height, len(dictionary))
        keys = pa.Table.from_batches([p[0] for p in self.parts]).combine_chunks()
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        column = lambda name: keys.column(name).combine_chunks()
        return pa.RecordBatch.from_arrays([
            pa.array([column("row")[0].as_py()], pa.int64()), one(column("doc_id")), one(column("part")),
            one(pa.array([d for p in self.parts for d in p[2]], pa.binary())), pa.array([np.concatenate([p[1] for p in self.parts]).tobytes()], pa.binary()),
            pa.array([packed(indptr)], pa.binary()), pa.array([packed(indices)], pa.binary()), pa.array([packed(data)], pa.binary()), one(dictionary),
        ], schema=_SHARD_SCHEMA)


def csr_shards(rows: DataFrame, params: AuditParams) -> DataFrame:
    """One row a shard of ``rows`` (row, doc_id, text, part): keys, flags of C and D, matrix and words, numbered within the shard."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, piece = _Shard(), max(1, params.shard_bytes // 8)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
            start = 0
            while start < batch.num_rows:
                # Texts are coded piece by piece; a longer text is a piece of its own.
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), piece, "right")))
                shard.add(batch.slice(start, stop - start), int(sizes[start:stop].sum()), params)
                start = stop
                if shard.bytes >= params.shard_bytes:
                    yield shard.row()
                    shard = _Shard()
        if shard.height:
            yield shard.row()

    return rows.mapInArrow(build, _SHARD)


# --- the global dictionary ----------------------------------------------------------------------------------

_WORDS_DDL, _NUMBERS_DDL = "bucket int, shard long, locals binary, words array<string>", "bucket int, shard long, locals binary, numbers binary, size long"
_WORDS_SCHEMA = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("locals", pa.binary()), ("words", pa.list_(pa.string()))])
_NUMBERS_SCHEMA = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("locals", pa.binary()), ("numbers", pa.binary()), ("size", pa.int64())])


def word_numbers(shards: DataFrame, bucket_words: int) -> DataFrame:
    """(bucket, shard, locals, numbers, size, start): a shard's words in a bucket by local number, their places in the bucket.

    A word's global number is ``start`` plus its place. A bucket holds some ``bucket_words`` entries (a word counts once a shard), so the
    task that orders it is bounded; the driver sees one number a bucket.
    """
    entries = shards.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    buckets = max(1, ceil(entries / bucket_words))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                if not len(words):
                    continue
                bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
                locals_ = np.split(order, starts[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[order][starts], pa.int32()), pa.array([batch.column("shard")[i].as_py()] * len(starts), pa.int64()),
                    pa.array([packed(x) for x in locals_], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), words.take(pa.array(order)))], schema=_WORDS_SCHEMA)

    def number(table: pa.Table) -> pa.Table:
        lists = table.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        numbers = np.split(place[coded.indices.to_numpy()], np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
        return pa.table([
            *(table.column(n) for n in ("bucket", "shard", "locals")), pa.array([packed(x) for x in numbers], pa.binary()),
            pa.array([len(place)] * table.num_rows, pa.int64())], schema=_NUMBERS_SCHEMA)

    dealt = shards.select("shard", "words").mapInArrow(deal, _WORDS_DDL)
    numbered = materialise(dealt.groupBy("bucket").applyInArrow(number, _NUMBERS_DDL))
    sizes = {r["bucket"]: r["size"] for r in numbered.groupBy("bucket").agg(F.max("size").alias("size")).collect()}
    starts, at = [], 0
    for bucket in range(buckets):
        starts.append((bucket, at))
        at += sizes.get(bucket, 0)
    first = F.broadcast(shards.sparkSession.createDataFrame(starts, "bucket int, start long"))
    return numbered.join(first, "bucket")


def renumbered(shards: DataFrame, params: AuditParams) -> DataFrame:
    """``shards`` without words, plus ``columns``: (locals, numbers, start) of every bucket."""
    numbers = word_numbers(shards, params.bucket_words)
    columns = numbers.groupBy("shard").agg(F.collect_list(F.struct("locals", "numbers", "start")).alias("columns"))
    return shards.drop("words").join(columns, "shard", "left")


def global_matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, global word numbers sorted within rows, counts) of one row of :func:`renumbered`."""
    indptr, indices, data = (unpacked(row[name]) for name in ("indptr", "indices", "data"))
    width = sum(len(c["locals"]) // 4 for c in row["columns"] or ())
    column_of = np.empty(width, np.int64)
    for c in row["columns"] or ():
        column_of[unpacked(c["locals"])] = c["start"] + unpacked(c["numbers"])
    columns = column_of[indices]
    order = np.lexsort((columns, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
    return indptr, columns[order], data[order]


_FLAG_DDL = "doc_id long, part string, digest binary, mask int"
_FLAG_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])


def _own_flags(shards: DataFrame, params: AuditParams) -> DataFrame:
    """(doc_id, part, digest, mask) of every row: bits of A to D, the first two from row sums and nonzero counts."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                indptr, _, data = global_matrix({n: row[n].as_py() for n in ("indptr", "indices", "data", "columns")})
                sums = np.diff(np.r_[0, np.cumsum(data, dtype=np.int64)][indptr])
                nonzero = np.diff(indptr)
                mask = (sums < params.least_words) + 2 * (100 * nonzero < params.distinct_percent * sums) + np.frombuffer(row["flags"].as_py(), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"].values, row["part"].values, row["digest"].values, pa.array(mask.astype(np.int32))], schema=_FLAG_SCHEMA)

    return renumbered(shards, params).mapInArrow(read, _FLAG_DDL)


# --- counts -------------------------------------------------------------------------------------------------

def failed_filters(docs: DataFrame, labels: DataFrame, params: AuditParams = AuditParams(), part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, docs, good, toxic): documents per part and set of failed filters (bit 0 is A), labelled ones among them."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    shards = materialise(csr_shards(rows, params))
    flagged = materialise(_own_flags(shards, params).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("doc_id", "good", "toxic")
        .where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    labelled = spread_join(flagged, marks, ["doc_id"], "left")
    group = ["digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # Within a group each id is one row, so the smallest struct carries the rows of the smallest id.
    groups = materialise(labelled.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")))
    lowest = groups.groupBy("digest").agg(F.min("low.doc_id").alias("lowest"))
    first = F.col("unnamed") + F.when(F.col("low.doc_id") == F.col("lowest"), F.col("low.n")).otherwise(0)
    split = (
        groups.join(lowest, "digest")
        .select("part", "mask", "good", "toxic", F.inline(F.array(
            F.struct(F.lit(0).alias("copy"), first.alias("n")), F.struct(F.lit(16).alias("copy"), (F.col("n") - first).alias("n")))))
        .where("n > 0"))
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", (F.col("mask") + F.col("copy")).alias("mask")).agg(F.sum("n").alias("docs"), when("good").alias("good"), when("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, params: AuditParams = AuditParams(), part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The five filters fail a text with A: fewer than ``least_words`` words, B: fewer than ``distinct_percent`` distinct words in 100, C: more than
    ``upper_percent`` A-Z in 100 characters, D: one of ``# $ % & * |``, E: a smaller id with the same text anywhere in the table.
    Defined cases: a null text is empty (no words: A fails, the others do not), a null part is the empty name; rows that
    share the smallest id and text all pass E, as do rows without an id, which no id is smaller than; several labels of
    one id count as good or toxic if any says so; other columns are ignored; an empty table gives an empty table.
    """
    masks = materialise(failed_filters(docs, labels, params, part, id_col, text_col))
    steps = [(order, i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[:i])) for order in ORDERS for i, f in enumerate(order)]
    numbered = F.broadcast(masks.sparkSession.createDataFrame(
        [(i, *step) for i, step in enumerate(steps)], "i int, filter_order string, step int, bit int, before int"))
    # A part has at most 32 masks; each is listed once for each of the 600 steps.
    per_step = masks.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i")).join(numbered, "i")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda condition, n="docs": F.sum(F.when(condition, F.col(n)).otherwise(0)).cast("long")
    counted = per_step.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"))
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
