"""Context-triggered piecewise hashing: document fingerprints that change where the text changes.

A rolling hash over the last eight bytes ends a chunk wherever it falls below ``2**32 / block``;
so boundaries depend only on nearby bytes and return to step after an edit. Every chunk gives
one of 64 characters. A fingerprint is ``block:signature:signature at twice the block``. Blocks
are powers of two chosen by the text's length, so boundaries of a larger block are boundaries of the smaller.
Two fingerprints compare by edit distance where their block sizes meet (equal, or one twice the other).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema, id_and_text, per_text, sha256_hex
from profilekit.session import materialise

SIGNATURE = 64
LEAST_BLOCK_BITS = 2
#: Signatures without a common run of this length are taken as unrelated.
COMMON_RUN = 4
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_RUNS = re.compile(r"(.)\1{3,}", re.DOTALL)
_SLICE = 1 << 20
_WINDOW = 8


def _byte_values() -> np.ndarray:
    """256 well-mixed 32-bit values by a rule (the finaliser of a common integer hash)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


_VALUES = _byte_values()


def _boundaries(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks (exclusive) at block 2**bits, and the rolling hash there."""
    ends, hashes = [], []
    limit = np.uint32((1 << (32 - bits)) - 1)
    for start in range(0, len(data), _SLICE):
        lead = min(start, _WINDOW - 1)
        value = _VALUES[np.frombuffer(data, np.uint8, min(_SLICE, len(data) - start) + lead, start - lead)]
        for step in (1, 2, 4):  # each step doubles the window: 2, 4, 8 bytes
            wider = value.copy()
            wider[step:] += value[:-step] << np.uint32(step)
            value = wider
        at = np.flatnonzero(value[lead:] <= limit)
        ends.append(at + start + 1)
        hashes.append(value[lead:][at])
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(ends), np.concatenate(hashes)


def _signature(data: memoryview, ends: np.ndarray, length: int) -> str:
    """One character per chunk; the last one stands for all that is left."""
    letters, start = [], 0
    for end in ends[:length - 1].tolist():
        letters.append(_LETTERS[zlib.crc32(data[start:end]) & 63])
        start = end
    if start < len(data):
        letters.append(_LETTERS[zlib.crc32(data[start:]) & 63])
    return "".join(letters)


def fingerprint(text: str) -> str:
    """``block:signature:signature``; equal texts have equal fingerprints, the empty text has ``4::``."""
    data = text.encode()
    bits = max(LEAST_BLOCK_BITS, int(np.ceil(np.log2(max(1, len(data)) / SIGNATURE))))
    ends, hashes = _boundaries(data, bits)
    if len(ends) < SIGNATURE // 2 and bits > LEAST_BLOCK_BITS:
        # Few boundaries: halve the block until there are enough, from one finer pass.
        finest, hashes_all = _boundaries(data, LEAST_BLOCK_BITS)
        while len(ends) < SIGNATURE // 2 and bits > LEAST_BLOCK_BITS:
            bits -= 1
            near = hashes_all <= np.uint32((1 << (32 - bits)) - 1)
            ends, hashes = finest[near], hashes_all[near]
    twice = ends[hashes <= np.uint32((1 << (31 - bits)) - 1)]
    view = memoryview(data)
    return f"{1 << bits}:{_signature(view, ends, SIGNATURE)}:{_signature(view, twice, SIGNATURE // 2)}"


def _codes(signatures: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in signatures], np.int64)
    table = np.full((len(signatures), SIGNATURE), filler, np.uint8)
    for row, text in enumerate(signatures):
        table[row, :len(text)] = np.frombuffer(text.encode(), np.uint8)
    return table, lengths


def _common_subsequence(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row pair, bit-parallel over 64 positions."""
    state = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(int(b_len.max(initial=0))):
        match = np.packbits(a == b[:, j:j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        hit = state & match
        state = (state + hit) | (state - hit)
    inside = np.where(a_len >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(a_len, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & inside).astype(np.int64)


def _share_run(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Whether two signatures have COMMON_RUN characters in a row in common."""
    wide = SIGNATURE - COMMON_RUN + 1

    def grams(table, lengths, filler):
        out = np.zeros((len(table), wide), np.uint32)
        for k in range(COMMON_RUN):
            out = (out << np.uint32(8)) | table[:, k:k + wide]
        out[np.arange(wide)[None, :] > (lengths - COMMON_RUN)[:, None]] = filler
        return out

    left, right, found = grams(a, a_len, 0), grams(b, b_len, 1), np.zeros(len(a), bool)
    for k in range(wide):
        found |= (left == right[:, k:k + 1]).any(axis=1)
    return found


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 - edit distance / total length, a change being a deletion and
    an insertion; 1 for equal ones, 0 where block sizes do not meet or no run is shared."""
    out = np.zeros(len(pairs))
    rows, left, right = [], [], []
    for row, (x, y) in enumerate(pairs):
        if x == y:
            out[row] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        meet = [(p1, q1), (p2, q2)] if p == q else [(p1, q2)] if p == 2 * q else [(p2, q1)] if q == 2 * p else []
        for a, b in meet:
            a, b = _RUNS.sub(r"\1\1\1", a), _RUNS.sub(r"\1\1\1", b)
            if len(a) >= COMMON_RUN and len(b) >= COMMON_RUN:
                rows.append(row)
                left.append(a)
                right.append(b)
    for start in range(0, len(rows), 4096):
        stop = start + 4096
        a, a_len = _codes(left[start:stop], 1)
        b, b_len = _codes(right[start:stop], 2)
        same = _common_subsequence(a, a_len, b, b_len)
        value = np.where(_share_run(a, a_len, b, b_len), 2.0 * same / (a_len + b_len), 0.0)
        np.maximum.at(out, rows[start:stop], value)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row's whole text; a null text is the empty text."""
    def make():
        return lambda ids, texts: {"doc_id": ids, "fingerprint": [fingerprint(t) for t in texts]}

    return per_text(id_and_text(df, id_col, text_col), make, "doc_id long, fingerprint string")


# --- each document with the next one --------------------------------------------------------------------

_PAIR_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LOWEST = -(1 << 63)
_ROWS_AT_ONCE = 512
_CHARS_AT_ONCE = 4 << 20


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(rows: Iterator[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, next text) in order; a text's fingerprint is used for it and for the one before."""
    schema, held, size, last = arrow_schema(_PAIR_DDL), [], 0, (None, "")

    def flush():
        near = likeness([(h[3], h[4]) for h in held] + [(h[3], h[5]) for h in held])
        n = len(held)
        columns = [list(c) for c in zip(*[h[:5] for h in held])] + [near[:n], near[n:]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for doc_id, text, following in rows:
        own = last[1] if last[0] is text else fingerprint(text)
        ahead = fingerprint(following)
        last = (following, ahead)
        changed = edited(text, following)
        held.append((doc_id, len(text), sha256_hex(changed.encode()), own, fingerprint(changed), ahead))
        size += len(text)
        if len(held) >= _ROWS_AT_ONCE or size >= _CHARS_AT_ONCE:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text and against the next document, by descending doc_id.

    The order is cut at quantiles of doc_id into ranges; each range gets, besides its own rows, those
    with the largest doc_id of the range after it, so that every task holds the next of its last
    row. The text is shuffled once, tasks stream, and only the cuts reach the driver.

    Defined cases: null texts count as empty; rows that share a doc_id follow each other by text;
    null doc_ids come last; after the last row comes the first (a single row is its own next);
    other columns are ignored; an empty table gives an empty table.
    """
    spark = df.sparkSession
    rows = id_and_text(df, id_col, text_col).withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST)))
    keys = materialise(rows.select("k"))
    total = keys.count()
    ranges = min(10_000, max(4 * spark.sparkContext.defaultParallelism, total // 20_000))
    share = [i / ranges for i in range(1, ranges)]
    found = keys.agg(F.percentile_approx("k", share, max(10_000, 4 * ranges)).alias("q")).first()["q"] if total and share else []
    cuts = sorted(set(found or []))
    number = _range_of(cuts)
    first = {r["part"]: r["k"] for r in keys.select("k", number.alias("part")).groupBy("part").agg(F.max("k").alias("k")).collect()}
    order = sorted(first)
    before = {part: order[i - 1] for i, part in enumerate(order)}  # the first range follows the last
    heads = spark.createDataFrame([(first[p], before[p]) for p in order] or [(0, 0)], "head long, guest_of int").limit(len(order))
    placed = rows.withColumn("part", number)
    guests = placed.join(F.broadcast(heads), F.col("k") == F.col("head")).select("doc_id", "text", "k", F.col("guest_of").alias("part"), F.lit(1).alias("guest"))
    dealt = (
        placed.withColumn("guest", F.lit(0)).select("doc_id", "text", "k", "part", "guest").unionByName(guests)
        .repartitionById(max(1, len(order)), F.col("part")).sortWithinPartitions("part", "guest", F.col("k").desc(), "text")
        .select("doc_id", "text", "part", "guest")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            waiting = None
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for doc_id, text, part, guest in zip(*columns):
                    if waiting is not None and waiting[2] == part:
                        yield waiting[0], waiting[1], text
                    waiting = None if guest else (doc_id, text, part)

        yield from _compared(pairs())

    return dealt.mapInArrow(run, _PAIR_DDL)


def _range_of(cuts: list[int]):
    """Number of cuts at or above ``k``, by halving, as a Column: ranges follow descending keys."""
    def side(low: int, high: int):
        if low == high:
            return F.lit(len(cuts) - low)
        middle = (low + high) // 2
        return F.when(F.col("k") > cuts[middle], side(middle + 1, high)).otherwise(side(low, middle))

    return side(0, len(cuts)).cast("int")
