"""Removal of repeated byte strings with suffix arrays of text phrases.

A byte goes when it lies in a string of ``length`` bytes that also starts anywhere else in the corpus.

1. Texts are parsed into phrases that end at content-defined places (minima of a rolling hash), so equal
   strings are parsed alike: any string of ``length`` bytes holds two whole phrases in a row.
2. A task concatenates the phrase strings of its texts and sorts all suffixes by the linear grouping construction
   (:mod:`profilekit.llm.suffix_array`). Suffixes that share their first two phrases are neighbours there. A
   group of several is a repeat; of every group one head is sent on, and heads of all tasks meet by key.
   So a passage that a third of all texts share is one head per batch, and no task sees the whole corpus.
3. Exact check. Every possible start of a repeated string is judged once, under the phrase pair of smallest hash inside its
   string, of those whose marks follow from the string alone (a mark near its edge may owe its place to bytes outside): the bytes around travel to the other occurrences of that pair, and starts are compared by their
   whole strings' 64-bit hashes. Equal surroundings collapse within a batch. Pairs that occur very often
   send hashes of single starts instead, which collapse within a batch as well, so they spread over all tasks.
4. Runs of repeated starts come back to their text, which loses the bytes they cover.

Equal texts are one text throughout: when it is long enough, all of its bytes go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema, id_and_text, per_text, sha256_hex
from profilekit.llm.shingles import mix
from profilekit.llm.suffix_array import common_prefixes, suffix_array
from profilekit.session import materialise

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BLOCK = 1 << 18
_LOW = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class RepeatParams:
    """``length`` bytes make a repeat. Phrases end at minima of ``gram``-byte hashes over ``window`` places."""

    length: int = 400
    gram: int = 32
    window: int = 100
    #: Phrase pairs with more occurrences send single starts.
    often: int = 1_000

    def __post_init__(self):
        # First and last minimum inside a string are window - 1 and length - gram + 1 - window at worst; more than one gap must lie between.
        if self.length - self.gram + 1 - 2 * self.window + 1 <= self.window:
            raise ValueError("a string of this length need not hold two whole phrases")


class _Hasher:
    """Hashes of substrings of one buffer, from prefix sums; buffers are at most a few megabytes."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_Hasher.powers) < n + 1:
            size = max(n + 1, 2 * len(_Hasher.powers))
            _Hasher.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _ODD)], dtype=np.uint64)
            _Hasher.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * _Hasher.powers[:n], dtype=np.uint64)]

    def of(self, start, end) -> np.ndarray:
        """Hashes of [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * _Hasher.inverses[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of ``length`` bytes, in order."""
        n = len(self.sums) - 1
        return mix((self.sums[length:] - self.sums[:n - length + 1]) * _Hasher.inverses[:n - length + 1])


def _minima(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are the minimum of some full window, the last one at ties, with the first and last start of such a window."""
    n = len(values)
    if n < window:
        return (np.empty(0, np.int64),) * 3
    place = np.arange(n, dtype=np.uint64)
    tagged = (values & ~_LOW) | (_LOW - place)
    padded = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = tagged
    table = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n - window + 1], ahead[window - 1:n])
    at = (_LOW - (least & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def phrases(data: np.ndarray, params: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """(start of each phrase and of the end mark after the last, hash of each phrase with the mark that follows it)."""
    return _phrases(data, params)[:2]


def _phrases(data: np.ndarray, params: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases, and the first and last start of a window whose minimum a mark is."""
    starts, hashes, firsts, lasts = [], [], [], []
    step, tail = _BLOCK, 2 * (params.window + params.gram)
    last = -1
    for at in range(0, max(1, len(data)), step):
        part = data[at:at + step + tail]
        if len(part) < params.gram + params.window - 1:
            break
        hasher = _Hasher(part)
        marks, opens, closes = _minima(hasher.every(params.gram), params.window)
        inner = hasher.of(marks[:-1], marks[1:] + params.gram)
        marks = marks + at
        fresh = marks > last  # the overlap finds the same marks again
        first = int(np.argmax(fresh)) if fresh.any() else len(marks)
        if lasts and first:
            # The end of the block before may have cut the windows of its last mark.
            lasts[-1][-1] = max(lasts[-1][-1], closes[first - 1] + at)
        if first == len(marks):
            continue
        starts.append(marks[first:])
        hashes.append(inner[max(0, first - 1):])
        firsts.append(opens[first:] + at)
        lasts.append(closes[first:] + at)
        last = int(marks[-1])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


# --- repeated phrase pairs ------------------------------------------------------------------------------

_BLOB = "part int, kind int, data binary"
#: [low, high): starts of the strings that fix all marks of the pair, before the text is cut off at its ends.
_HEAD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("low", "<i4"), ("high", "<i4")])


def _blobs(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_BLOB)
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[at:at + 256]), schema)], schema=schema)


def _by_part(table: np.ndarray, key: np.ndarray, parts: int, kind: int) -> list[tuple[int, int, bytes]]:
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    table, part = table[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    return [(int(part[a]), kind, table[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(part)])]


def _pair_groups(ids: list, texts: list, params: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first of a group) of all phrase pairs of these texts, neighbours in the suffix array together."""
    symbols, doc, low, high = [], [], [], []
    reach = params.length - params.gram + 1 - params.window
    for doc_id, text in zip(ids, texts):
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) < params.length:
            continue
        _, inner, opens, closes = _phrases(data, params)
        if len(inner) < 2:
            continue
        # The phrase string of a text and a separator; the last phrase starts no pair.
        symbols += [inner, np.zeros(1, np.uint64)]
        doc.append(np.full(len(inner) + 1, doc_id, np.int64))
        # The string holds a window of the last mark and one of the first; the mark between has one then.
        low.append(np.r_[opens[2:] - reach, 0, 0])
        high.append(np.r_[closes[:-2] + 1, 0, 0])
    if not symbols:
        return np.empty(0, _HEAD), np.empty(0, bool)
    symbols, low, high = np.concatenate(symbols), np.concatenate(low), np.concatenate(high)
    # Separators become distinct symbols below all phrases, so no match runs across texts.
    _, ranks = np.unique(symbols, return_inverse=True)
    breaks = np.flatnonzero(symbols == 0)
    ranks = ranks + len(breaks)
    ranks[breaks] = np.arange(len(breaks))
    order = suffix_array(ranks)
    group = np.cumsum(np.r_[False, common_prefixes(ranks, order, 2) < 2])
    # A pair that no string fixes judges nothing.
    whole = (np.maximum(low, 0) < high)[order]
    rows = np.empty(len(order), _HEAD)
    ahead = np.r_[symbols[1:], np.uint64(0)]
    rows["key"], rows["doc"] = mix(mix(symbols[order]) + ahead[order]), np.concatenate(doc)[order]
    rows["low"], rows["high"] = low[order], high[order]
    group = group[whole]
    return rows[whole], np.r_[True, group[1:] != group[:-1]][:len(group)]


def _repeated_pairs(texts: DataFrame, params: RepeatParams, parts: int) -> DataFrame:
    """(key, doc, low, high) of phrase pairs that occur more than once; a head may come twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
                if doc_id is not None and digest not in seen:  # an equal text of this task stands for this one
                    seen.add(digest)
                    ids.append(doc_id)
                    rows.append(text)
                if len(seen) > 200_000:
                    seen.clear()
            at = 0
            while at < len(ids):  # bounded suffix arrays: about 4 million characters each
                stop, chars = at, 0
                while stop < len(ids) and (stop == at or chars + len(rows[stop]) <= 4 << 20):
                    chars += len(rows[stop])
                    stop += 1
                table, first = _pair_groups(ids[at:stop], rows[at:stop], params)
                at = stop
                if not len(table):
                    continue
                heads = table[first]
                size = np.diff(np.r_[np.flatnonzero(first), len(table)])
                several = table[np.repeat(size > 1, size)]
                yield from _blobs(_by_part(heads, heads["key"], parts, 0) + _by_part(several, mix(several["doc"].view(np.uint64)), parts, 1))

    def meet(frame):
        import pandas as pd

        tables = [[np.frombuffer(d, _HEAD) for d in frame["data"][frame["kind"] == kind]] for kind in (0, 1)]
        heads, known = (np.concatenate(t) if t else np.empty(0, _HEAD) for t in tables)
        heads = heads[np.argsort(heads["key"], kind="stable")]
        again = heads["key"][1:] == heads["key"][:-1]
        found = np.concatenate([known, heads[np.r_[False, again] | np.r_[again, False]] if len(heads) else heads])
        return pd.DataFrame({"key": found["key"].view(np.int64), "doc": found["doc"], "low": found["low"], "high": found["high"]})

    # Heads meet by key, one per key and batch; what is known to repeat only passes through and is spread by text.
    return texts.mapInArrow(run, _BLOB).repartition(parts, "part").groupBy("part").applyInPandas(meet, "key long, doc long, low int, high int")


# --- exact check ----------------------------------------------------------------------------------------

_UNIT = np.dtype([("doc", "<i8"), ("low", "<i4"), ("high", "<i4")])
_START = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<i4")])
_RUN = np.dtype([("doc", "<i8"), ("low", "<i4"), ("high", "<i4")])


def _owners(n: int, keys: np.ndarray, lows: np.ndarray, highs: np.ndarray, params: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [low, high) of starts and the pair that judges them: of the pairs the string fixes the one of smallest key, the last at ties."""
    owner = np.full(n - params.length + 1, -1, np.int64)
    order = np.lexsort((highs, ~keys))
    low, high = np.maximum(lows, 0), np.minimum(highs, len(owner))
    for j in order.tolist():
        owner[low[j]:high[j]] = j
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    stop = np.r_[edge[1:], len(owner)]
    own = owner[edge]
    return own[own >= 0], edge[own >= 0], stop[own >= 0]


def _lots(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Ranges of rows of the batches with at most ``most`` bytes in a text column, one row at least."""
    for batch in batches:
        sizes, at = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)], np.int64), 0
        while at < batch.num_rows:
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
            yield batch, at, stop
            at = stop


def _as_runs(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Maximal runs of consecutive starts per text."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return np.empty(0, _RUN)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]
    first = np.flatnonzero(fresh)
    out = np.empty(len(first), _RUN)
    out["doc"], out["low"], out["high"] = doc[first], start[first], start[np.r_[first[1:], len(doc)] - 1] + 1
    return out


def _starts_of(units: np.ndarray, data: list[bytes], params: RepeatParams) -> np.ndarray:
    """Every start of the units with the hash of its whole string."""
    out, at = [], 0
    while at < len(units):
        stop, size = at, 0
        while stop < len(units) and (stop == at or size + len(data[stop]) <= 1 << 19):
            size += len(data[stop])
            stop += 1
        hasher = _Hasher(np.frombuffer(b"".join(data[at:stop]), np.uint8))
        part = units[at:stop]
        count = (part["high"] - part["low"]).astype(np.int64)
        base = np.cumsum([0] + [len(d) for d in data[at:stop - 1]])
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(base, count) + place
        rows = np.empty(len(place), _START)
        rows["hash"], rows["doc"] = hasher.of(begin, begin + params.length), np.repeat(part["doc"], count)
        rows["start"] = np.repeat(part["low"], count) + place
        out.append(rows)
        at = stop
    return np.concatenate(out) if out else np.empty(0, _START)


def _judged(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose string starts elsewhere among them, one head of each string)."""
    rows = rows[np.argsort(rows["hash"], kind="stable")]
    same = rows["hash"][1:] == rows["hash"][:-1]
    again = np.r_[False, same] | np.r_[same, False] if len(rows) else np.empty(0, bool)
    return rows[again], rows[np.r_[True, ~same]] if len(rows) else rows


def _repeated_runs(candidates: DataFrame, params: RepeatParams, parts: int) -> DataFrame:
    """(doc, low, high): runs of starts whose strings also start elsewhere; runs may overlap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last in _lots(batches, 1, 4 << 20):
            units, keys, data, hot, first_of = [], [], [], [], {}
            known: list[tuple[int, int, int]] = []
            for row in range(first, last):
                doc, text, marks = (batch.column(c)[row].as_py() for c in ("doc", "text", "pairs"))
                raw = text.encode()
                marks = sorted({(m["key"], m["low"], m["high"], m["hot"]) for m in marks})
                key, least, most, often = (np.array(c) for c in zip(*marks))
                own, low, high = _owners(len(raw), key.view(np.uint64), least.astype(np.int64), most.astype(np.int64), params)
                for j, a, b in zip(own.tolist(), low.tolist(), high.tolist()):
                    piece = raw[a:b + params.length - 1]
                    same = (int(key[j]), piece)
                    if same in first_of:  # equal surroundings: all their starts are repeats
                        known.append((doc, a, b))
                        other = first_of[same]
                        if other is not None:
                            known.append(other)
                            first_of[same] = None
                        continue
                    first_of[same] = (doc, a, b)
                    units.append((doc, a, b))
                    keys.append(int(key[j]) & 0xFFFFFFFFFFFFFFFF)
                    data.append(piece)
                    hot.append(bool(often[j]))
            rows = []
            table, key, hot = np.array(units, _UNIT), np.array(keys, np.uint64), np.array(hot, bool)
            if hot.any():
                at = np.flatnonzero(hot)
                again, heads = _judged(_starts_of(table[at], [data[k] for k in at.tolist()], params))
                runs = _as_runs(again["doc"], again["start"])
                known += [tuple(r) for r in runs.tolist()]
                rows += _by_part(heads, heads["hash"], parts, 1)
            cold = np.flatnonzero(~hot)
            if len(cold):
                part = ((mix(key[cold]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cold, part = cold[order], part[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for a, b in zip(cuts, [*cuts[1:], len(part)]):
                    chosen = cold[a:b]
                    rows.append((int(part[a]), 0, len(chosen).to_bytes(8, "little") + table[chosen].tobytes() + b"".join(data[k] for k in chosen.tolist())))
            if known:
                table = np.array(known, _RUN)
                rows += _by_part(table, mix(table["doc"].view(np.uint64)), parts, 2)
            yield from _blobs(rows)

    def meet(frame):
        import pandas as pd

        units, data, starts, runs = [], [], [], []
        for kind, blob in zip(frame["kind"], frame["data"]):
            if kind == 1:
                starts.append(np.frombuffer(blob, _START))
            elif kind == 2:
                runs.append(np.frombuffer(blob, _RUN))
            else:
                n = int.from_bytes(blob[:8], "little")
                own = np.frombuffer(blob, _UNIT, n, 8)
                units.append(own)
                at = 8 + n * _UNIT.itemsize
                for size in (own["high"] - own["low"] + params.length - 1).tolist():
                    data.append(blob[at:at + size])
                    at += size
        if units:
            starts.append(_starts_of(np.concatenate(units), data, params))
        if starts:
            again, _ = _judged(np.concatenate(starts))
            runs.append(_as_runs(again["doc"], again["start"]))
        found = np.concatenate(runs) if runs else np.empty(0, _RUN)
        return pd.DataFrame({"doc": found["doc"], "low": found["low"], "high": found["high"]})

    return candidates.mapInArrow(run, _BLOB).repartition(parts, "part").groupBy("part").applyInPandas(meet, "doc long, low int, high int")


# --- the whole ------------------------------------------------------------------------------------------

def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the strings starting in the runs [low, high) cover."""
    out: list[list[int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high - 1 + length)
        else:
            out.append([low, high - 1 + length])
    return [(a, b) for a, b in out]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def repeated_spans(df: DataFrame, params: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end, flat).

    Defined cases: null texts are empty; texts shorter than ``length`` bytes lose nothing; of repeated rows and equal texts of
    that length or more all bytes go, as each has its string elsewhere; rows with a null doc_id lose bytes
    only if an equal text exists; rows that share a doc_id should have one text; other columns are ignored; an empty
    table gives an empty table.
    """
    texts = id_and_text(df, id_col, text_col)

    def make():
        def work(doc_ids, rows):
            raw = [t.encode() for t in rows]
            return {"doc_id": doc_ids, "n_bytes": [len(r) for r in raw], "sha": [sha256_hex(r) for r in raw]}

        return work

    light = materialise(per_text(texts, make, "doc_id long, n_bytes long, sha string"))
    long_ones = light.where(F.col("n_bytes") >= params.length)
    copies = materialise(long_ones.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    # About 2 heads per 100 bytes of 24 bytes each: parts of some 8 MB.
    parts = max(1, -(-total // (16 << 20)))

    found = _repeated_pairs(texts.where(F.octet_length("text") >= params.length), params, parts)
    firsts = long_ones.join(copies, "sha").select(F.col("doc_id").alias("doc"), "first").distinct()
    pairs = materialise(
        found.join(firsts, "doc", "left").select("key", F.coalesce("first", "doc").alias("doc"), "low", "high"))
    # Copies of one text are one text, so a pair must be left in two places.
    distinct = pairs.groupBy("key", "doc", "low", "high").agg(F.lit(1).alias("one"))
    # Written first: a join of two plain tables can split a key that very many pairs share.
    counts = materialise(distinct.groupBy("key").agg(F.count("one").alias("n")).where("n > 1"))
    lists = (
        pairs.join(counts, "key").groupBy("doc")
        .agg(F.collect_set(F.struct("key", "low", "high", (F.col("n") > params.often).alias("hot"))).alias("pairs"))
    )
    candidates = materialise(texts.withColumnRenamed("doc_id", "doc").join(lists, "doc"))
    runs = _repeated_runs(candidates, params, parts)
    per_doc = runs.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    gone = copies.select(F.col("first").alias("doc"))
    cut = candidates.select("doc", "text").join(per_doc, "doc").join(gone, "doc", "left_anti")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("doc long, kept string, spans array<int>")
        for batch in batches:
            kept, all_spans = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = covered([(r["low"], r["high"]) for r in own], params.length)
                kept.append(sha256_hex(_cut(text.encode(), spans)))
                all_spans.append([x for span in spans for x in span])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept), pa.array(all_spans, pa.list_(pa.int32()))], schema=schema)

    result = materialise(cut.select("doc", "text", "runs").mapInArrow(apply, "doc long, kept string, spans array<int>")).dropDuplicates(["doc"])
    whole = F.array(F.lit(0), F.col("n_bytes").cast("int"))
    spans = F.when(F.col("copies").isNotNull(), whole).otherwise(F.coalesce("spans", F.array().cast("array<int>")))
    joined = light.join(copies.select("sha", "copies"), "sha", "left").join(result, F.col("doc_id") == F.col("doc"), "left")
    return joined.withColumn("spans", spans).select(
        "doc_id", "n_bytes",
        F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.when(F.col("copies").isNotNull(), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        "spans",
    )
