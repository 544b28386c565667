"""Similarity join of word-shingle sets by universe partition and the pigeonhole principle.

Two sets of sizes p and q with a Jaccard similarity of at least t differ in at most H = (1-t)/(1+t) (p+q)
shingles. Hash the universe of shingles into m > H segments: the parts of two such sets differ in fewer
than one shingle on average, so any choice of allowances v (0, 1, 2 per segment) with a sum above H leaves a segment
where they differ in fewer than v shingles. v=1 means equal parts: one signature. v=2 means parts that differ in one
shingle at most: the part and its one-deletion neighbourhood.

* Sizes fall into bands whose limits grow by 1/t; each band has its own m. A set is indexed in its own
  band and probes its own and the band below, so every pair meets where its smaller set is indexed.
* Allowances go where they cost least: empty and tiny parts, which thousands of sets share, get 0, and where that
  leaves too few, parts with an indexed one-deletion neighbourhood get 2.
* Signatures that meet give candidates. They are filtered by size and by a 1024-bit parity sketch (a lower bound of the
  difference, so no pair is lost) and verified on the whole texts.

Hot groups. Equal sets are one set from the start. A signature many sets share is never expanded into pairs: a
bucket gives a spanning forest of its likely links; verified links make components; a second round does the same between
components; the last round compares, inside tasks and in blocks, only sets of different components, so a large group of
near copies ends as one component after linear work, and still no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema, give_back, id_and_text, slices
from profilekit.llm.links import components
from profilekit.llm.shingles import mix, shingle_set
from profilekit.session import batch_rows, materialise

#: Unlinked sets look apart while half of the bits are more than the difference allowed, up to some 3,000 shingles.
SKETCH_BITS = 1024
#: Pairs whose sketches are compared at once.
_SKETCH_PAIRS = 100_000
#: Rows with whole texts that Spark hands to Python at once.
TEXT_ROWS = 512
#: Rows of one bucket that one task compares with each other.
CHUNK = 2_048
_INDEXED, _PROBING = 1, 2


@dataclass(frozen=True)
class JoinParams:
    """Shingle length in words and the threshold in percent."""

    words: int = 4
    percent: int = 85
    #: One segment in so many has its one-deletion neighbourhoods indexed.
    deletion_every: int = 16

    def difference(self, total: int | np.ndarray):
        """Most shingles two linked sets may differ in, given the sum of their sizes."""
        return (100 - self.percent) * total // (100 + self.percent)

    def linked(self, common: int, total: int) -> bool:
        return 100 * common >= self.percent * (total - common)


class Bands:
    """Size bands and their numbers of segments, worked out as sizes come up."""

    def __init__(self, params: JoinParams):
        self.params = params
        # Below this size different sets cannot link: n of n + 1 shingles in common is under the threshold.
        self.least = next(n for n in range(1, 10_000) if 100 * n >= params.percent * (n + 1))
        self.low, self.high = [self.least], [self.least * 100 // params.percent]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * 100 // self.params.percent))
        return int(np.searchsorted(self.high, size))

    def segments(self, band: int) -> int:
        top = self.high[band]
        return int(self.params.difference(top + top * 100 // self.params.percent)) + 1


#: Cost of equal parts by their size: how many other sets share such a part, roughly.
_COST = np.array([10_000.0, 400.0, 40.0, 8.0, 4.0, 3.0, 2.0, 1.5, 1.0])


def allot(counts: np.ndarray, needed: int, deletable: int) -> np.ndarray:
    """Allowance of each segment: the cheapest choice whose sum is ``needed``.

    Segments below ``deletable`` may get 2, at the price of one lookup per shingle of the part.
    """
    cost = _COST[np.minimum(counts, len(_COST) - 1)]
    order = np.argsort(cost, kind="stable")
    allowance = np.zeros(len(counts), np.int8)
    chosen = order[:needed]
    allowance[chosen] = 1
    doubles = [s for s in range(min(deletable, len(counts))) if allowance[s] == 1]
    doubles.sort(key=lambda s: cost[s] + counts[s])
    for worst, double in zip(chosen[::-1].tolist(), doubles):
        if worst == double or allowance[worst] != 1 or cost[worst] <= counts[double] + 2 + _COST[min(max(int(counts[double]) - 1, 0), 8)]:
            break
        allowance[worst], allowance[double] = 0, 2
    return allowance


def signatures(shingles: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, role bits) of one set; shingles are sorted, so a segment is a run of them."""
    n, params = len(shingles), bands.params
    if n < bands.least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    own = bands.of(n)
    mixed = mix(shingles)
    running = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
    found, roles = [], []
    for band in ([own, own - 1] if own else [own]):
        m = bands.segments(band)
        segment = ((shingles >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(segment, minlength=m)
        ends = np.cumsum(counts)
        base = mix((np.arange(m, dtype=np.uint64) << np.uint64(20)) + np.uint64(band) + np.uint64(1))
        sums = base + running[ends] - running[ends - counts]
        deletable = -(-m // params.deletion_every)
        near = segment < deletable
        deleted = sums[segment[near]] - mixed[near]
        needed = int(params.difference(n + min(bands.high[band], n))) + 1
        allowance = allot(counts, needed, deletable)
        double = allowance[segment[near]] == 2
        if band == own:
            found += [sums, deleted]
            roles += [np.where(allowance > 0, _INDEXED | _PROBING, _INDEXED), np.where(double, _INDEXED | _PROBING, _INDEXED)]
        else:
            found += [sums[allowance > 0], deleted[double]]
            roles += [np.full(int((allowance > 0).sum()), _PROBING), np.full(int(double.sum()), _PROBING)]
    return mix(np.concatenate(found)), np.concatenate(roles).astype(np.int64)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of ``SKETCH_BITS`` bins: bits in which two sketches differ <= shingles in which the sets do."""
    return np.packbits((np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


# --- signatures that meet -------------------------------------------------------------------------------

_BLOB = "part int, direct boolean, data binary"
_PAIR = np.dtype([("signature", "<u8"), ("member", "<i8"), ("role", "u1")])
#: Signature rows a task holds before it sends them on.
_HELD_ROWS = 400_000


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(values)])


def _meeting(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted table and, per signature: start, whether several sets have it, whether an indexed and a probing one do."""
    table = table[np.lexsort((table["member"], table["signature"]))]
    starts, _ = _runs(table["signature"])
    if not len(starts):
        return table, starts, np.empty(0, bool), np.empty(0, bool)
    either = np.bitwise_or.reduceat(table["role"], starts)
    several = np.maximum.reduceat(table["member"], starts) != np.minimum.reduceat(table["member"], starts)
    return table, starts, several, several & (either == (_INDEXED | _PROBING))


def _signature_blobs(texts: DataFrame, params: JoinParams, parts: int) -> DataFrame:
    """Packed signature rows by part. Rows of a signature that several sets of one lot have are ``direct`` and spread by member; for
    each signature the lot sends one row on by signature, so one of a third of all sets stays small in its part."""

    def parted(table: np.ndarray, key: np.ndarray, direct: bool) -> list[tuple[int, bool, bytes]]:
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        table, part = table[order], part[order]
        return [(int(part[at]), direct, table[at:at + length].tobytes()) for at, length in zip(*_runs(part))]

    def sent(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table, starts, several, _ = _meeting(np.concatenate(tables))
        if not len(starts):
            return
        known = table[np.repeat(several, np.diff(np.r_[starts, len(table)]))]
        # The first row of each signature, with all roles seen there, speaks for the lot.
        heads = table[starts]
        heads["role"] = np.bitwise_or.reduceat(table["role"], starts)
        rows = parted(heads, heads["signature"], False) + parted(known, mix(known["member"].view(np.uint64)), True)
        schema = arrow_schema(_BLOB)
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[at:at + 64]), schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, tables, held = Bands(params), set(), [], 0
        for batch in batches:
            ids = batch.column(0)
            for row in range(batch.num_rows):
                shingles = shingle_set(batch.column(1)[row].as_py(), params.words)
                key = hash(shingles.tobytes())
                if not ids[row].is_valid or key in seen:
                    continue  # an equal set of this task stands for this one
                seen.add(key)
                if len(seen) > 200_000:
                    seen.clear()
                signature, role = signatures(shingles, bands)
                rows = np.empty(len(signature), _PAIR)
                rows["signature"], rows["member"], rows["role"] = signature, ids[row].as_py(), role
                tables.append(rows)
                held += len(rows)
                if held >= _HELD_ROWS:
                    yield from sent(tables)
                    tables, held = [], 0
        if tables:
            yield from sent(tables)
        tables.clear()
        seen.clear()
        give_back()

    return texts.mapInArrow(run, _BLOB)


_MEMBER = "signature long, member long, role int"


def _met(blobs: DataFrame, parts: int) -> DataFrame:
    """(signature, member, role) of signatures that meet or are direct; heads may repeat direct rows."""

    def meet(blob: pa.Table) -> pa.Table:
        tables = ([], [])
        for chunk in blob.to_batches():
            for direct, data in zip(chunk.column("direct").to_pylist(), chunk.column("data")):
                tables[direct].append(np.frombuffer(data.as_buffer(), _PAIR))
        heads, direct = (np.concatenate(t) if t else np.empty(0, _PAIR) for t in tables)
        table, starts, _, meets = _meeting(heads)
        kept = np.concatenate([direct, table[np.repeat(meets, np.diff(np.r_[starts, len(table)]))] if len(starts) else table])
        columns = [kept["signature"].astype(np.uint64).view(np.int64), kept["member"].astype(np.int64), kept["role"].astype(np.int32)]
        del tables, heads, direct, table, starts, meets, kept
        give_back()
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=arrow_schema(_MEMBER))

    return blobs.repartition(parts, "part").groupBy("part").applyInArrow(meet, _MEMBER)


# --- candidates inside buckets --------------------------------------------------------------------------

def _pairs(rows: dict[str, np.ndarray], groups: np.ndarray, params: JoinParams, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (row numbers) inside each group of sorted group numbers.

    With ``forest`` only a spanning forest of the group's candidates, nearest sketches first; otherwise all of them.
    """
    starts, lengths = _runs(groups)
    left, right = [], []

    def test(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = rows["n"][a], rows["n"][b]
        ok = (100 * np.minimum(n, m) >= params.percent * np.maximum(n, m)) & (rows["root"][a] != rows["root"][b])
        ok &= ((rows["role"][a] & 1) & (rows["role"][b] >> 1)) | ((rows["role"][b] & 1) & (rows["role"][a] >> 1)) > 0
        ok &= rows["main"][a] + rows["main"][b] < 2
        apart = np.full(ok.shape, 1 << 30, np.int64)
        if ok.any():
            x, y = np.broadcast_arrays(a, b)
            x, y = x[ok], y[ok]
            apart[ok] = np.concatenate([
                np.bitwise_count(rows["sketch"][x[at:at + _SKETCH_PAIRS]] ^ rows["sketch"][y[at:at + _SKETCH_PAIRS]]).sum(axis=1)
                for at in range(0, len(x), _SKETCH_PAIRS)])
            ok &= apart <= params.difference(n + m)
        return ok, apart

    for size in np.unique(lengths):
        if size < 2:
            continue
        heads = starts[lengths == size]
        if size <= 64:
            i, j = np.triu_indices(size, 1)
            for at in range(0, len(heads), max(1, 400_000 // len(i))):
                a = heads[at:at + max(1, 400_000 // len(i)), None] + i[None, :]
                b = a - i[None, :] + j[None, :]
                ok, apart = test(a, b)
                if not forest or size <= 8:
                    left.append(a[ok])
                    right.append(b[ok])
                else:
                    for row in np.flatnonzero(ok.any(axis=1)):
                        took = _tree(a[row][ok[row]], b[row][ok[row]], apart[row][ok[row]], rows["root"])
                        left.append(took[0])
                        right.append(took[1])
            continue
        for head in heads.tolist():
            members, near = np.arange(head, head + size), []
            for at in range(0, size, 256):
                a, b = members[at:at + 256, None], members[None, at + 1:]
                ok, apart = test(a, b)
                ok &= a < b
                x, y = np.nonzero(ok)
                near.append((members[at + x], members[at + 1 + y], apart[ok]))
            found = [np.concatenate(c) for c in zip(*near)]
            took = _tree(*found, rows["root"]) if forest else found[:2]
            left.append(took[0])
            right.append(took[1])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _tree(a: np.ndarray, b: np.ndarray, apart: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of candidate pairs between roots, smallest distance first: every tree takes its nearest pair, again and again."""
    order = np.lexsort((b, a, apart))
    a, b = a[order], b[order]
    names, ends = np.unique(np.r_[root[a], root[b]], return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label, alive, kept = np.arange(len(names)), np.arange(len(a)), []
    while True:
        alive = alive[label[x[alive]] != label[y[alive]]]
        if not len(alive):
            break
        _, first = np.unique(np.r_[label[x[alive]], label[y[alive]]], return_index=True)
        chosen = alive[np.unique(first % len(alive))]
        up = {}

        def top(k: int) -> int:
            while up.get(k, k) != k:
                up[k] = up.get(up[k], up[k])
                k = up[k]
            return k

        for k, p, q in zip(chosen.tolist(), label[x[chosen]].tolist(), label[y[chosen]].tolist()):
            p, q = top(p), top(q)
            if p != q:
                up[q] = p
                kept.append(k)
        label = np.array([top(k) for k in label.tolist()])
    return a[kept], b[kept]


_CANDIDATE = "a long, b long"


def _candidates(buckets: DataFrame, params: JoinParams, forest: bool) -> DataFrame:
    """Candidate pairs of (signature, unit, member, role, n, root, sketch, main), grouped by signature and unit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_CANDIDATE)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held)
            column = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("signature", "unit", "member", "role", "n", "root", "main")}
            changed = (np.diff(column["signature"]) != 0) | (np.diff(column["unit"]) != 0)
            group = np.r_[0, np.cumsum(changed)]
            # The last group may go on in the next batch.
            stop = len(group) if last else int(np.searchsorted(group, group[-1]))
            if stop:
                sketch = np.frombuffer(b"".join(table["sketch"].slice(0, stop).to_pylist()), np.uint64).reshape(stop, SKETCH_BITS // 64)
                rows = {c: column[c][:stop].astype(np.int64) for c in ("role", "n", "root", "main")} | {"sketch": sketch}
                x, y = _pairs(rows, group[:stop], params, forest)
                member = column["member"]
                pairs = np.unique(np.stack([np.minimum(member[x], member[y]), np.maximum(member[x], member[y])]), axis=1)
                for at in range(0, pairs.shape[1], 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0, at:at + 100_000]), pa.array(pairs[1, at:at + 100_000])], schema=schema)
            rest = table.slice(stop)
            held, size = rest.to_batches() if rest.num_rows else [], rest.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= 100_000:
                    yield from flush(False)
        if held:
            yield from flush(True)
        held = []
        give_back()

    sorted_ = buckets.select("signature", "unit", "member", "role", "n", "root", "sketch", "main").repartition("signature", "unit").sortWithinPartitions("signature", "unit", "member")
    return sorted_.mapInArrow(run, _CANDIDATE).distinct()


def _open(members: DataFrame) -> DataFrame:
    """Signatures that sets of different roots have, an indexed and a probing one among them."""
    shape = members.groupBy("signature").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.bit_or("role").alias("r"),
        F.bit_xor(F.xxhash64("member", "role")).alias("d"), F.bit_xor(F.xxhash64(F.lit(1), "member", "role")).alias("e"))
    return shape.where(f"x <> y and r = {_INDEXED | _PROBING}").select("signature", "d", "e")


def _distinct_buckets(members: DataFrame) -> DataFrame:
    """Open buckets, one of those with the same members in the same roles.

    Near copies share most of their signatures, and each of them would give the same candidates again. Buckets are compared by
    two 64-bit hashes of all (member, role).
    """
    one = _open(members).groupBy("d", "e").agg(F.min("signature").alias("signature")).select("signature")
    return members.join(one, "signature", "left_semi")


def _open_buckets(members: DataFrame, root_of: DataFrame | None) -> DataFrame:
    """Members with their roots, without signatures that hold a single root."""
    if root_of is None:
        return members
    members = members.drop("root").join(root_of.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    return members.join(_open(members).select("signature"), "signature", "left_semi")


def _chunked(buckets: DataFrame) -> DataFrame:
    """Large buckets are cut at random into chunks, each compared within itself."""
    sizes = buckets.groupBy("signature").count().where(F.col("count") > CHUNK)
    return buckets.join(sizes, "signature", "left").withColumn(
        "unit", F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("member"), F.ceil(F.col("count") / CHUNK))).cast("long")
    ).withColumn("main", F.lit(0))


def _crossed(buckets: DataFrame) -> DataFrame:
    """Units that hold every pair of a bucket's rows from different roots once or more.

    The rows of a bucket's largest root (``main``) need no comparison with each other: they are cut into
    chunks, and each chunk meets every chunk of the others. The others also meet among themselves.
    """
    by_root = buckets.groupBy("signature", "root").count()
    shape = by_root.groupBy("signature").agg(F.sum("count").alias("all"), F.max("count").alias("most"), F.max_by("root", "count").alias("main_root"))
    shape = shape.where(F.col("all") > CHUNK).select(
        "signature", "main_root", F.ceil(F.col("most") / CHUNK).alias("mains"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / CHUNK)).alias("others"))
    rows = buckets.join(shape, "signature", "left")
    small = rows.where("main_root is null").select("signature", "member", "role", "n", "root", "sketch", F.lit(0).alias("unit"), F.lit(0).alias("main"))
    large = rows.where("main_root is not null").withColumn("main", (F.col("root") == F.col("main_root")).cast("int"))
    own = F.pmod(F.xxhash64("member"), F.when(F.col("main") == 1, F.col("mains")).otherwise(F.col("others")))
    mains, others = F.col("mains"), F.col("others")
    with_mains = F.transform(F.sequence(F.lit(0), others - 1), lambda a: a * mains + own)
    as_other = F.concat(
        F.transform(F.sequence(F.lit(0), mains - 1), lambda u: own * mains + u),
        F.transform(F.sequence(F.lit(0), others - 1), lambda b: others * mains + F.least(own, b) * others + F.greatest(own, b)))
    units = F.when(F.col("main") == 1, with_mains).otherwise(as_other)
    spread = large.select("signature", "member", "role", "n", "root", "sketch", F.explode(units).alias("unit"), "main")
    return small.unionByName(spread.select(small.columns))


# --- verification and the whole -------------------------------------------------------------------------

def _verified(pairs: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs that link, decided on the whole texts."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    needed = materialise(texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    one = needed.withColumnsRenamed({"doc_id": "a", "text": "text_a"})
    two = needed.withColumnsRenamed({"doc_id": "b", "text": "text_b"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last, x = arrow_schema(_CANDIDATE), None, None
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for start, texts in slices(batch, "text_a"):
                for k, text in enumerate(texts, start):
                    # Pairs come sorted by their first text, or nearly so.
                    if text != last:
                        last, x = text, shingle_set(text, params.words)
                    y = shingle_set(batch.column("text_b")[k].as_py(), params.words)
                    linked[k] = params.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))
            yield batch.select(["a", "b"]).filter(pa.array(linked)).cast(schema)
        give_back()

    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, _CANDIDATE)


def near_groups(df: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id.

    Defined cases: null and blank texts have no shingles and are their own component; with fewer words than a shingle the whole
    sequence is one shingle; repeated rows and equal sets are linked; rows with a null doc_id are counted but linked with nothing (their
    component is null); rows that share a doc_id share its component, their texts should be equal; other columns are
    ignored; an empty table gives an empty table.
    """
    import hashlib

    texts = id_and_text(df, id_col, text_col)

    ddl = "doc_id long, n long, sketch binary, key binary"

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in slices(batch):
                sets = [shingle_set(t, params.words) for t in rows]
                found = [[len(s) for s in sets], [parity_sketch(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]]
                columns = [pa.array(f, kind) for f, kind in zip(found, (pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(rows)), *columns], schema=arrow_schema(ddl))
        give_back()

    with batch_rows(df.sparkSession, TEXT_ROWS):
        light = materialise(texts.mapInArrow(weigh, ddl))
    linkable = light.where("doc_id is not null and n > 0")
    first = linkable.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    again = materialise(first.where("copies > 1").select("key", "first"))
    sets = materialise(
        linkable.join(again, "key", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"), "n", "sketch").dropDuplicates(["doc_id"]))

    tokens = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-tokens // 2_000_000))  # about 0.4 signatures a shingle: under a million rows of 24 bytes a part
    met = _met(_signature_blobs(texts, params, parts), parts)
    about = sets.where("doc_id = first").select(F.col("doc_id").alias("member"), "n", "sketch")
    members = (
        met.join(sets.select(F.col("doc_id").alias("member"), "first"), "member")
        .groupBy("signature", F.col("first").alias("member")).agg(F.bit_or("role").alias("role")).withColumn("root", F.col("member"))
    )
    with batch_rows(df.sparkSession, TEXT_ROWS):
        members = materialise(_distinct_buckets(members).join(about, "member").select("signature", "member", "role", "root", "n", "sketch"))

    links, root_of, tried = None, None, None
    for turn in range(3):
        last = turn == 2
        buckets = _open_buckets(members, root_of)
        pairs = materialise(_candidates(_crossed(buckets) if last else _chunked(buckets), params, not last))
        if tried is not None:
            pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        with batch_rows(texts.sparkSession, TEXT_ROWS):
            found = materialise(_verified(pairs, texts, params))
        links = found if links is None else links.unionByName(found)
        root_of = materialise(components(links))
        tried = pairs if tried is None else tried.unionByName(pairs)
    rooted = sets.select("doc_id", "first")
    if root_of is not None:
        rooted = rooted.join(root_of.withColumnRenamed("node", "first"), "first", "left").select("doc_id", F.coalesce("root", "first").alias("first"))
    return light.select("doc_id", F.col("n").alias("n_shingles")).join(rooted.withColumnRenamed("first", "component_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_each(df: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's smallest, all columns; rows without an id all stay."""
    gone = near_groups(df, params, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return df.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
