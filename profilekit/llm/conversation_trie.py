"""A prefix trie of conversations, its subtree totals by time-forward processing.

Conversation ``c`` is rebuilt from the first ``h`` turns of the conversation that opens its block of 100 and its own turns
after its first ``h``. A node of depth ``d`` is a distinct sequence of first ``d`` turns. Sequences are told apart by the
exclusive-or of a 128-bit hash per (place, role, text), which can be carried along a conversation that is spread over many tasks.

Totals go up the trie as in external memory: nodes are sorted by falling depth, and a node, when its turn comes, takes
what its children sent from a priority queue and sends the sum on to its parent's place in the order. The queue
spills sorted runs. That happens

* within shards: a *light* node has at most ``shard_rows`` rebuilt turns below it. Maximal light subtrees are dealt to shards whole, so
  all their links stay inside;
* then across shard roots: *heavy* nodes (few per level: their subtrees on one level do not overlap) receive what the roots of light subtrees
  send, added up per parent first. Up to ``band_nodes`` of them are one shard. More are cut into bands of
  ``band_levels`` levels: each band is added up by itself, the roots of the bands form a smaller tree of the same kind,
  and a last pass gives every band what reaches it from below. A conversation with a third of all turns is thus many shards.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.spread import carried, placed, spread_join
from profilekit.session import materialise, scratch_path

#: Turns taken over from the conversation that opens the block, at most; and conversations in a block.
HEAD_TURNS, BLOCK = 6, 100
#: Ids in one piece of the comma-joined list that is hashed.
PIECE_IDS = 256
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieParams:
    """Rebuilt turns below a light node, heavy nodes in one shard, levels in a band, messages a queue holds in memory."""

    shard_rows: int = 1 << 18
    band_nodes: int = 1 << 20
    band_levels: int = 64
    queue_items: int = 1 << 18


# --- rebuilt conversations ----------------------------------------------------------------------------------

def _runs(keys: np.ndarray, last: int | None) -> tuple[np.ndarray, bool]:
    """Starts of runs of equal keys in a batch, and whether the first goes on from the batch before."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, last is not None and int(keys[0]) == last


_TURN_DDL = "conv_id long, va long, vb long, points long, step long, part int"
_STEP_DDL = "conv_id long, d long, ta long, tb long, points long, length long, step long, sa long, sb long, part int"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``step``: the place of a row in its conversation, within this partition."""
    last, at, schema = None, 0, _schema(_TURN_DDL)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("conv_id").to_numpy()
        starts, goes_on = _runs(keys, last)
        sizes = np.diff(np.r_[starts, len(keys)])
        step = np.arange(len(keys)) - np.repeat(starts, sizes) + 1
        if goes_on:
            step[:sizes[0]] += at
        last, at = int(keys[-1]), int(step[-1])
        yield pa.RecordBatch.from_pydict(
            {**{n: batch.column(n) for n in ("conv_id", "va", "vb", "points", "part")}, "step": pa.array(step, pa.int64())}, schema=schema)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``sa`` and ``sb``: the exclusive-or of the terms of a conversation so far, within this partition."""
    last, held, at, schema = None, [0, 0], 0, _schema(_STEP_DDL)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("conv_id").to_numpy()
        starts, goes_on = _runs(keys, last)
        sizes = np.diff(np.r_[starts, len(keys)])
        sums = []
        for lane, name in enumerate(("ta", "tb")):
            folded = np.bitwise_xor.accumulate(batch.column(name).to_numpy())
            before = np.r_[np.int64(0), folded[starts[1:] - 1]]
            if goes_on:
                before[0] ^= held[lane]
            sums.append(folded ^ np.repeat(before, sizes))
        step = np.arange(len(keys)) - np.repeat(starts, sizes) + 1
        if goes_on:
            step[:sizes[0]] += at
        last, held, at = int(keys[-1]), [int(s[-1]) for s in sums], int(step[-1])
        columns = {n: batch.column(n) for n in ("conv_id", "d", "ta", "tb", "points", "length", "part")}
        yield pa.RecordBatch.from_pydict({**columns, "step": step.astype(np.int64), "sa": sums[0], "sb": sums[1]}, schema=schema)


def _with_carry(table: DataFrame, totals: list[str], add) -> DataFrame:
    """``table`` with carry_<total> of what earlier parts hold of the same conversation, 0 without any."""
    carries = carried(table, "conv_id", totals, add)
    names = [f"carry_{t}" for t in totals]
    if carries is None:
        return table.select("*", *[F.lit(0).cast("long").alias(n) for n in names])
    # One row a part at most.
    return table.join(F.broadcast(carries), ["part", "conv_id"], "left").fillna(0, names)


def rebuilt_members(conversations: DataFrame, partitions: int) -> DataFrame:
    """(conv_id, d, a, b, pa, pb, points, length): every rebuilt conversation at every depth, its node (a, b) and parent (pa, pb)."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"),
        F.xxhash64(F.lit(1), role, key).alias("va"), F.xxhash64(F.lit(2), role, key).alias("vb"), F.length(text).cast("long").alias("points"))
    numbered = placed(rows, ["conv_id", "turn", "role", "key"], partitions, _number, _TURN_DDL)
    turns = materialise(
        _with_carry(numbered, ["step"], lambda x, y: (x[0] + y[0],))
        .select("conv_id", (F.col("step") + F.col("carry_step")).alias("pos"), "va", "vb", "points"))

    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    sizes = materialise(turns.groupBy("conv_id").count().select(
        "conv_id", "count", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).alias("h")))
    # A block has at most 199 conversations, so no key of this join is hot.
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("count").alias("n_base"))
    convs = materialise(
        sizes.join(of_base, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
        .select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("count") - F.col("h"), F.lit(0))).alias("length")))

    own = spread_join(turns, convs.drop("base"), ["conv_id"]).where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "va", "vb", "points", "length")
    head = turns.where(F.col("pos") < HEAD_TURNS).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "va", "vb", "points")
    taken = (
        convs.where("k > 0").select("conv_id", "base", "length", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("d"))
        .join(head, ["base", "d"]).select("conv_id", "d", "va", "vb", "points", "length"))
    steps = own.unionByName(taken).select(
        "conv_id", "d", F.xxhash64(F.lit(3), "d", "va", "vb").alias("ta"), F.xxhash64(F.lit(4), "d", "va", "vb").alias("tb"), "points", "length")
    folded = _with_carry(
        placed(steps, ["conv_id", "d"], partitions, _fold, _STEP_DDL), ["sa", "sb"], lambda x, y: (x[0] ^ y[0], x[1] ^ y[1]))
    a, b = F.col("sa").bitwiseXOR(F.col("carry_sa")), F.col("sb").bitwiseXOR(F.col("carry_sb"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *[zero.alias(n) for n in ("d", "a", "b", "pa", "pb", "points")], "length")
    return materialise(roots.unionByName(folded.select(
        "conv_id", "d", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ta")).alias("pa"), b.bitwiseXOR(F.col("tb")).alias("pb"), "points", "length")))


# --- time-forward processing --------------------------------------------------------------------------------

class SpillingQueue:
    """A priority queue of (depth falling, conv_id, children, leaves, saved); beyond ``limit`` items it writes sorted runs.

    Runs go to the shared scratch folder and are read back in pieces. Items of one key are added up when they are
    written. Where Python cannot write to that folder, items stay in memory, which the size of a shard bounds.
    """

    PIECE, MOST_RUNS = 4_096, 32

    def __init__(self, limit: int, folder: str | None):
        self.limit, self.folder, self.items, self.runs, self.spilled = max(1, limit), folder, [], [], 0

    def push(self, depth: int, conv_id: int, children: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.items, (-depth, conv_id, children, leaves, saved))
        if len(self.items) > self.limit and self.folder:
            self._spill()

    def take(self, depth: int, conv_id: int) -> tuple[int, int, int]:
        """Sums of everything sent to this node; nothing earlier may be left."""
        key, sums = (-depth, conv_id), [0, 0, 0]
        while self.items and self.items[0][:2] <= key:
            self._add(sums, heapq.heappop(self.items), key)
        while self.runs and self.runs[0][0][:2] <= key:
            item, rest = self.runs[0]
            self._add(sums, item, key)
            following = next(rest, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, rest))
        return tuple(sums)

    def empty(self) -> bool:
        return not self.items and not self.runs

    @staticmethod
    def _add(sums: list[int], item: tuple, key: tuple) -> None:
        if item[:2] != key:
            raise ValueError(f"a message for {item[:2]} was left when {key} came")
        for i in range(3):
            sums[i] += item[2 + i]

    def _spill(self) -> None:
        items, self.items = sorted(self.items), []
        # Another run first takes up the earlier ones when there are many of them.
        sources = [iter(items)]
        if len(self.runs) >= self.MOST_RUNS:
            sources += [self._whole(*run) for run in self.runs]
            self.runs = []
        run = self._read(self._write(_added_up(heapq.merge(*sources))))
        first = next(run, None)
        if first is not None:
            heapq.heappush(self.runs, (first, _Rest(run)))

    @staticmethod
    def _whole(first: tuple, rest: Iterator) -> Iterator[tuple]:
        yield first
        yield from rest

    def _write(self, items: Iterator[tuple]) -> str:
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with open(path, "wb") as file:
            piece = []
            for item in items:
                piece.append(item)
                if len(piece) == self.PIECE:
                    np.array(piece, np.int64).tofile(file)
                    piece = []
            np.array(piece, np.int64).tofile(file)
        self.spilled += 1
        return path

    def _read(self, path: str) -> Iterator[tuple]:
        with open(path, "rb") as file:
            os.unlink(path)  # goes when the file is closed, however the task ends
            while True:
                piece = np.fromfile(file, np.int64, 5 * self.PIECE)
                if not len(piece):
                    return
                yield from map(tuple, piece.reshape(-1, 5).tolist())


class _Rest:
    """An iterator that never decides the order of two runs."""

    def __init__(self, items: Iterator[tuple]):
        self.items = items

    def __iter__(self):
        return self

    def __next__(self):
        return next(self.items)

    def __lt__(self, other):
        return False


def _added_up(items: Iterator[tuple]) -> Iterator[tuple]:
    held = None
    for item in items:
        if held is not None and held[:2] == item[:2]:
            held = (*held[:2], *(x + y for x, y in zip(held[2:], item[2:])))
        else:
            if held is not None:
                yield held
            held = item
    if held is not None:
        yield held


_WALK_DDL = "shard int, depth long, conv_id long, kind int, parent_conv_id long, linked boolean, children long, leaves long, saved long"
_DONE_DDL = "conv_id long, depth long, parent_conv_id long, linked boolean, n_children long, n_leaves long, saved_tokens long"


def local_folder(spark) -> str | None:
    """A new folder below the shared checkpoint folder as a path Python can open; None where that folder is in another store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "queue"))
    mounted = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    return path.toUri().getPath() if mounted else None


def forward(rows: DataFrame, shards: int, params: TrieParams) -> DataFrame:
    """Nodes (kind 1) with their totals; ``rows`` also hold messages (kind 0) from other shards, summed per node.

    A node without ``leaves`` counts as a leaf if nobody sends to it. A linked node sends to its parent in the same shard;
    others end their shard. Every shard is one sorted stream, of which only the queue is held.
    """
    limit, folder, schema = params.queue_items, local_folder(rows.sparkSession), _schema(_DONE_DDL)
    fields = [field.split()[0] for field in _WALK_DDL.split(",")]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, None
        for batch in batches:
            done = []
            for at, depth, conv_id, kind, parent, linked, children, leaves, saved in zip(*(batch.column(n).to_pylist() for n in fields)):
                if at != shard:
                    if queue is not None and not queue.empty():
                        raise ValueError("messages were left at the end of a shard")
                    shard, queue = at, SpillingQueue(limit, folder)
                if kind == 0:
                    queue.push(depth, conv_id, children, leaves, saved)
                    continue
                sent = queue.take(depth, conv_id)
                n_leaves = sent[1] + (leaves if leaves is not None else int(sent[0] == 0))
                total = saved + sent[2]
                if linked:
                    queue.push(depth - 1, parent, 1, n_leaves, total)
                done.append((conv_id, depth, parent, linked, sent[0], n_leaves, total))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if queue is not None and not queue.empty():
            raise ValueError("messages were left at the end of a shard")

    dealt = rows.select(*fields).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.desc("depth"), "conv_id", "kind")
    return dealt.mapInArrow(walk, _DONE_DDL)


def _letters(done: DataFrame, leaves=None, saved=None) -> DataFrame:
    """What roots of shards send to their parents, added up per parent."""
    return (
        done.where("NOT linked AND depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))
        .agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves" if leaves is None else leaves).alias("leaves"),
             F.sum("saved_tokens" if saved is None else saved).alias("saved")))


def _stream(nodes: DataFrame, letters: list[DataFrame], shard) -> DataFrame:
    """Nodes and letters as one set of rows; ``shard`` is an expression on the depth for both."""
    mail = [
        x.select("depth", "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(False).alias("linked"),
                 "children", "leaves", "saved") for x in letters]
    rows = nodes.select("depth", "conv_id", F.lit(1).alias("kind"), "parent_conv_id", "linked", F.lit(0).cast("long").alias("children"), "leaves", "saved")
    for part in mail:
        rows = rows.unionByName(part)
    return rows.withColumn("shard", shard)


def across(nodes: DataFrame, letters: list[DataFrame], ancestors, params: TrieParams, scale: int = 1) -> DataFrame:
    """Totals of heavy ``nodes`` (conv_id, depth, parent_conv_id, leaves, saved) with what ``letters`` bring from light ones.

    ``ancestors(rows, levels)`` gives rows the conv_id of the node so many levels of the trie above; ``scale`` is how many
    levels of the trie one level of ``nodes`` stands for.
    """
    count = nodes.count()
    if count <= params.band_nodes:
        return forward(_stream(nodes.withColumn("linked", F.col("depth") > 0), letters, F.lit(0)), 1, params)
    levels = max(2, params.band_levels)
    bands = -(-count // params.band_nodes)
    shard = F.pmod(F.floor(F.col("depth") / levels), F.lit(bands)).cast("int")
    banded = materialise(nodes.withColumn("linked", F.col("depth") % levels != 0))
    nothing = F.lit(0).cast("long")
    roots_only = banded.where("NOT linked AND depth > 0").withColumns({"n_leaves": nothing, "saved_tokens": nothing})
    alone = materialise(forward(_stream(banded, [*letters, materialise(_letters(roots_only))], shard), bands, params).where("NOT linked"))
    smaller = ancestors(alone, levels * scale, scale).select(
        "conv_id", (F.col("depth") / levels).cast("long").alias("depth"), F.col("above").alias("parent_conv_id"),
        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    ends = across(materialise(smaller), [], ancestors, params, scale * levels).select(
        "conv_id", (F.col("depth") * levels).alias("depth"), F.col("n_leaves").alias("whole_leaves"), F.col("saved_tokens").alias("whole_saved"))
    final = _letters(alone.join(materialise(ends), ["conv_id", "depth"]), "whole_leaves", "whole_saved")
    return forward(_stream(banded, [*letters, materialise(final)], shard), bands, params)


# --- the trie -----------------------------------------------------------------------------------------------

def _ends(members: DataFrame, partitions: int) -> DataFrame:
    """(d, a, b, ends_sha256) of nodes at which conversations end: their ids in order, hashed as a stream."""
    piece_ddl = "d long, a long, b long, first long, piece string, part int"

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, node, ids, part = _schema(piece_ddl), None, [], 0
        for batch in batches:
            out = []
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for d, a, b, conv_id in zip(*(batch.column(n).to_pylist() for n in ("d", "a", "b", "conv_id"))):
                if (d, a, b) != node or len(ids) == PIECE_IDS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids)), part))
                    node, ids = (d, a, b), []
                ids.append(conv_id)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, ids[0], ",".join(map(str, ids)), part), schema)], schema=schema)

    done_ddl = "d long, a long, b long, ends_sha256 string"

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, node, state = _schema(done_ddl), None, None
        for batch in batches:
            out = []
            for d, a, b, piece in zip(*(batch.column(n).to_pylist() for n in ("d", "a", "b", "piece"))):
                if (d, a, b) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, a, b), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), schema)], schema=schema)

    ended = members.where("d = length").select("d", "a", "b", "conv_id")
    pieces = placed(ended, ["d", "a", "b", "conv_id"], partitions, join, piece_ddl)
    return pieces.repartition(partitions, "d", "a", "b").sortWithinPartitions("d", "a", "b", "first").mapInArrow(digest, done_ddl)


def prefix_trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Totals cover the subtree with its top: childless nodes, and (members - 1) times the code points of the last text.
    Defined cases: null roles and texts are empty; null turns come first; the remainder by 100 has the sign of the id; rows of equal turn go by role, then by the SHA-256 of
    the text; repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; conversations that
    lose all turns are members of the root and end there; other columns are ignored; an empty table gives an empty table.
    """
    spark = conversations.sparkSession
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = rebuilt_members(conversations, partitions)
    rows = members.count()
    node = ["d", "a", "b"]
    nodes = materialise(members.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") - F.col("d") + 1).alias("weight"),
        F.max("points").alias("points"), F.max("pa").alias("pa"), F.max("pb").alias("pb")))

    parents = nodes.select(F.col("d").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    children = materialise(nodes.where("d > 0").withColumn("pd", F.col("d") - 1))
    linked = spread_join(children, parents, ["pd", "pa", "pb"]).select(*nodes.columns, "parent_conv_id")
    tree = materialise(linked.unionByName(nodes.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "a", "b", (F.col("weight") > params.shard_rows).alias("heavy"),
        F.lit(None).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved")))
    heavy = materialise(nodes.where(F.col("weight") > params.shard_rows).select(*node, F.col("conv_id").alias("above")))

    # The top of the light subtree that a conversation ends in: its first row that is not a heavy node's.
    tops = (
        spread_join(members, heavy.select(*node), node, "left_anti", nodes.select(*node, F.col("n_convs").alias("count"))).groupBy("conv_id").agg(F.min(F.struct(*node)).alias("top")))
    shards = max(1, -(-rows // params.shard_rows))
    light = (
        tree.where("NOT heavy").join(tops, "conv_id")
        .select("conv_id", "depth", "parent_conv_id", "leaves", "saved", (F.col("depth") > F.col("top.d")).alias("linked"),
                F.pmod(F.xxhash64("top"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("children")))
    done = materialise(forward(light, shards, params))

    if not heavy.isEmpty():
        def ancestors(found: DataFrame, levels: int, scale: int) -> DataFrame:
            up = found.withColumn("d", F.col("depth") * scale - levels)
            at = members.select("conv_id", *node).join(up.where("d >= 0"), ["conv_id", "d"])
            return materialise(
                spread_join(materialise(at), heavy, node).select(*found.columns, "above")
                .unionByName(up.where("d < 0").select(*found.columns, F.lit(None).cast("long").alias("above"))))

        upper = across(
            materialise(tree.where("heavy").select("conv_id", "depth", "parent_conv_id", "leaves", "saved")), [materialise(_letters(done))], ancestors, params)
        done = done.unionByName(materialise(upper))

    totals = done.select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens")
    return (
        tree.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("a"), F.col("b")).join(totals, ["conv_id", "depth"])
        .join(_ends(members, partitions).withColumnRenamed("d", "depth"), ["depth", "a", "b"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))
