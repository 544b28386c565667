"""Density clustering on a nearest-neighbour graph, its hierarchy taken whole.

Edges between the k nearest neighbours are weighted by mutual reachability. Rows deep inside a cluster have all their neighbours there, so
the graph alone would join clusters only by way of the rows between them; the lightest edges between clusters are therefore looked for and added
(:func:`bridges`). That this graph stands for all pairs is the one declared approximation. The rest is exact single linkage:

* a minimum spanning forest by Boruvka rounds in Spark (every component takes its lightest edge, components
  contract); once few enough edges are left, the last part is one task;
* the merge tree is read bottom up. Forest edges are cut by weight into levels of bounded size, each level joins the components of the level
  below, and within a level every connected group of edges is a task of its own, which merges in order of weight.

A merge of two components that both have the minimum size ends two clusters, unless they ended before. A smaller component joins
the cluster of the larger one it meets, or is noise where clusters have already met there.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import NOISE
from profilekit.functions.vector import to_matrix, unit
from profilekit.operators.between import lightest_between
from profilekit.operators.boxes import BLOCK_ROWS, in_cells, learn_tree
from profilekit.operators.nearest import nearest
from profilekit.operators.relational import number_rows
from profilekit.session import materialise

#: Edges that one task takes in the last part of the forest, and on average in a level of the merge tree.
TASK_EDGES = 1_000_000
#: With no more rows than that all are compared with all when bridges are looked for; more are searched by boxes.
BRIDGE_ROWS = 16_384


def euclidean_neighbours(df: DataFrame, id_col: str, vector: str, k: int, **kwargs) -> DataFrame:
    """k nearest rows by Euclidean distance: ``(src, dst, distance, rank)``.

    On vectors extended to one common length, inner product and distance order
    rows the same way: v -> (v, sqrt(R^2 - |v|^2)) / R with R the longest norm.
    """
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x * x)
    longest = df.agg(F.max(squares)).first()[0] or 1.0
    lifted = df.select(
        F.col(id_col).alias("item_id"),
        unit(F.concat(F.col(vector), F.array(F.sqrt(F.greatest(F.lit(longest) - squares, F.lit(0.0)))))).alias("item_vec"),
    )
    asked = lifted.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"})
    pairs = nearest(asked, lifted, k, **kwargs)
    return pairs.select(
        F.col("query_id").alias("src"),
        F.col("item_id").alias("dst"),
        F.sqrt(F.greatest(2 * F.lit(longest) * (1 - F.col("score")), F.lit(0.0))).alias("distance"),
        "rank",
    )


def reachability_edges(neighbours: DataFrame, min_samples: int) -> DataFrame:
    """Undirected edges weighted by mutual reachability: the larger of both core distances and the distance."""
    core = neighbours.filter(F.col("rank") == min_samples).select(F.col("src").alias("node"), F.col("distance").alias("core"))
    a = core.withColumnsRenamed({"node": "src", "core": "core_src"})
    b = core.withColumnsRenamed({"node": "dst", "core": "core_dst"})
    reach = neighbours.join(a, "src").join(b, "dst").withColumn("w", F.greatest("distance", "core_src", "core_dst"))
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return reach.select(low.alias("a"), high.alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components ``(node, root)``, the root being the smallest id.

    Hook every node to its smallest neighbour, follow the pointers,
    contract, repeat. Pointers only go to smaller ids, so following them ends at a
    root, and the rounds stop when no edge is left.
    """
    left = edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct()
    root = nodes.select("node", F.col("node").alias("root"))
    while True:
        left = materialise(left)
        if left.limit(1).count() == 0:
            return root
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("up")
        )
        hooks = _follow(materialise(hooks))
        step = hooks.select(F.col("node").alias("root"), "up")
        root = materialise(
            root.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        )
        ends_a = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        ends_b = hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = (
            left.join(ends_a, "a").join(ends_b, "b")
            .filter(F.col("ua") != F.col("ub"))
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )


def _follow(hooks: DataFrame) -> DataFrame:
    """Replace every pointer by the end of its chain (path doubling)."""
    while True:
        up = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = materialise(
            hooks.join(up, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.coalesce("next", "up") != F.col("up")).alias("moved"))
        )
        hooks = jumped.select("node", "up")
        if jumped.filter("moved").limit(1).count() == 0:
            return hooks


def _lightest(edges: DataFrame) -> DataFrame:
    """Per component its lightest edge, ties by the edge's own ends: ``(node, up, w, a, b)``."""
    each = edges.select(F.col("ca").alias("node"), F.struct("w", "a", "b", F.col("cb").alias("up")).alias("e")).unionByName(
        edges.select(F.col("cb").alias("node"), F.struct("w", "a", "b", F.col("ca").alias("up")).alias("e")))
    return each.groupBy("node").agg(F.min("e").alias("e")).select("node", "e.up", "e.w", "e.a", "e.b")


class _Sets:
    """Union-find over any hashable names."""

    def __init__(self):
        self.up = {}

    def top(self, x):
        path = []
        while self.up.setdefault(x, x) != x:
            path.append(x)
            x = self.up[x]
        for p in path:
            self.up[p] = x
        return x

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[y] = x
        return x != y


def minimum_spanning_forest(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """The edges ``(a, b, w)`` of the minimum spanning forest; of equal weights the smaller (a, b) comes first."""
    left = materialise(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b").filter(F.col("a") != F.col("b")))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select("a", "b", "w").schema.fields)
    taken: list[DataFrame] = []
    while left.count() > task_edges:
        best = materialise(_lightest(left))
        taken.append(best.select("a", "b", "w").distinct())
        # Lightest edges form trees with one pair each that chose each other; its smaller end is the root.
        back = best.select(F.col("node").alias("up"), F.col("up").alias("back"))
        rooted = best.join(back, "up").select(
            "node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"))
        top = _follow(materialise(rooted))
        left = materialise(_mapped(left, top).filter(F.col("ca") != F.col("cb")))

    def kruskal(frame):
        sets = _Sets()
        frame = frame.sort_values(["w", "a", "b"])
        return frame.loc[[sets.join(x, y) for x, y in zip(frame["ca"], frame["cb"])], ["a", "b", "w"]]

    # At most ``task_edges`` rows: one group on purpose.
    rest = left.withColumn("group", F.lit(0)).groupBy("group").applyInPandas(kruskal, ddl)
    for part in taken:
        rest = rest.unionByName(part)
    return materialise(rest)


def _mapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges`` with ca and cb replaced by what ``mapping`` (node, up) says of them."""
    ends_a = mapping.select(F.col("node").alias("ca"), F.col("up").alias("ua"))
    ends_b = mapping.select(F.col("node").alias("cb"), F.col("up").alias("ub"))
    return (
        edges.join(ends_a, "ca", "left").join(ends_b, "cb", "left")
        .withColumns({"ca": F.coalesce("ua", "ca"), "cb": F.coalesce("ub", "cb")}).drop("ua", "ub"))


def _levelled(forest: DataFrame, task_edges: int) -> tuple[DataFrame, int]:
    """``forest`` with ``level`` and ``sub``, its order among equal weights, and the number of levels.

    Levels are weight ranges of about ``task_edges`` edges; a weight that more edges share is several levels of its own.
    """
    total = forest.count()
    wanted = math.ceil(total / task_edges) if total else 0
    if wanted <= 1:
        return forest.withColumns({"sub": F.lit(0), "level": F.lit(0)}), min(wanted, 1)
    share = [i / wanted for i in range(1, wanted)]
    cuts = sorted(set(forest.agg(F.percentile_approx("w", share, max(10_000, 10 * wanted))).first()[0]))
    # A weight of which more than a level's edges exist is named by a cut; there are no more such weights than cuts.
    heavy = [(r["w"], math.ceil(r["count"] / task_edges)) for r in forest.filter(F.col("w").isin(cuts)).groupBy("w").count().collect()]
    parts = F.broadcast(forest.sparkSession.createDataFrame(heavy, "w double, parts int"))
    below = sum((F.col("w") > F.lit(c)).cast("int") for c in cuts)
    named = forest.join(parts, "w", "left").withColumns({
        "sub": F.when(F.col("parts") > 1, F.pmod(F.xxhash64("a", "b"), F.col("parts"))).otherwise(0).cast("int"), "range": below})
    places = sorted((r["range"], r["w"], r["sub"]) for r in named.groupBy(
        "range", F.when(F.col("parts") > 1, F.col("w")).otherwise(F.lit(-1.0)).alias("w"), "sub").count().collect())
    numbers = F.broadcast(forest.sparkSession.createDataFrame([(*p, i) for i, p in enumerate(places)], "range int, heavy double, sub int, level int"))
    levelled = named.withColumn("heavy", F.when(F.col("parts") > 1, F.col("w")).otherwise(F.lit(-1.0))).join(numbers, ["range", "heavy", "sub"])
    return levelled.select("a", "b", "w", "sub", "level"), len(places)


def merge_in_order(rows, min_size: int) -> dict:
    """Fates of components that edges join in order.

    ``rows``: (node, size, cluster, split) of both ends of every edge, in order. Gives node -> (root, cluster or None, noise) and
    root -> (size, cluster, split); a node with neither cluster nor noise shares the fate of its root.
    """
    sets, state, members, fate = _Sets(), {}, {}, {}
    for ends in rows:
        for node, size, cluster, split in ends:
            if node not in state:
                state[node] = [size, cluster, split, node]
                members[node] = [] if size >= min_size else [node]
                if cluster is not None:
                    fate[node] = (cluster, False)
        x, y = sets.top(ends[0][0]), sets.top(ends[1][0])
        if x == y:
            continue
        if state[x][0] < state[y][0]:
            x, y = y, x
        big, small = state[x], state[y]
        waiting = members.pop(y)
        if big[0] >= min_size:
            if small[0] >= min_size:
                big[1], big[2] = None, True
            for node in waiting:
                fate[node] = (big[1], big[2])
        else:
            members[x] += waiting
        big[0] += small[0]
        big[3] = min(big[3], small[3])
        if members[x] and big[0] >= min_size:
            big[1] = big[3]
            for node in members[x]:
                fate[node] = (big[1], False)
            members[x] = []
        sets.up[y] = x
    return {node: (state[sets.top(node)], *fate.get(node, (None, False))) for node in state}


def merge_tree(nodes: DataFrame, forest: DataFrame, min_size: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(node, cluster)`` of all ``nodes``: the leaf clusters of the forest's merge tree, null for noise."""
    id_type = nodes.schema["node"].dataType.simpleString()
    levelled, n_levels = _levelled(forest, task_edges)
    levelled = materialise(levelled.withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    own = F.col("node") if min_size <= 1 else F.lit(None).cast(id_type)
    state = nodes.select("node", F.lit(1).cast("long").alias("size"), own.alias("cluster"), F.lit(False).alias("split"))
    ddl = f"node {id_type}, root {id_type}, cluster {id_type}, noise boolean, size long, root_cluster {id_type}, split boolean"
    names = ["node", "root", "cluster", "noise", "size", "root_cluster", "split"]
    steps = []
    for level in range(n_levels):
        now = levelled.filter(F.col("level") == level)
        # A single level is one bounded task. Of several, each connected group of a level's edges is one.
        group = None if n_levels == 1 else materialise(components(
            now.select(F.col("ca").alias("node")).unionByName(now.select(F.col("cb").alias("node"))).distinct(),
            now.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnsRenamed({"node": "ca", "root": "group"}))
        side = lambda x: state.select(*[F.col(c).alias(f"{x}_{c}") for c in state.columns]).withColumnRenamed(f"{x}_node", f"c{x}")
        rows = now.join(side("a"), "ca").join(side("b"), "cb")
        rows = rows.withColumn("group", F.lit(0)) if group is None else rows.join(group, "ca")

        def merge(table: pa.Table) -> pa.Table:
            edges = table.sort_by([(c, "ascending") for c in ("w", "sub", "a", "b")]).to_pylist()
            found = merge_in_order(
                ([(e["ca"], e["a_size"], e["a_cluster"], e["a_split"]), (e["cb"], e["b_size"], e["b_cluster"], e["b_split"])] for e in edges), min_size)
            rows = [(node, root[3], cluster, noise, root[0], root[1], root[2]) for node, (root, cluster, noise) in found.items()]
            kind = table.schema.field("ca").type
            types = (kind, kind, kind, pa.bool_(), pa.int64(), kind, pa.bool_())
            return pa.table([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=names)

        merged = materialise(rows.groupBy("group").applyInArrow(merge, ddl))
        steps.append(merged)
        roots = merged.groupBy("root").agg(F.max("size").alias("size"), F.max("root_cluster").alias("cluster"), F.max("split").alias("split"))
        state = materialise(state.join(merged.select("node"), "node", "left_anti").unionByName(roots.withColumnRenamed("root", "node").select(*state.columns)))
        mapping = merged.select("node", F.col("root").alias("up"))
        levelled = materialise(_mapped(levelled.filter(F.col("level") > level), mapping)) if level + 1 < n_levels else levelled
    settled = state.select("node", "cluster")
    for merged in reversed(steps):
        of_root = settled.select(F.col("node").alias("root"), F.col("cluster").alias("above"))
        inner = merged.join(of_root, "root", "left").select(
            "node", F.when(F.col("noise"), F.lit(None)).otherwise(F.coalesce("cluster", "above")).alias("cluster"))
        settled = materialise(settled.join(merged.select("node"), "node", "left_anti").unionByName(inner))
    return nodes.select("node").join(settled, "node", "left")


def bridges(rows: DataFrame, few_rows: int = BRIDGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The lightest edges ``(a, b, w)`` between clusters: rows are ``node, p, core, cluster``.

    Round by round every cluster takes its lightest edge to another one, and clusters joined so are one from then on, until
    one is left. Edges between all rows count, whatever the number of rows and clusters: up to ``few_rows`` rows all are compared with all, more
    are searched by boxes.
    """
    spark = rows.sparkSession
    node = rows.schema["node"].dataType.simpleString()
    rows = materialise(rows)
    n_rows = rows.count()
    taken = spark.createDataFrame([], f"a {node}, b {node}, w double")
    tree = None
    if n_rows > few_rows:
        tree = learn_tree(rows, "node", "p", n_rows, block_rows)
        rows = materialise(in_cells(rows, tree, "p"))
    while True:
        names = rows.select(F.col("cluster").alias("node")).distinct()
        if names.count() <= 1:
            return taken
        chosen = _lightest_of_few(rows) if tree is None else lightest_between(rows, tree, n_rows, block_rows)
        taken = taken.unionByName(chosen.select("a", "b", "w").distinct())
        joined = components(names, chosen.select(F.col("cluster").alias("a"), F.col("other").alias("b")))
        rows = materialise(rows.join(joined.withColumnRenamed("node", "cluster"), "cluster").drop("cluster").withColumnRenamed("root", "cluster"))


def _lightest_of_few(rows: DataFrame) -> DataFrame:
    """Every cluster's lightest edge to another one ``(cluster, w, a, b, other)``: all rows meet all."""
    node = rows.schema["node"].dataType.simpleString()
    name = rows.schema["cluster"].dataType.simpleString()
    ddl = f"cluster {name}, other {name}, a {node}, b {node}, w double"
    side = rows.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((side.column("node").to_pylist(), to_matrix(side.column("p")), side.column("core").to_numpy(), side.column("cluster").to_pylist()))

    def lightest(batches):
        import numpy as np

        nodes, points, core, cluster = shared.value
        code = {c: i for i, c in enumerate(dict.fromkeys(cluster))}
        own, square = np.array([code[c] for c in cluster]), (points ** 2).sum(axis=1)
        best = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p, ids, labels = to_matrix(part.column("p")), part.column("node").to_pylist(), part.column("cluster").to_pylist()
                gap = np.sqrt(np.maximum((p ** 2).sum(axis=1)[:, None] + square[None, :] - 2.0 * p @ points.T, 0.0))
                w = np.maximum(np.maximum(gap, core[None, :]), part.column("core").to_numpy()[:, None])
                w[np.array([code[c] for c in labels])[:, None] == own[None, :]] = np.inf
                for i, j in enumerate(w.argmin(axis=1).tolist()):
                    a, b = sorted((ids[i], nodes[j]))
                    best[labels[i]] = min(best.get(labels[i], (np.inf,)), (float(w[i, j]), a, b, cluster[j]))
        rows_ = [(c, other, a, b, w) for c, (w, a, b, other) in best.items()]
        types = dict(zip(("cluster", "other", "a", "b", "w"), kinds))
        yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows_], types[n]) for k, n in enumerate(types)})

    arrow = side.schema
    kinds = (arrow.field("cluster").type, arrow.field("cluster").type, arrow.field("node").type, arrow.field("node").type, pa.float64())
    return materialise(
        rows.mapInArrow(lightest, ddl).groupBy("cluster").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("cluster", "e.*"))


def density_clusters(
    df: DataFrame,
    id_col: str,
    vector: str,
    min_cluster_size: int = 25,
    min_samples: int = 3,
    max_dims: int | None = None,
    k: int | None = None,
    task_edges: int = TASK_EDGES,
    out: str = "label",
) -> DataFrame:
    """Rows with a cluster number, by size and then smallest id, -1 for noise.

    ``max_dims`` limits the distance to the first numbers of the vector, which suits component scores alone.
    """
    used = df.select(id_col, (F.col(vector) if max_dims is None else F.slice(F.col(vector), 1, max_dims)).alias("_p"))
    neighbours = materialise(euclidean_neighbours(used, id_col, "_p", k or max(min_samples, 10)))
    nodes = df.select(F.col(id_col).alias("node"))
    forest = minimum_spanning_forest(reachability_edges(neighbours, min_samples), task_edges)
    final = materialise(merge_tree(nodes, forest, min_cluster_size, task_edges))
    core = neighbours.filter(F.col("rank") == min_samples).select(F.col("src").alias("node"), F.col("distance").alias("core"))
    placed = used.select(F.col(id_col).alias("node"), F.col("_p").cast("array<double>").alias("p"))
    found = bridges(final.filter(F.col("cluster").isNotNull()).join(placed, "node").join(core, "node").select("node", "p", "core", "cluster"))
    # The forest of the graph and the bridges together: edges that the first forest left out close a circle of lighter ones.
    forest = minimum_spanning_forest(forest.unionByName(found), task_edges)
    final = materialise(merge_tree(nodes, forest, min_cluster_size, task_edges))
    found = final.filter(F.col("cluster").isNotNull()).groupBy("cluster").count()
    names = number_rows(found, [F.col("count").desc(), F.col("cluster")], out).select("cluster", F.col(out).cast("int"))
    labelled = final.join(names, "cluster", "left").select(F.col("node").alias(id_col), F.coalesce(out, F.lit(NOISE)).alias(out))
    return df.join(labelled, id_col, "left").withColumn(out, F.coalesce(out, F.lit(NOISE)))
