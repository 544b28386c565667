"""Similarity search on the embeddings and name lookup."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.catalog.base import BLOCKS, DIMENSION, FEATURE_NAMES, PAIRS_SQL, VECTORS_SQL, query, rounded, sql_rounded, table, vectors
from profilekit.functions.scalar import request_key, share_percent, whole_percent
from profilekit.functions.vector import as_double, block_share, block_unit, dot, top_contributions
from profilekit.operators.cell_index import build_cells, open_cells
from profilekit.operators.labels import centroids
from profilekit.operators.name_index import build_names, containing, open_names, with_prefix
from profilekit.operators.nearest import nearest
from profilekit.operators.relational import top_rows
from profilekit.operators.search import (
    Scoring, compare_two, knn_graph, resolve, response, search, search_vectors, similar_to, similarity_edges, split_vectors, suggest,
)
from profilekit.session import ensure_checkpoint_dir, materialise, scratch_path
from profilekit.sources.steps import path_exists, remove_path
from profilekit.sources.index_store import answer_requests, build_index, current_version, index_info, promote, read_index, read_manifest, rebuild

SCORING = Scoring(BLOCKS)


def _sides(v):
    items = v.select(F.col("id").alias("item_id"), F.col("vector").alias("item_vec"))
    return items.withColumnsRenamed({"item_id": "query_id", "item_vec": "query_vec"}), items


# ---------------------------------------------------------------- neighbours

@query("knn_graph", f"WITH {PAIRS_SQL} SELECT q AS src, c AS dst, rk AS rank, {sql_rounded('score')} AS score FROM near WHERE rk <= 10")
def _knn(spark, folder):
    return knn_graph(vectors(spark, folder), "id", "vector", 10).select("src", "dst", "rank", rounded("score").alias("score"))


@query("knn_graph_tiled", f"WITH {PAIRS_SQL} SELECT q AS src, c AS dst, rk AS rank, {sql_rounded('score')} AS score FROM near WHERE rk <= 10")
def _knn_tiled(spark, folder):
    """The way large inputs take: cells, bounds and tiles, still exact."""
    out = knn_graph(vectors(spark, folder), "id", "vector", 10, broadcast_queries=16, broadcast_items=16, tile_rows=1024)
    return out.select("src", "dst", "rank", rounded("score").alias("score"))


@query("pairwise_cosine", f"WITH {PAIRS_SQL} SELECT q AS src, c AS dst, {sql_rounded('score')} AS score FROM near WHERE rk <= 49")
def _edges(spark, folder):
    """The similarity edges in their sparse form: 49 real neighbours per row."""
    return similarity_edges(vectors(spark, folder), "id", "vector").select("src", "dst", rounded("score").alias("score"))


@query("topk_global", f"""WITH {PAIRS_SQL}
SELECT q AS src, c AS dst, {sql_rounded('score')} AS score FROM near WHERE rk <= 25 ORDER BY score DESC, q, c LIMIT 25""")
def _topk_global(spark, folder):
    # As many per row as are wanted in all: no row can hold more of them.
    edges = knn_graph(vectors(spark, folder), "id", "vector", 25)
    return top_rows(edges, [F.col("score").desc(), F.col("src"), F.col("dst")], 25).select("src", "dst", rounded("score").alias("score"))


@query("topk_per_query", f"""WITH {VECTORS_SQL},
cen AS (SELECT label, list(m ORDER BY pos) AS cv FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM v) GROUP BY 1, 2) GROUP BY 1),
cu AS (SELECT label, list_transform(cv, lambda x: x / sqrt(list_dot_product(cv, cv))) AS cv FROM cen),
p AS (SELECT cu.label AS query, v.id, round(list_dot_product(cu.cv, v.vector), 9) AS s FROM cu JOIN v ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM p)
SELECT query, id, rank, {sql_rounded('s')} AS score FROM r WHERE rank <= 7""")
def _topk_per_query(spark, folder):
    from profilekit.functions.vector import unit

    v = vectors(spark, folder)
    asked = centroids(v, "vector", "label").select(F.col("label").alias("query_id"), unit(F.col("centroid")).alias("query_vec"))
    return nearest(asked, _sides(v)[1], 7, exclude_self=False).select(
        F.col("query_id").alias("query"), F.col("item_id").alias("id"), "rank", rounded("score").alias("score"))


@query("similar_to_one", f"WITH {PAIRS_SQL} SELECT c AS id, rk AS rank, {sql_rounded('score')} AS score FROM near WHERE q = 7 AND rk <= 10")
def _similar(spark, folder):
    return similar_to(vectors(spark, folder), "id", "vector", 7, 10).select(F.col("item_id").alias("id"), "rank", rounded("score").alias("score"))


@query("similar_exclude_group", f"""WITH {PAIRS_SQL},
x AS (SELECT *, row_number() OVER (ORDER BY score DESC, c) AS rank FROM pairs WHERE q = 7 AND q_role <> c_role)
SELECT c AS id, rank, {sql_rounded('score')} AS score FROM x WHERE rank <= 10""")
def _similar_other(spark, folder):
    return similar_to(vectors(spark, folder), "id", "vector", 7, 10, different="role").select(
        F.col("item_id").alias("id"), "rank", rounded("score").alias("score"))


@query("raw_vector_search", f"""WITH {VECTORS_SQL},
q AS (SELECT id, list_transform(e, lambda x: x * 3.0) AS e FROM raw),
p AS (SELECT q.id AS query_id, v.id AS item_id, round(list_dot_product(v.vector, list_transform(q.e, lambda x: x / sqrt(list_dot_product(q.e, q.e)))), 9) AS s,
             sqrt(list_dot_product(q.e, q.e)) AS len FROM q JOIN v ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM p)
SELECT query_id, item_id, rank, {sql_rounded('s * len')} AS score FROM r WHERE rank <= 3""")
def _raw(spark, folder):
    asked = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.transform(as_double(F.col("embedding")), lambda x: x * 3.0).alias("vector"))
    out = search_vectors(asked, vectors(spark, folder), DIMENSION, 3, normalise=False, attributions=0)
    return out.select("query_id", "item_id", "rank", rounded("score").alias("score"))


# -------------------------------------------------------------- hybrid search

def _block_cosines() -> str:
    parts = []
    for b in range(8):
        lo, hi = 8 * b + 1, 8 * b + 8
        q, c = f"list_slice(qv, {lo}, {hi})", f"list_slice(cv, {lo}, {hi})"
        parts.append(f"list_dot_product({q}, {c}) / ((sqrt(list_dot_product({q}, {q})) + 1e-8) * (sqrt(list_dot_product({c}, {c})) + 1e-8))")
    return parts


def _hybrid_sql(weights: list[float] | None = None) -> str:
    w = weights or [1.0] * 8
    block = "(" + " + ".join(f"{x} * ({p})" for x, p in zip(w, _block_cosines())) + f") / {sum(w)}::DOUBLE"
    return f"0.60::DOUBLE * list_dot_product(qv, cv) + 0.35::DOUBLE * ({block}) + 0.05::DOUBLE * (CASE WHEN q_role = c_role THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _ranked_sql(source: str, k: int, weights: list[float] | None = None) -> str:
    return f"""scored AS (SELECT q, c, q_role, c_role, qv, cv, list_dot_product(qv, cv) AS cosine, {_hybrid_sql(weights)} AS hybrid FROM {source}),
final AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(hybrid, 9) DESC, c) AS rank FROM scored)"""


def _answer(df):
    return df.select("query_id", "item_id", "rank", rounded("hybrid").alias("score"), rounded("cosine").alias("cosine"), "role_bonus")


_ANSWER_SQL = f"SELECT q AS query_id, c AS item_id, rank, {sql_rounded('hybrid')} AS score, {sql_rounded('cosine')} AS cosine, CASE WHEN q_role = c_role THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS role_bonus FROM final"


def _everyone(v, **limits):
    return v.select(F.col("id").alias("query_id"), *[c.alias(n) for n, c in limits.items()])


@query("hybrid_search", f"WITH {PAIRS_SQL}, cand AS (SELECT * FROM near WHERE rk <= 6), {_ranked_sql('cand', 5)} {_ANSWER_SQL} WHERE rank <= 5")
def _hybrid(spark, folder):
    v = vectors(spark, folder)
    return _answer(search(_everyone(v), v, SCORING, 5, attributions=0))


_W = [2.0, 1.0, 0.5, 0.0, 1.0, 1.0, 3.0, 1.0]


@query("hybrid_search_weighted", f"WITH {PAIRS_SQL}, cand AS (SELECT * FROM near WHERE rk <= 6), {_ranked_sql('cand', 5, _W)} {_ANSWER_SQL} WHERE rank <= 5")
def _hybrid_weighted(spark, folder):
    v = vectors(spark, folder)
    scoring = Scoring(BLOCKS, block_weights={f"b{i}": w for i, w in enumerate(_W)})
    return _answer(search(_everyone(v), v, scoring, 5, attributions=0))


@query("hybrid_search_filtered", f"""WITH {PAIRS_SQL}, fetched AS (SELECT * FROM near WHERE rk <= 25),
kept AS (SELECT * FROM fetched WHERE c_role = q_role),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS pr FROM kept) WHERE pr <= 10),
{_ranked_sql('cand', 5)} {_ANSWER_SQL} WHERE rank <= 5""")
def _hybrid_filtered(spark, folder):
    v = vectors(spark, folder)
    return _answer(search(_everyone(v, want_role=F.col("role")), v, SCORING, 5, attributions=0))


@query("hybrid_search_periods", f"""WITH {PAIRS_SQL}, fetched AS (SELECT * FROM near WHERE rk <= 25),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS pr FROM fetched WHERE c_period BETWEEN 2003 AND 2007) WHERE pr <= 10),
{_ranked_sql('cand', 5)} {_ANSWER_SQL} WHERE rank <= 5""")
def _hybrid_periods(spark, folder):
    v = vectors(spark, folder)
    return _answer(search(_everyone(v, min_period=F.lit(2003), max_period=F.lit(2007)), v, SCORING, 5, attributions=0))


@query("search_prefiltered", f"""WITH {PAIRS_SQL},
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS pr FROM pairs WHERE c_role = q_role) WHERE pr <= 10),
{_ranked_sql('cand', 5)} {_ANSWER_SQL} WHERE rank <= 5""")
def _prefiltered(spark, folder):
    v = vectors(spark, folder)
    return _answer(search(_everyone(v, want_role=F.col("role")), v, SCORING, 5, mode="pre", attributions=0))


@query("search_response", f"""WITH {PAIRS_SQL}, cand AS (SELECT * FROM near WHERE rk <= 4), {_ranked_sql('cand', 3)}
SELECT q AS query_id, c AS entity_id, 'v' || lpad(c::VARCHAR, 6, '0') AS entity_name, {sql_rounded('hybrid')} AS score, rank, c_role AS role, 'v1' AS index_version FROM final WHERE rank <= 3""")
def _response(spark, folder):
    v = vectors(spark, folder)
    out = response(search(_everyone(v), v, SCORING, 3, attributions=0), "v1")
    return out.select("query_id", "entity_id", "entity_name", rounded("score").alias("score"), "rank", "metadata.role", "index_version")


@query("vector_checks", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings)
SELECT vec_id, label <> 3 AND embedding[1] <= 0.2 AS usable FROM e""")
def _vector_checks(spark, folder):
    """Vectors of label 3 lose a number, vectors with a large first number get a NaN."""
    e = table(spark, folder, "embeddings")
    raw = as_double(F.col("embedding"))
    spoiled = F.when(F.col("label") == 3, F.slice(raw, 1, DIMENSION - 1)).when(
        F.get(raw, F.lit(0)) > 0.2, F.transform(raw, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(raw)
    good, bad = split_vectors(e.select("vec_id", spoiled.alias("vector")), "vector", DIMENSION)
    return good.select("vec_id", F.lit(True).alias("usable")).unionByName(bad.select("vec_id", F.lit(False).alias("usable")))


@query("feature_attribution", f"""WITH {PAIRS_SQL}, cand AS (SELECT * FROM near WHERE rk <= 6), {_ranked_sql('cand', 5)},
best AS (SELECT q, c, cosine, qv, cv FROM final WHERE rank <= 5 AND cosine > 0),
t AS (SELECT q, c, cosine, unnest(qv) AS a, unnest(cv) AS b, generate_subscripts(qv, 1) AS pos FROM best),
f AS (SELECT *, row_number() OVER (PARTITION BY q, c ORDER BY round(abs(a * b / cosine), 9) DESC, pos) AS place FROM t)
SELECT q AS query_id, c AS item_id, place, 'f' || lpad((pos - 1)::VARCHAR, 2, '0') AS feature, {sql_rounded('a * b / cosine')} AS contribution,
       {sql_rounded('a')} AS query_value, {sql_rounded('b')} AS candidate_value FROM f WHERE place <= 5""")
def _attribution(spark, folder):
    v = vectors(spark, folder)
    found = search(_everyone(v), v, SCORING, 5, features=FEATURE_NAMES)
    rows = found.select("query_id", "item_id", F.posexplode("attributions").alias("place", "a"))
    return rows.select(
        "query_id", "item_id", (F.col("place") + 1).alias("place"), "a.feature", rounded("a.contribution").alias("contribution"),
        rounded("a.query_value").alias("query_value"), rounded("a.candidate_value").alias("candidate_value"))


@query("block_attribution", f"""WITH {PAIRS_SQL}, best AS (SELECT * FROM near WHERE rk <= 5)
SELECT q AS query_id, c AS item_id, {', '.join(f"{sql_rounded(f'list_dot_product(list_slice(qv, {8 * b + 1}, {8 * b + 8}), list_slice(cv, {8 * b + 1}, {8 * b + 8})) / list_dot_product(qv, cv)')} AS b{b}" for b in range(8))}
FROM best WHERE score > 0""")
def _block_attribution(spark, folder):
    q, i = _sides(vectors(spark, folder))
    pairs = nearest(q, i, 5).filter("score > 0").join(q, "query_id").join(i, "item_id")
    return pairs.select("query_id", "item_id", *[
        rounded(block_share(F.col("query_vec"), F.col("item_vec"), at)).alias(b) for b, at in BLOCKS.items()])


@query("block_unit_vectors", f"""WITH {VECTORS_SQL} SELECT id, {', '.join(
    f"{sql_rounded(f'list_slice(vector, {8 * b + 1}, {8 * b + 8})[3] / (sqrt(list_dot_product(list_slice(vector, {8 * b + 1}, {8 * b + 8}), list_slice(vector, {8 * b + 1}, {8 * b + 8}))) + 1e-8)', 6)} AS b{b}" for b in range(8))} FROM v""")
def _block_units(spark, folder):
    v = vectors(spark, folder)
    return v.select("id", *[rounded(F.get(block_unit(F.col("vector"), at), F.lit(2)), 6).alias(b) for b, at in BLOCKS.items()])


@query("share_display", f"""WITH {PAIRS_SQL}, best AS (SELECT * FROM near WHERE rk <= 5 AND score > 0),
t AS (SELECT q, c, score, unnest(qv) * unnest(cv) / list_dot_product(qv, cv) AS part, generate_subscripts(qv, 1) AS pos FROM best),
f AS (SELECT *, row_number() OVER (PARTITION BY q, c ORDER BY round(abs(part), 9) DESC, pos) AS place FROM t)
SELECT q AS query_id, c AS item_id, pos - 1 AS feature, {sql_rounded('least(abs(part) * 100, 100)', 3)} AS width, place = 1 AS is_largest, round(score * 100) AS percent FROM f WHERE place <= 5""")
def _share(spark, folder):
    q, i = _sides(vectors(spark, folder))
    pairs = nearest(q, i, 5).filter("score > 0").join(q, "query_id").join(i, "item_id")
    top = top_contributions(F.col("query_vec"), F.col("item_vec"), None, 5)
    rows = pairs.select("query_id", "item_id", "score", F.posexplode(top).alias("place", "a"))
    return rows.select(
        "query_id", "item_id", F.col("a.feature").cast("long").alias("feature"), rounded(share_percent(F.col("a.contribution")), 3).alias("width"),
        (F.col("place") == 0).alias("is_largest"), whole_percent(F.col("score")).alias("percent"))


@query("compare_two", f"""WITH {VECTORS_SQL} SELECT a.id AS id_a, b.id AS id_b, {sql_rounded('list_dot_product(a.vector, b.vector)')} AS cosine,
a.label AS label_a, b.label AS label_b, a.label = b.label AS same_cluster FROM v a, v b WHERE a.id = 3 AND b.id = 11""")
def _compare_two(spark, folder):
    return compare_two(vectors(spark, folder), 3, 11).withColumn("cosine", rounded("cosine"))


# --------------------------------------------------------- index and requests

def cell_index(spark, folder):
    """The cell index of the embeddings: built by the first query of a session that asks for it, opened by the others."""
    where = f"{ensure_checkpoint_dir(spark)}/profilekit/{spark.sparkContext.applicationId}/cells-{hashlib.md5(folder.encode()).hexdigest()}"
    if path_exists(spark, f"{where}/cells/_SUCCESS"):
        return open_cells(spark, where)
    remove_path(spark, where)
    return build_cells(materialise(_sides(vectors(spark, folder))[1]), where)


@query("ann_search")
def _ann(spark, folder):
    """Approximate search of a stored index: only the cells that a query may visit are read."""
    return knn_graph(vectors(spark, folder), "id", "vector", 10, cells=cell_index(spark, folder)).withColumnsRenamed({"src": "query_id", "dst": "item_id"})


@query("ann_recall", f"""WITH {PAIRS_SQL} SELECT count(*) AS n_neighbours, true AS recall_reached FROM near WHERE q % 50 = 0 AND rk <= 10""")
def _ann_recall(spark, folder):
    """Exact neighbours of the rows whose id is divisible by 50, and whether the approximate search finds 0.9 of them."""
    q, i = _sides(materialise(vectors(spark, folder)))
    some = materialise(q.filter("query_id % 50 = 0"))
    wanted = materialise(nearest(some, i, 10).select("query_id", "item_id"))
    found = nearest(some, i, 10, cells=cell_index(spark, folder)).select("query_id", "item_id", F.lit(1).alias("hit"))
    return wanted.join(found, ["query_id", "item_id"], "left").agg(
        F.count(F.lit(1)).alias("n_neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


@query("ann_all_cells", f"WITH {PAIRS_SQL} SELECT q AS src, c AS dst, rk AS rank, {sql_rounded('score')} AS score FROM near WHERE rk <= 10")
def _ann_all(spark, folder):
    """With every cell allowed the stored index gives the exact neighbours."""
    out = knn_graph(vectors(spark, folder), "id", "vector", 10, cells=cell_index(spark, folder).exact())
    return out.select("src", "dst", "rank", rounded("score").alias("score"))


@query("index_build", f"""WITH {VECTORS_SQL} SELECT id, generate_subscripts(vector, 1) - 1 AS position, unnest(list_transform(vector, lambda x: {sql_rounded('x', 6)})) AS value,
(SELECT count(*) FROM v) AS n_vectors, {DIMENSION} AS n_features FROM v""")
def _index_build(spark, folder):
    where = scratch_path(spark, "index")
    rows = vectors(spark, folder)
    version = build_index(rows, where, FEATURE_NAMES)
    manifest = read_manifest(spark, where, version)
    promote(spark, where, version)
    rows = read_index(spark, where, current_version(spark, where)).select("id", F.posexplode("vector").alias("position", "value"))
    return rows.select("id", "position", rounded("value", 6).alias("value"), F.lit(manifest["n_vectors"]).alias("n_vectors"),
                       F.lit(len(manifest["feature_names"])).alias("n_features"))


@query("index_info", """SELECT count(*) AS vector_count, max(len(embedding)) AS dimension,
count(*) * max(len(embedding)) * 4 + count(*) * 32 * 8 AS memory_bytes FROM embeddings""")
def _index_info(spark, folder):
    return index_info(vectors(spark, folder))


@query("index_gate", f"""WITH {PAIRS_SQL},
after AS (SELECT a.id AS q, b.id AS c, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(list_slice(a.vector, 1, 56), list_slice(b.vector, 1, 56)), 9) DESC, b.id) AS rk
  FROM v a JOIN v b ON a.id <> b.id),
common AS (SELECT o.q, count(n.c) AS i FROM (SELECT q, c FROM near WHERE rk <= 10) o LEFT JOIN (SELECT q, c FROM after WHERE rk <= 10) n ON o.q = n.q AND o.c = n.c GROUP BY o.q),
j AS (SELECT avg(i::DOUBLE / (20 - i)) AS mean_jaccard, count(*) FILTER (i::DOUBLE / (20 - i) < 0.70) AS n_alerts FROM common)
SELECT 1 AS build, true AS promoted, NULL::DOUBLE AS mean_jaccard, 0::BIGINT AS n_alerts
UNION ALL SELECT 2, mean_jaccard >= 0.85 AND n_alerts = 0, {sql_rounded('mean_jaccard')}, n_alerts FROM j""")
def _index_gate(spark, folder):
    """A first version, then the same rows without block 7: promoted only when answers stay close."""
    where = scratch_path(spark, "index")
    rows = vectors(spark, folder)
    first = rebuild(rows, where, FEATURE_NAMES, lambda ix: nearest(*_sides(ix), 10))
    cut = rows.withColumn("vector", F.transform("vector", lambda x, i: F.when(i < 56, x).otherwise(0.0)))
    second = rebuild(cut, where, FEATURE_NAMES, lambda ix: nearest(*_sides(ix), 10))
    return spark.createDataFrame(
        [(k, bool(d["promoted"]), d["mean_jaccard"], int(d["n_alerts"])) for k, d in enumerate((first, second), 1)],
        "build int, promoted boolean, mean_jaccard double, n_alerts long").withColumn("mean_jaccard", rounded("mean_jaccard"))


@query("request_key", """SELECT vec_id, md5('{"entity":' || vec_id || ',"k":10,"role":"r' || label || '","version":"v1"}') AS request_key FROM embeddings""")
def _request_key(spark, folder):
    e = table(spark, folder, "embeddings")
    key = request_key([
        ("version", F.lit("v1")), ("k", F.lit(10)), ("entity", F.col("vec_id")), ("role", F.concat(F.lit("r"), F.col("label")))])
    return e.select("vec_id", key.alias("request_key"))


@query("answer_table", f"WITH {PAIRS_SQL} SELECT q AS query_id, c AS item_id, rk AS rank FROM near WHERE rk <= 3")
def _answers(spark, folder):
    """Answers of half the requests are stored first, the second call computes only the rest."""
    where = scratch_path(spark, "answers")
    v = vectors(spark, folder)
    requests = v.select(F.col("id").alias("query_id"), request_key([("entity", F.col("id")), ("k", F.lit(3))]).alias("request_key"))

    def compute(missing):
        q, i = _sides(v)
        return nearest(q.join(missing.select("query_id"), "query_id"), i, 3).join(missing, "query_id").select(
            "request_key", "query_id", "item_id", "rank")

    answer_requests(requests.filter(F.col("request_key") < "8"), where, compute)
    return answer_requests(requests, where, compute).select("query_id", "item_id", "rank")


# ---------------------------------------------------------------- name lookup

_ASK = """ask AS (SELECT DISTINCT q FROM (
  SELECT upper(p_name) AS q FROM part UNION ALL SELECT split_part(p_name, ' ', 1) AS q FROM part
  UNION ALL SELECT p_partkey::VARCHAR AS q FROM part WHERE p_size = 1 UNION ALL SELECT 'zzz ' || p_brand AS q FROM part))"""


@query("resolve_names", f"""WITH {_ASK},
hits AS (
  SELECT q, p_partkey AS id, p_name AS name, 1 AS step FROM ask JOIN part ON p_partkey::VARCHAR = trim(q)
  UNION ALL SELECT q, p_partkey, p_name, 2 FROM ask JOIN part ON lower(trim(p_name)) = lower(trim(q))
  UNION ALL SELECT q, p_partkey, p_name, 3 FROM ask JOIN part ON starts_with(lower(trim(p_name)), lower(trim(q)))),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY step, lower(trim(name)), id::VARCHAR) AS rn FROM hits)
SELECT ask.q AS query, r.id::VARCHAR AS id, r.name, r.step FROM ask LEFT JOIN r ON ask.q = r.q AND rn = 1""")
def _resolve(spark, folder):
    p = table(spark, folder, "part")
    asked = (
        p.select(F.upper("p_name").alias("query"))
        .unionAll(p.select(F.split_part("p_name", F.lit(" "), F.lit(1))))
        .unionAll(p.filter("p_size = 1").select(F.col("p_partkey").cast("string")))
        .unionAll(p.select(F.concat(F.lit("zzz "), "p_brand")))
    )
    return resolve(asked, p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")))


def _suggest_sql(text: str) -> str:
    return f"""WITH k AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, lower(trim(p_name)) AS n FROM part),
h AS (SELECT *, CASE WHEN starts_with(n, '{text}') THEN 1 WHEN contains(n, '{text}') THEN 2 END AS kind FROM k),
b AS (SELECT * FROM h WHERE kind = (SELECT min(kind) FROM h))
SELECT id, name, row_number() OVER (ORDER BY n, id) AS rank FROM b QUALIFY rank <= 10"""


def _names(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))


@query("suggest_names", _suggest_sql("red"))
def _suggest(spark, folder):
    return suggest(_names(spark, folder), " Red ", 10)


@query("suggest_names_inside", _suggest_sql("idget"))
def _suggest_inside(spark, folder):
    return suggest(_names(spark, folder), "idget", 10)


_LOOKED_UP = ("red", "idget", "blue b", "l r", "zzz")


@query("stored_name_lookup", f"""WITH t AS (SELECT unnest({list(_LOOKED_UP)!r}) AS text),
k AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, lower(trim(p_name)) AS n FROM part)
SELECT text, 'prefix' AS kind, id, name FROM t JOIN k ON starts_with(n, text)
UNION ALL SELECT text, 'inside', id, name FROM t JOIN k ON contains(n, text)""")
def _stored_lookup(spark, folder):
    """All names that start with, or contain, some texts, from the stored name table."""
    where = scratch_path(spark, "names")
    build_names(_names(spark, folder), where)
    index = open_names(spark, where)
    found = [
        how(index, text).select(F.lit(text).alias("text"), F.lit(kind).alias("kind"), "id", "name")
        for text in _LOOKED_UP for kind, how in (("prefix", with_prefix), ("inside", containing))
    ]
    return reduce(DataFrame.unionByName, found)


@query("block_cosine_pairs", f"""WITH {PAIRS_SQL}, best AS (SELECT * FROM near WHERE rk <= 2)
SELECT q AS src, c AS dst, {', '.join(f'{sql_rounded(p)} AS b{i}' for i, p in enumerate(_block_cosines()))} FROM best""")
def _block_cosine(spark, folder):
    q, i = _sides(vectors(spark, folder))
    pairs = nearest(q, i, 2).join(q, "query_id").join(i, "item_id")
    return pairs.select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), *[
        rounded(dot(block_unit(F.col("query_vec"), at), block_unit(F.col("item_vec"), at))).alias(b) for b, at in BLOCKS.items()])
