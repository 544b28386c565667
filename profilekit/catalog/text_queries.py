"""Names and links in documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilekit.catalog.base import query, rounded, sql_rounded, table
from profilekit.functions.scalar import allowed_url
from profilekit.functions.text import normalise_name
from profilekit.operators.names import accepted_links, link_for, linked_rows, match_coverage, name_links, unmatched_names, word_pairs
from profilekit.session import materialise, scratch_path
from profilekit.sources.tables import write_links

# The pages carry names and links as anchors: <a href="link">name</a>.
ANCHOR = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'
LISTED = ("blog.tionsh.example.net", "thther.example.org", "blog.ththan.example.net", "www.ththhe.example.com", "m.ththth.example.net")

_BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _norm_sql(expr: str, drop: str = ".''") -> str:
    low = f"regexp_replace(lower(strip_accents({expr})), '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    cut = f"regexp_replace({low}, '{_BLANK}+(jr|sr|ii|iii|iv)\\.?$', '')"
    return f"regexp_replace(translate({cut}, '{drop}', ''), '{_BLANK}+', ' ', 'g')"


@query("normalise_names", f"""WITH n AS (SELECT doc_id, {_norm_sql('text')} AS n, {_norm_sql("source || ' ÉÇ O''Neal ' || lang || ' Jr.'")} AS s FROM documents)
SELECT doc_id, md5(n) AS digest, length(n) AS n_chars, s AS short FROM n""")
def _normalise(spark, folder):
    d = table(spark, folder, "documents")
    whole = normalise_name(F.col("text"))
    short = normalise_name(F.concat(F.col("source"), F.lit(" ÉÇ O'Neal "), F.col("lang"), F.lit(" Jr.")))
    return d.select("doc_id", whole.alias("n"), short.alias("short")).select(
        "doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("n_chars"), "short")


_ROWS = f"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS n, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS u,
  generate_subscripts(regexp_extract_all(html, '{ANCHOR}', 1), 1) - 1 AS position FROM pages),
rows_ AS (SELECT page_id, position, trim(regexp_replace(trim(n), '\\s+Headshot$', '', 'i')) AS name, trim(u) AS url FROM a WHERE trim(n) <> '' AND trim(u) <> '')"""


def _rows(spark, folder):
    return linked_rows(table(spark, folder, "pages"), "html", ANCHOR, 2, 1, ["page_id"])


@query("html_rows", f"WITH {_ROWS} SELECT page_id, position, name, url FROM rows_")
def _html_rows(spark, folder):
    return _rows(spark, folder)


_HOST = r"^https://([^/?#:]+)"
@query("url_allowlist", f"""SELECT page_id, url, coalesce(starts_with(url, 'https://') AND lower(regexp_extract(url, '{_HOST}', 1)) IN (
  SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages GROUP BY 1 ORDER BY count(*) DESC, h LIMIT 8)
  AND regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1) <> '', false) AS allowed FROM pages""")
def _allow(spark, folder):
    pages = table(spark, folder, "pages")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    common = [r[0] for r in pages.groupBy(host.alias("h")).count().orderBy(F.col("count").desc(), "h").limit(8).collect()]
    return pages.select("page_id", "url", allowed_url(F.col("url"), common).alias("allowed"))


def _links(rows):
    return name_links(rows, ["page_id", "position"])


_LINKS = f"""{_ROWS}, keyed AS (SELECT *, {_norm_sql('name')} AS key FROM rows_),
links AS (SELECT key, name, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id, position) AS rn FROM keyed) WHERE rn = 1)"""


@query("name_url_dedupe", f"WITH {_LINKS} SELECT key, name, url FROM links")
def _dedupe(spark, folder):
    return _links(_rows(spark, folder))


@query("name_url_export", f"WITH {_LINKS} SELECT name, url FROM links")
def _export(spark, folder):
    path = scratch_path(spark, "links")
    write_links(_links(_rows(spark, folder)), path)
    return spark.read.schema("name string, url string").json(path)


@query("accepted_links", f"""WITH {_ROWS}, full_ AS (SELECT r.page_id, position, name, regexp_extract(p.url, '^[a-z]+://[^/?#]+') || r.url AS url FROM rows_ r JOIN pages p ON p.page_id = r.page_id)
SELECT page_id, position, name, replace(url, '260x190', '1040x760') AS url FROM full_ WHERE starts_with(url, 'https://')
AND lower(regexp_extract(url, '{_HOST}', 1)) IN ({', '.join(f"'{h}'" for h in LISTED)}) AND regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1) <> ''""")
def _accepted(spark, folder):
    """Anchors made absolute with the address of their page, then filtered by the allow-list."""
    rows = linked_rows(table(spark, folder, "pages").withColumnRenamed("url", "page"), "html", ANCHOR, 2, 1, ["page_id", "page"])
    full = rows.withColumn("url", F.concat(F.regexp_extract("page", "^[a-z]+://[^/?#]+", 0), "url")).drop("page")
    return accepted_links(full, LISTED)


# Names looked up: every two words that follow each other in a document, and every anchor; each name once, with its occurrences.
_WANTED = """w2 AS (SELECT [x for x in regexp_split_to_array(text, '[ \\t\\n\\r\\f]+') if x <> ''] AS w FROM documents WHERE text IS NOT NULL),
wanted AS (SELECT name, count(*) AS n FROM (
  SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS name FROM w2 UNION ALL SELECT translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM rows_) GROUP BY 1)"""


def _wanted(spark, folder, rows):
    pairs = word_pairs(table(spark, folder, "documents"), "text")
    # Only A to Z: what else has an upper case is not the same everywhere.
    anchors = rows.select(F.translate("name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("name"), F.lit(1).cast("long").alias("n"))
    return pairs.unionByName(anchors).groupBy("name").agg(F.sum("n").alias("n"))


@query("name_lookup", f"WITH {_LINKS}, {_WANTED} SELECT w.name, w.n, links.url FROM wanted w LEFT JOIN links ON links.key = {_norm_sql('w.name')}")
def _lookup(spark, folder):
    rows = materialise(_rows(spark, folder))
    return link_for(_wanted(spark, folder, rows), _links(rows)).select("name", "n", "url")


@query("match_coverage", f"""WITH {_LINKS}, {_WANTED} SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (links.url IS NOT NULL), 0)::BIGINT AS matched,
{sql_rounded('coalesce(sum(n) FILTER (links.url IS NOT NULL), 0)::DOUBLE / sum(n) * 100')} AS coverage FROM wanted w LEFT JOIN links ON links.key = {_norm_sql('w.name')} WHERE w.name <> ''""")
def _coverage(spark, folder):
    rows = materialise(_rows(spark, folder))
    return match_coverage(_wanted(spark, folder, rows), _links(rows), count="n").withColumn("coverage", rounded("coverage"))


@query("unmatched_names", f"""WITH {_LINKS}, {_WANTED} SELECT w.name FROM wanted w WHERE w.name <> '' AND {_norm_sql('w.name')} NOT IN (SELECT key FROM links)
ORDER BY w.name LIMIT 50""")
def _unmatched(spark, folder):
    rows = materialise(_rows(spark, folder))
    return unmatched_names(_wanted(spark, folder, rows), _links(rows))
