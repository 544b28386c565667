"""Main text of web pages: structure where a page has it, host suffix arrays where it has not.

A page is cut into blocks. Each block knows its zone: inside an article, inside a main element, in something that is
never article (menus, headers, footers, sidebars, notices, adverts, forms, comments), or elsewhere. A page with an article (else, a main
element) gives the blocks of that zone, whether or not other pages repeat them: mirrored articles stay whole. A name (class or id) is
weaker than an element: it never sets aside a body, a main element or an article, nor an article inside when the page has no other.

Pages without either are decided by repetition. The token streams of all blocks outside articles are concatenated and their
suffixes sorted (:mod:`profilekit.llm.suffix_array`), tokens being told apart by host. Suffixes that share ``run`` tokens are
neighbours; where they belong to distinct pages they are boilerplate. Tasks sort the pages they hold, and one
head per distinct run (every place of runs that only one page of the lot has) meets the heads of other tasks by key, so a host with a third of all pages is not gathered
anywhere. Blocks covered by such runs go, the unique rest stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema
from profilekit.llm.shingles import mix, word_hashes
from profilekit.llm.suffix_array import common_prefixes, suffix_array
from profilekit.llm.suffix_dedup import _blobs, _by_part
from profilekit.session import materialise

# Fixed word lists of the markup.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACE_TAGS = frozenset("br td th option".split())
RAW_TAGS = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "math")
NEVER_TAGS = frozenset("nav footer aside form button select dialog menu".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer cookie cookies consent notice notices banner ad ads advert adverts advertisement "
    "advertisements sponsored sponsor promo promotion comment comments reply replies disqus related recommended share sharing social "
    "newsletter subscribe signup login breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar masthead topbar".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = NEVER_TAGS | {"article", "main", "header", "section", "div", "p", "ul", "ol", "li", "table", "span", "figure", "details", "body"}

#: First parts of names that tell of a state, as no-sidebar does.
STATES = frozenset("no not non has have with without is are show hide toggle open close enable disable".split())
NAMED_TAGS = frozenset("article main body html".split())

EXCLUDED, ARTICLE, MAIN, ELSEWHERE = 0, 1, 2, 3
#: While a page is read: set aside by a name alone, and an article inside that.
_ASIDE, _ASIDE_ARTICLE = 4, 5

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join(RAW_TAGS) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)"
    r"|([^<]+|<)", re.DOTALL | re.IGNORECASE)
# Every attribute with its value, so that words inside other values are not taken for attributes.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAMES = frozenset("class id role itemprop hidden aria-hidden style".split())
_NAME = re.compile(r"[A-Za-z]+")


@dataclass(frozen=True)
class PageParams:
    """``run`` tokens in a row make a repeat; a block goes when more than ``share`` of its tokens are in one, or in links."""

    run: int = 6
    share: float = 0.5


def _never_named(names: str) -> bool:
    """Whether one of these classes and ids is, or ends as, a name that is never article: ad, reader-comments, not no-sidebar or comments-open."""
    for name in names.split():
        parts = [p.lower() for p in _NAME.findall(name)]
        if parts and parts[-1] in NEVER_NAMES and not STATES.intersection(parts[:-1]):
            return True
    return False


def _mark(tag: str, attributes: str, inside_article: bool) -> int | None:
    """The zone an element opens, None when it keeps its parent's."""
    named: dict[str, str] = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1] and m[1].lower() in _NAMES:
                named[m[1].lower()] = m[2] or m[3] or m[4] or ""
    if tag in NEVER_TAGS or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", ""):
        return EXCLUDED
    if named:
        role = named.get("role", "").lower()
        if role in NEVER_ROLES:
            return EXCLUDED
        if role == "article" or named.get("itemprop") == "articleBody":
            return ARTICLE
        if role == "main":
            return MAIN
        if tag not in NAMED_TAGS and _never_named(named.get("class", "") + " " + named.get("id", "")):
            return _ASIDE
    if tag == "article":
        return ARTICLE
    if tag == "main":
        return MAIN
    if tag == "header" and not inside_article:
        return EXCLUDED
    return None


def _inside(zone: int, opened: int | None) -> int:
    """The zone of an element that opens one inside another."""
    if opened is None or zone == EXCLUDED:
        return zone  # what is inside an excluded element stays excluded
    if opened == ARTICLE and zone in (_ASIDE, _ASIDE_ARTICLE):
        return _ASIDE_ARTICLE
    # An article inside main is an article.
    return zone if opened == MAIN and zone in (ARTICLE, _ASIDE_ARTICLE) else opened


def blocks_of(page: str) -> list[tuple[str, int, float]]:
    """(text, zone, share of its characters in links) of each block in page order; white space is one space, references are decoded."""
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, int]] = []
    zone, parts, linked, in_link = ELSEWHERE, [], 0, False

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, zone, linked / max(1, sum(map(len, parts)))))
            parts, linked = [], 0

    for m in _PART.finditer(page):
        text, tag = m[5], m[3]
        if text is not None:
            parts.append(text)
            linked += len(text) if in_link else 0
            continue
        if tag is None:
            continue  # comments, scripts and the like, declarations
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        elif tag in SPACE_TAGS:
            parts.append(" ")
        elif tag == "a":
            in_link = not m[2]
        if tag in _VOID or tag not in _CONTAINERS:
            continue
        if not m[2]:
            if tag == "p":
                # A paragraph ends the one before.
                while stack and stack[-1][0] in ("p", "span"):
                    stack.pop()
                current = stack[-1][1] if stack else ELSEWHERE
                if current != zone:
                    flush()
                    zone = current
            inner = _inside(zone, _mark(tag, m[4], zone in (ARTICLE, _ASIDE_ARTICLE)))
            if inner != zone:
                flush()
            stack.append((tag, inner))
            zone = inner
        elif any(t == tag for t, _ in stack):
            while stack.pop()[0] != tag:
                pass
            current = stack[-1][1] if stack else ELSEWHERE
            if current != zone:
                flush()
                zone = current
    flush()
    found = {z for _, z, _ in out}
    last = {_ASIDE: EXCLUDED, _ASIDE_ARTICLE: EXCLUDED if ARTICLE in found else MAIN if MAIN in found else ARTICLE}
    return [(t, last.get(z, z), share) for t, z, share in out]


def level_of(zones: Iterable[int]) -> int:
    """The zone a page's main text is in."""
    found = set(zones)
    return ARTICLE if ARTICLE in found else MAIN if MAIN in found else ELSEWHERE


# --- repeated runs --------------------------------------------------------------------------------------

_HEAD = np.dtype([("key", "<u8"), ("page", "<i8"), ("at", "<i4")])
_PARSED = "page_id long, url string, host string, texts array<string>, zones array<int>, links array<double>"


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_PARSED)
        for batch in batches:
            found = [blocks_of(h) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), *[
                    pa.array([[b[k] for b in page] for page in found], schema.field(3 + k).type) for k in range(3)]], schema=schema)

    return rows.mapInArrow(run, _PARSED)


def _runs(batch_rows: list[tuple[int, str, list[str]]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, number of group) for every place where ``run`` tokens of a page follow, neighbours in the suffix array together."""
    symbols, page, at = [], [], []
    for page_id, host, texts in batch_rows:
        tokens = word_hashes("\n".join(texts))
        if len(tokens) < run:
            continue
        seed = word_hashes(host or "-")[0]
        symbols += [np.maximum(mix(tokens ^ seed), np.uint64(1)), np.zeros(1, np.uint64)]
        page.append(np.full(len(tokens) + 1, page_id, np.int64))
        at.append(np.arange(len(tokens) + 1))
    if not symbols:
        return np.empty(0, _HEAD), np.empty(0, np.int64)
    symbols, page, at = np.concatenate(symbols), np.concatenate(page), np.concatenate(at)
    _, ranks = np.unique(symbols, return_inverse=True)
    breaks = np.flatnonzero(symbols == 0)
    ranks = ranks + len(breaks)
    ranks[breaks] = np.arange(len(breaks))
    order = suffix_array(ranks)
    group = np.cumsum(np.r_[0, common_prefixes(ranks, order, run) < run])
    key = np.zeros(len(symbols), np.uint64)
    padded = np.r_[symbols, np.zeros(run, np.uint64)]
    for k in range(run):
        key = mix(key) + padded[k:k + len(symbols)]
    ends = np.repeat(breaks, np.diff(np.r_[-1, breaks]))
    whole = (ends - np.arange(len(symbols)) >= run)[order]
    rows = np.empty(len(order), _HEAD)
    rows["key"], rows["page"], rows["at"] = mix(key)[order], page[order], at[order]
    return rows[whole], group[whole]


def _repeats(parsed: DataFrame, params: PageParams, parts: int) -> DataFrame:
    """(page_id, at): where a run starts that another page of the host has too."""
    streams = parsed.select("page_id", "host", F.expr(f"transform(filter(arrays_zip(texts, zones), x -> x.zones in ({EXCLUDED}, {ELSEWHERE})), x -> x.texts)").alias("texts")).where("page_id is not null")

    def several(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        many = np.maximum.reduceat(rows["page"], first) != np.minimum.reduceat(rows["page"], first)
        return first, np.repeat(many, np.diff(np.r_[first, len(rows)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = list(zip(*[c.to_pylist() for c in batch.columns]))
            for start in range(0, len(every), 4096):
                rows, group = _runs(every[start:start + 4096], params.run)
                if len(rows):
                    first, known = several(rows, group)
                    # One head of a run known to repeat; else all its places, as another lot may show it to repeat.
                    heads = ~known
                    heads[first] = True
                    heads, known = rows[heads], rows[known]
                    yield from _blobs(_by_part(heads, heads["key"], parts, 0) + _by_part(known, mix(known["page"].view(np.uint64)), parts, 1))

    def meet(frame):
        import pandas as pd

        tables = [[np.frombuffer(d, _HEAD) for d in frame["data"][frame["kind"] == kind]] for kind in (0, 1)]
        heads, found = (np.concatenate(t) if t else np.empty(0, _HEAD) for t in tables)
        if len(heads):
            heads = heads[np.argsort(heads["key"], kind="stable")]
            found = np.concatenate([found, heads[several(heads, heads["key"])[1]]])
        return pd.DataFrame({"page_id": found["page"], "at": found["at"]})

    return streams.mapInArrow(run, "part int, kind int, data binary").repartition(parts, "part").groupBy("part").applyInPandas(meet, "page_id long, at int")


def main_text(pages: DataFrame, params: PageParams = PageParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Defined cases: null and empty pages have the empty text; pages without a url share one unnamed host; rows that share a page_id are one page
    for repetition; pages with a null page_id are read by structure alone; repeated rows give repeated rows; other columns are ignored;
    an empty table gives an empty table.
    """
    parsed = materialise(_parsed(pages, id_col, url_col, html_col))
    spark = pages.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level = F.when(F.array_contains("zones", ARTICLE), ARTICLE).when(F.array_contains("zones", MAIN), MAIN).otherwise(ELSEWHERE)
    levelled = parsed.withColumn("level", level)
    text = F.expr("array_join(transform(filter(arrays_zip(texts, zones), x -> x.zones = level), x -> x.texts), '\n')")
    by_structure = levelled.where((F.col("level") != ELSEWHERE) | F.col("page_id").isNull()).select("page_id", "url", text.alias("text"))

    open_pages = levelled.where((F.col("level") == ELSEWHERE) & F.col("page_id").isNotNull()).drop("level")
    repeats = _repeats(parsed, params, parts).groupBy("page_id").agg(F.collect_set("at").alias("at"))
    ddl = "page_id long, url string, text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            texts = [_unique_rest(t, z, l, a or [], params) for t, z, l, a in zip(*[batch.column(c).to_pylist() for c in ("texts", "zones", "links", "at")])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], schema=schema)

    by_repeats = open_pages.join(repeats, "page_id", "left").select("page_id", "url", "texts", "zones", "links", "at").mapInArrow(run, ddl)
    return by_structure.unionByName(by_repeats).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _unique_rest(texts: list[str], zones: list[int], links: list[float], at: list[int], params: PageParams) -> str:
    """Blocks elsewhere that are neither mostly repeated nor mostly links."""
    counts = [len(word_hashes(t)) for t in texts]
    total = sum(counts)
    repeated = np.zeros(total + params.run, bool)
    for start in at:
        repeated[start:start + params.run] = True
    kept, place = [], 0
    for text, zone, linked, n in zip(texts, zones, links, counts):
        covered = repeated[place:place + n].sum()
        place += n
        if zone == ELSEWHERE and covered <= params.share * n and linked <= params.share:
            kept.append(text)
    return "\n".join(kept)
