"""The numbered queries over the shared tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit.llm import byte_bpe, chat_template, conversation_trie, ctph, exact_dedup, filter_audit, jaccard_join, mixing, page_text, secret_scan, suffix_dedup, toxicity, url_filter
from profilekit.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_toxicity")
def _toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


@query("op2_page_text")
def _page_text(spark, folder):
    return page_text.main_text(table(spark, folder, "pages"))


@query("op3_fingerprints")
def _fingerprints(spark, folder):
    return ctph.with_next(table(spark, folder, "documents"))


@query("op4_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""")
def _exact_dedup(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op5_jaccard_join")
def _jaccard_join(spark, folder):
    return jaccard_join.near_groups(table(spark, folder, "documents"))


@query("op6_chat_format")
def _chat_format(spark, folder):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_template.read_back(chat_template.format_conversations(rows))


@query("op7_suffix_dedup")
def _suffix_dedup(spark, folder):
    return suffix_dedup.repeated_spans(table(spark, folder, "documents"))


@query("op9_secret_scan")
def _secret_scan(spark, folder):
    return secret_scan.scan(table(spark, folder, "documents"))


@query("op8_byte_bpe")
def _byte_bpe(spark, folder):
    return byte_bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


#: Half of the tokens in English, the rest alike; documents of small sources may be seen up to four times.
MIX = mixing.MixParams(weights={"lang": {"en": 3, "de": 1, "fr": 1, "es": 1}})


@query("op10_mix")
def _mix(spark, folder):
    chosen = mixing.mix(table(spark, folder, "documents"), MIX)
    return chosen.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"))


#: (verdict, host, path): the rules that op11 judges all pages by.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query("op11_url_filter", r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r(verdict, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT p.host, p.path, arg_max(h || s, (length(h || s), length(h))) AS rule, arg_max(verdict, (length(h || s), length(h))) AS verdict
      FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, s) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path""")
def _url_filter(spark, folder):
    return url_filter.judge_urls(table(spark, folder, "pages"), url_filter.rule_table(spark, URL_RULES))


@query("op12_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''] AS ws, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
f AS (SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(lowest < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, 1 << instr('ABCDE', filter_order[step]) - 1 AS bit,
        list_sum([1 << instr('ABCDE', g) - 1 for g in string_split(left(filter_order, step - 1), '') if g <> ''])::INT AS earlier
      FROM o, range(1, 6) r(step)),
c AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (bit | coalesce(earlier, 0)) = 0) AS kept,
        sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS removed,
        sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS good_lost,
        sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM c""")
def _filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_conversation_trie", r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id, bit by bit: a byte goes in, then eight steps.
n AS (SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(flatten([[4294967295::BIGINT],
        flatten([[ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split(conv_id::VARCHAR, '')])]),
        lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)) % 6 AS h FROM o GROUP BY 1),
k AS (SELECT n.conv_id, n.n, n.h, least(n.h, coalesce(b.n, 0)) AS k FROM n LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % 100),
r AS (SELECT k.conv_id, o.pos AS d, role, text FROM k JOIN o ON o.conv_id = k.conv_id - k.conv_id % 100 AND o.pos <= k.k
      UNION ALL SELECT conv_id, o.pos - k.h + k.k, role, text FROM k JOIN o USING (conv_id) WHERE o.pos > k.h),
p AS (SELECT conv_id, d, text, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
      UNION ALL SELECT conv_id, 0, '', [] FROM k),
g AS (SELECT conv_id, d, text, min(conv_id) OVER (PARTITION BY d, path) AS node, d = max(d) OVER (PARTITION BY conv_id) AS at_end FROM p),
v AS (SELECT node AS conv_id, d AS depth, count(*) AS n_convs, (count(*) - 1) * max(length(text)) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256 FROM g GROUP BY 1, 2),
e AS (SELECT v.conv_id, v.depth, g.node AS parent FROM v JOIN g ON g.conv_id = v.conv_id AND g.d = v.depth - 1),
c AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM e GROUP BY 1, 2),
t AS (SELECT g.node AS conv_id, g.d AS depth, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum(v.saved) AS saved_tokens
      FROM v LEFT JOIN c USING (conv_id, depth) JOIN g ON g.conv_id = v.conv_id AND g.d <= v.depth GROUP BY 1, 2)
SELECT v.conv_id, v.depth, e.parent AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN t USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth) LEFT JOIN c USING (conv_id, depth)""")
def _conversation_trie(spark, folder):
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"))
