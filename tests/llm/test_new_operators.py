"""URL filter, filter audit and conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from profilekit.llm import conversation_trie, filter_audit, spread, url_filter

# --- URL filter -----------------------------------------------------------------------------------------


def brute_verdict(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best[3] if best else None, best[4] if best else default


label = st.sampled_from(["a", "b", "com", "www", ""])
hosts = st.lists(label, min_size=1, max_size=3).map(".".join)
paths = st.lists(st.sampled_from(["", "a", "ab", "en", "e"]), max_size=4).map("/".join)
rule_lists = st.lists(st.tuples(st.sampled_from(["allow", "block"]), hosts, paths), max_size=8)


@given(rule_lists, st.lists(st.tuples(hosts, paths), max_size=8))
@settings(max_examples=200, deadline=None)
def test_trie_finds_the_longest_rule(rules, places):
    trie = url_filter.UrlTrie(rules)
    for host, path in places:
        url = f"x://{host}{'/' if path and not path.startswith('/') else ''}{path}"
        want = brute_verdict(url, rules)
        got = trie.longest(want[0], want[1])
        assert ((got[1] + got[2], got[0]) if got else (None, "allow")) == want[2:]


URLS = [
    (1, "https://WWW.Example.com/en/1?x=/de/"), (2, "http://blog.example.com/en/2"), (3, "http://example.com/de#/en/"), (4, "example.com/en/"), (5, None),
    (6, ""), (7, "ftp://net/es/"), (8, "http://a.net/es"), (9, "a://b://c.com/x"), (None, "http://x.com/"), (10, "http://notcom/"), (11, "http://x.com"),
    (12, "http://com/" + "a/" * 20_000), (13, "http://" + "a." * 2_000 + "com/"), (1, "https://WWW.Example.com/en/1?x=/de/"), (14, "http://x.com/en\n/é"), (15, "http://[::1]:80/x"),
]
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "x.com", "/e"),
         ("allow", "x.com", "/e"), ("block", "", ""), ("block", "com", "/a/a/")]


def test_url_filter(spark):
    df = spark.createDataFrame([(i, u, "r", "v", "h") for i, u in URLS], "page_id long, url string, rule string, verdict string, host string")
    rules = url_filter.rule_table(spark, RULES)
    want = sorted(((i, *brute_verdict(u, RULES)) for i, u in URLS), key=str)
    for limit in (1_000_000, 0):
        got = url_filter.judge_urls(df, rules, url_filter.UrlFilterParams(max_trie_chars=limit))
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert url_filter.judge_urls(df.limit(0), rules, url_filter.UrlFilterParams(max_trie_chars=limit)).count() == 0
    none = url_filter.judge_urls(df, rules.limit(0), url_filter.UrlFilterParams(default="block"))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}


# --- filter audit ---------------------------------------------------------------------------------------


def brute_audit(rows, marks):
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    masks = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and low[t] < i}
        masks.append((part or "", fails, *[any(m[k] == 1 for m in marks if m[0] == i and i is not None) for k in (1, 2)]))
    out, shapley = [], {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = [m for m in mine if not any(m[1][g] for g in order[:step - 1])]
                gone = [m for m in before if m[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, order, step, len(before) - len(gone), len(gone), sum(m[1][f] for m in mine) - len(gone),
                            sum(m[1][f] and sum(m[1].values()) == 1 for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)))
    return sorted((*o, shapley[o[0], o[1][o[2] - 1]]) for o in out)


AUDIT_COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "Bb", "c\u00a0d", "E#", "Ü"]) + str(r.randrange(k)) for _ in range(n)), r.choice(["en", "de", None, ""]))
            for i, (n, k) in enumerate((r.choice([0, 1, 99, 100, 101, 150]), r.choice([3, 60, 500])) for _ in range(60))]
    rows += [(1000 + i, rows[7][1], "en") for i in range(40)] + [(500, None, None), (501, "", "de"), (None, rows[7][1], "en"), (None, None, "fr")]
    rows += [(7, *rows[7][1:]), (7, "other", "de"), (600, "\x0b \t", "en"), (601, "w" * 50_000 + " " + "v " * 90_000, "en"), (602, "ab\u200b" * 9, "nul")]
    marks = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 1000, 3)] + [(1001, None, 1), (1001, 1, None), (None, 1, 1)]
    ddl = "doc_id long, text string, lang string, word string, shard string, n long, part string, good int, mask int"
    docs = spark.createDataFrame([(*row, "x", "y", 1, "p", 1, 2) for row in rows], ddl).repartition(5)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, marks)
    for params in (filter_audit.AuditParams(), filter_audit.AuditParams(shard_bytes=3_000, bucket_words=50)):
        got = filter_audit.audit(docs, labels, params)
        assert set(got.columns) == set(AUDIT_COLUMNS)
        assert sorted(map(tuple, got.select(*AUDIT_COLUMNS).collect())) == want
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.failed_filters(docs, labels.limit(0)).agg({"good": "sum"}).first()[0] == 0


def test_global_matrix(spark):
    r = random.Random(2)
    rows = [(i, i, " ".join(f"w{r.randrange(400)}" for _ in range(r.choice([0, 1, 40]))), "en") for i in range(80)]
    params = filter_audit.AuditParams(shard_bytes=900, bucket_words=60)
    shards = spark.createDataFrame(rows, "row long, doc_id long, text string, part string").repartition(3)
    shards = filter_audit.materialise(filter_audit.csr_shards(shards, params))
    got, used = {}, set()
    for row in filter_audit.renumbered(shards, params).collect():
        indptr, columns, data = filter_audit.global_matrix({**row.asDict(), "columns": [c.asDict() for c in row["columns"] or []]})
        for k, doc_id in enumerate(row["doc_id"]):
            mine = columns[indptr[k]:indptr[k + 1]].tolist()
            assert mine == sorted(set(mine))
            used |= set(mine)
            got[doc_id] = sorted(zip(mine, data[indptr[k]:indptr[k + 1]].tolist()))
    words = sorted({w for _, _, t, _ in rows for w in t.split()})
    assert shards.count() > 5 and sorted(used) == list(range(len(words)))
    number = {}
    for _, doc_id, text, _ in rows:
        want = {w: text.split().count(w) for w in text.split()}
        assert sorted(want.values()) == sorted(n for _, n in got[doc_id])
        for column, _ in got[doc_id]:
            number[column] = number.get(column, set(words)) & set(want)
    assert all(number.values())


# --- conversation trie ----------------------------------------------------------------------------------


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    original = {c: [(r[2], r[4]) for r in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = original.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [totals[x] for x in children.get(path, [])]
        own = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        totals[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(((
        min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *totals[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items()), key=str)


TRIE_DDL = "conv_id long, turn long, role string, text string, depth int, a long, part string, leaves long"


def trie_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], TRIE_DDL)


def conversations(seed, blocks=3, long_turns=90):
    r = random.Random(seed)
    rows = []
    for c in [100 * b + i for b in range(blocks) for i in r.sample(range(100), 30)]:
        for t in range(r.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "ho", "x" * 40, "", None, "é"])))
    # Copies, growing snapshots, a very long conversation and one like it, ties, null turns and ids, a very long text.
    for c in range(1000, 1040):
        rows += [(c, t, "user", f"same {t}") for t in range(8)]
    for c in range(2000, 2030):
        rows += [(c, t, "user", f"grows {t}") for t in range(c - 1999)]
    for c in (3000, 3001):
        rows += [(c, t, "u", f"long {t}" + ("!" if c == 3001 and t > long_turns // 2 else "")) for t in range(long_turns)]
    rows += [(4000, 1, "b", "y"), (4000, 1, "a", "z"), (4000, 1, "a", "x"), (4000, None, "n", "first"), (None, 1, "u", "lost"), (4001, 0, "u", "z" * 60_000)]
    rows += [(5000, 0, "u", "again")] * 30 + [(-5, 0, "u", "neg"), (-150, 2, None, None), (0, 0, "user", "hi")]
    return rows


PARAMS = [
    conversation_trie.TrieParams(),
    conversation_trie.TrieParams(shard_rows=20, band_nodes=10**6, queue_items=3),
    conversation_trie.TrieParams(shard_rows=8, band_nodes=6, band_levels=3, queue_items=2),
]


@pytest.mark.parametrize("which", range(3))
def test_trie_equals_brute_force(spark, monkeypatch, which):
    monkeypatch.setattr(spread, "LEAST_HOT", 1 if which else 1_000)
    monkeypatch.setattr(spread, "SHARES", 16 if which else 1_024)
    rows = conversations(which)
    random.Random(1).shuffle(rows)
    got = conversation_trie.prefix_trie(trie_table(spark, rows).repartition(7), PARAMS[which])
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(trie_table(spark, [])).count() == 0
    assert conversation_trie.prefix_trie(trie_table(spark, [(None, 1, "u", "t")])).count() == 0


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.integers(0, 3), st.integers(0, 9)), max_size=300), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_queue_spills_without_loss(tmp_path_factory, messages, limit):
    queue = conversation_trie.SpillingQueue(limit, str(tmp_path_factory.mktemp("queue")))
    queue.MOST_RUNS = 3
    want = {}
    for depth, conv_id, leaves, saved in messages:
        queue.push(depth, conv_id, 1, leaves, saved)
        sums = want.setdefault((-depth, conv_id), [0, 0, 0])
        want[-depth, conv_id] = [sums[0] + 1, sums[1] + leaves, sums[2] + saved]
    for depth, conv_id in sorted(want):
        assert queue.take(-depth, conv_id) == tuple(want[depth, conv_id])
    assert queue.empty() and (queue.spilled > 0) == (len(messages) > limit)
