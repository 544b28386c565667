"""Exact copies, near copies and repeated byte strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from profilekit.llm import exact_dedup, jaccard_join, suffix_dedup
from profilekit.llm.links import components
from profilekit.llm.shingles import shingle_set
from profilekit.llm.suffix_array import common_prefixes, suffix_array

DDL = "doc_id long, text string, lang string, kept string, fingerprint long, n long, pairs string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 7, 8, "y") for i, t in rows], DDL)


def words(random_, n, vocabulary=400):
    return [f"w{random_.randrange(vocabulary)}" for _ in range(n)]


# --- exact ----------------------------------------------------------------------------------------------

@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), max_size=30), max_size=6), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_filters_merge_without_loss(parts, bits):
    merged = exact_dedup.merge_filters([exact_dedup.filter_of(np.array(p, np.uint64)) for p in parts])
    want = exact_dedup.filter_of(np.array([x for p in parts for x in p], np.uint64))
    assert merged[0].tolist() == want[0].tolist() and merged[1].tolist() == want[1].tolist()
    back = []
    for slot, remainders, counts in exact_dedup.cut_by_quotient(*merged, bits):
        assert (np.diff(remainders.astype(object)) > 0).all()
        back += [(int(r) | (slot << (64 - bits) if bits else 0), int(c)) for r, c in zip(remainders, counts)]
    assert back == list(zip(merged[0].tolist(), merged[1].tolist()))


def test_exact_groups(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (4, None), (9, ""), (8, "a b"), (2, "A b"), (2, "A b"), (7, "x" * 300_000), (6, "x" * 300_000), (1, "only"), (11, "a\u00a0b")]
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(table(spark, rows)).collect())
    norm = {}
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in norm.items() for i in ids)
    assert got == want
    kept = exact_dedup.drop_exact_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 11]
    again = exact_dedup.drop_exact_copies(table(spark, [(2, "b"), (2, "a"), (1, "b"), (None, "c"), (None, "c")]))
    assert sorted(((r.doc_id, r.text) for r in again.collect()), key=str) == [(1, "b"), (2, "a"), (None, "c")]
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


# --- near -----------------------------------------------------------------------------------------------

def brute_components(rows, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            union = len(sets[a] | sets[b])
            if union and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * union:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_rows(seed=1):
    r = random.Random(seed)
    rows, i = [], 0
    for n in (3, 4, 9, 10, 11, 30, 60, 200, 900):
        for _ in range(4):
            base = words(r, n)
            for _ in range(r.randrange(1, 9)):
                copy = list(base)
                for _ in range(r.randrange(0, 1 + n // 25 + 1)):
                    copy[r.randrange(n)] = f"e{r.randrange(9)}"
                if r.random() < 0.3:
                    copy = copy[r.randrange(0, 1 + n // 20):]
                rows.append((i, (" " if r.random() < 0.5 else "\n").join(copy).upper() if r.random() < 0.3 else " ".join(copy)))
                i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "one"), (i + 4, "one"), (i + 5, "ONE two"), (i + 6, "É é"), (i + 7, "é é")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,words_,percent", [(2048, 4, 85), (6, 4, 85), (2048, 5, 80)])
def test_near_groups(spark, monkeypatch, chunk, words_, percent):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rows = near_rows()
    got = jaccard_join.near_groups(table(spark, rows), jaccard_join.JoinParams(words=words_, percent=percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, words_, percent)
    assert len(got) == len(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 32)
    r = random.Random(5)
    base = words(r, 120, 10_000)
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.randrange(0, 8)):
            copy[r.randrange(120)] = f"e{r.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_groups(table(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85)


def test_near_groups_defined_cases(spark):
    assert jaccard_join.near_groups(table(spark, [])).count() == 0
    text = " ".join(f"v{k}" for k in range(40))
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.near_groups(table(spark, [(None, text), (2, text), (1, text), (1, text)])).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
    kept = jaccard_join.keep_one_each(table(spark, [(None, text), (2, text), (1, text + " more")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, None] and "fingerprint" in kept.columns


@given(st.integers(0, 10**6), st.integers(6, 400), st.sampled_from([80, 85, 90]))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_an_indexed_and_a_probing_signature(seed, n, percent):
    params = jaccard_join.JoinParams(percent=percent)
    r = np.random.default_rng(seed)
    x = r.integers(0, 2**64, n, dtype=np.uint64)
    most = int(params.difference(2 * n))
    y = np.r_[x[: n - r.integers(0, most // 2 + 1)], r.integers(0, 2**64, r.integers(0, most // 2 + 1), dtype=np.uint64)]
    x, y = np.unique(x), np.unique(y)
    common = len(np.intersect1d(x, y))
    if not params.linked(common, len(x) + len(y)) or np.array_equal(x, y):
        return
    bands = jaccard_join.Bands(params)
    (s, p), (t, q) = jaccard_join.signatures(x, bands), jaccard_join.signatures(y, bands)
    roles = {}
    for sig, role in zip(s.tolist(), p.tolist()):
        roles[sig] = roles.get(sig, 0) | role
    assert any((roles.get(sig, 0) & 1 and role & 2) or (roles.get(sig, 0) & 2 and role & 1) for sig, role in zip(t.tolist(), q.tolist()))
    a, b = (np.frombuffer(jaccard_join.parity_sketch(z), np.uint8) for z in (x, y))
    assert np.bitwise_count(a ^ b).sum() <= len(x) + len(y) - 2 * common


def test_allowances_sum_up():
    r = np.random.default_rng(2)
    for _ in range(200):
        m = int(r.integers(1, 60))
        counts, needed = r.poisson(4, m), int(r.integers(1, m + 1))
        got = jaccard_join.allot(counts, needed, -(-m // 4))
        assert got.sum() == needed and got.max() <= 2 and (got[-(-m // 4):] <= 1).all()


def test_long_texts_are_read_in_blocks(monkeypatch):
    from profilekit.llm import shingles

    text = " ".join(words(random.Random(3), 3_000))
    whole = shingle_set(text, 4)
    monkeypatch.setattr(shingles, "_BLOCK", 64)
    assert np.array_equal(whole, shingle_set(text, 4))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(20)] + [(5, 5)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated byte strings ------------------------------------------------------------------------------

@given(st.lists(st.integers(0, 3), max_size=40) | st.lists(st.integers(0, 1), min_size=1, max_size=4).map(lambda x: x * 9))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols):
    order = suffix_array(np.array(symbols, np.int64))
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    shared = common_prefixes(np.array(symbols, np.int64), order, 3)
    for k, n in enumerate(shared.tolist()):
        a, b = symbols[order[k]:][:3], symbols[order[k + 1]:][:3]
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_spans(rows, length):
    seen = {}
    for _, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            seen[raw[s:s + length]] = seen.get(raw[s:s + length], 0) + 1
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.r_[False, gone]) & gone).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("often", [1_000, 2])
def test_repeated_spans(spark, often):
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefgh ijklmnoé") for _ in range(n))
    passage, other = letters(520), letters(405)
    rows = [(k, letters(r.randrange(0, 700)) + passage + letters(r.randrange(0, 700))) for k in range(6)]
    rows += [(10, letters(300) + passage[40:470] + letters(100)), (11, other + letters(50) + other), (12, passage[:399]), (13, None), (14, ""),
             (15, "ab" * 700), (16, "x" * 900), (17, "the same" * 30), (18, "the same" * 30), (19, letters(900)), (20, letters(390))]
    rows += [(21, rows[-2][1]), (22, letters(2_000)), (23, rows[0][1][200:]), (24, letters(450))]
    got = suffix_dedup.repeated_spans(table(spark, rows), suffix_dedup.RepeatParams(often=often)).drop("spans").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_spans(rows, 400)


def test_repeated_spans_defined_cases(spark):
    assert suffix_dedup.repeated_spans(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.RepeatParams(length=200)
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(500))
    got = suffix_dedup.repeated_spans(table(spark, [(None, text), (1, text), (1, text), (2, text[:399])])).collect()
    assert sorted((r.n_removed, r.n_spans) for r in got) == [(0, 0), (500, 1), (500, 1), (500, 1)]


def test_phrases_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(2)
    data = np.frombuffer("".join(r.choice("abcdef ") for _ in range(9_000)).encode(), np.uint8)
    marks, hashes = suffix_dedup.phrases(data, suffix_dedup.RepeatParams())
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 700)
    again, others = suffix_dedup.phrases(data, suffix_dedup.RepeatParams())
    assert marks.tolist() == again.tolist() and hashes.tolist() == others.tolist() and len(marks) == len(hashes) + 1


def spans_without_spark(rows, params):
    """What the tasks of repeated_spans do, one after the other."""
    pairs, _ = suffix_dedup._pair_groups([i for i, _ in rows], [t for _, t in rows], params)
    keys, n = np.unique(pairs["key"], return_counts=True)
    starts, runs = [], []
    for i, t in rows:
        own = pairs[(pairs["doc"] == i) & np.isin(pairs["key"], keys[n > 1])]
        if not len(own):
            continue
        judge, low, high = suffix_dedup._owners(len(t), own["key"], own["low"].astype(int), own["high"].astype(int), params)
        for j, a, b in zip(judge.tolist(), low.tolist(), high.tolist()):
            starts += [((int(own["key"][j]), t[s:s + params.length]), i, s) for s in range(a, b)]
    seen = {}
    for key, i, s in starts:
        seen.setdefault(key, []).append((i, s))
    for places in seen.values():
        runs += places if len(places) > 1 else []
    return {i: suffix_dedup.covered([(s, s + 1) for k, s in runs if k == i], params.length) for i, _ in rows}


@pytest.mark.parametrize("seed", range(40))
def test_copies_in_different_surroundings(seed):
    r = random.Random(seed)
    params = suffix_dedup.RepeatParams()
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage = letters(r.choice((400, 401, 430, 600)))
    rows = [(k, letters(r.randrange(0, 500)) + passage + letters(r.randrange(0, 500))) for k in range(3 + seed % 8)]
    got = spans_without_spark(rows, params)
    for (i, t), (_, _, gone, n, _) in zip(rows, brute_spans(rows, params.length)):
        assert (sum(b - a for a, b in got[i]), len(got[i])) == (gone, n)


def test_windows_of_marks_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(3)
    data = np.frombuffer("".join(r.choice("abcdef ") for _ in range(9_000)).encode(), np.uint8)
    want = [x.tolist() for x in suffix_dedup._phrases(data, suffix_dedup.RepeatParams())]
    for block in (150, 264, 700, 1_001):
        monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
        assert [x.tolist() for x in suffix_dedup._phrases(data, suffix_dedup.RepeatParams())] == want


def test_signatures_meet_without_pandas(spark):
    """The parts of signatures and the texts of a batch are walked as Arrow; a batch is never whole Python lists."""
    import pyarrow as pa
    from profilekit.llm import jaccard_join
    from profilekit.llm.common import slices

    texts = ["x" * (3 << 20), "y" * (3 << 20), None, "z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts})
    found = [(start, len(t)) for start, t in slices(batch)]
    assert found == [(0, 1), (1, 3)]
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "doc_id long, text string")
    plan = jaccard_join._met(jaccard_join._signature_blobs(docs, jaccard_join.JoinParams(), 1), 1)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan


def test_rows_with_whole_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Texts of both sides of a pair are handed over a few rows at once; the setting is the session's own again afterwards."""
    from profilekit.llm import jaccard_join
    from profilekit.session import batch_rows

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, write = spark.conf.get(name), [], jaccard_join.materialise

    def noted(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if "MapInArrow" in plan and "text" in plan:
            seen.append(int(spark.conf.get(name)))
        return write(df)

    docs = [(k, " ".join(f"w{(k % 7) * 100 + j}" for j in range(60)) + f" end{k}") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {k: k % 7 for k, _ in docs}
    monkeypatch.setattr(jaccard_join, "TEXT_ROWS", 2)
    monkeypatch.setattr(jaccard_join, "materialise", noted)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_groups(df).collect()} == want
    assert len(seen) >= 3 and set(seen) == {2} and spark.conf.get(name) == before
    with batch_rows(spark, 3):
        sizes = spark.range(0, 10, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long").count()
    assert sizes == 4


def test_signatures_with_the_same_members_are_one_bucket(spark, monkeypatch):
    """Near copies share hundreds of signatures; their pair is looked for once, not once per signature."""
    seen, look = [], jaccard_join._candidates

    def noted(buckets, params, forest):
        seen.append(buckets.count())
        return look(buckets, params, forest)

    r = random.Random(5)
    docs = []
    for group in range(4):
        base = words(r, 1_500, 10**6)
        docs += [(10 * group + k, " ".join(base[:700] + [f"edit{k}"] + base[701:])) for k in range(3)]
    monkeypatch.setattr(jaccard_join, "_candidates", noted)
    got = jaccard_join.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {d: d // 10 * 10 for d, _ in docs}
    assert 0 < seen[0] <= 4 * 3 * 40


def test_sketches_of_long_unlinked_sets_are_apart():
    """Sets of 1,500 shingles that share half of them are no candidates."""
    params = jaccard_join.JoinParams()
    x, y = (np.random.default_rng(s).integers(0, 2**64, 1_500, dtype=np.uint64) for s in (1, 2))
    y[:750] = x[:750]
    a, b = (np.frombuffer(jaccard_join.parity_sketch(np.unique(z)), np.uint8) for z in (x, y))
    assert int(params.difference(3_000)) < int(np.bitwise_count(a ^ b).sum()) <= 1_500
