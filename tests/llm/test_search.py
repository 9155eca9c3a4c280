"""Decontamination, filter audit and ranked search against brute force on a small fixture with every odd case."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from estatelens.llm import decontamination, filter_audit, lexical_search
from tests.llm.conftest import edge_rows, make, words

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spoken(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def items():
    """Windows in the fixture: passages, short items, repeats inside an item, nulls, repeated and missing ids."""
    texts = {i: t for i, t in edge_rows() if i is not None}
    one, two = texts[0], texts[5].upper()
    return [
        (1, " ".join(one.split()[:14])), (2, "no such words here at all in any text of them"), (3, " ".join(two.split()[3:8])), (4, "x"), (5, None), (6, ""), (7, "word " * 12), (7, "Apache License, Version"),
        (8, " ".join(one.split()[20:33]) + " qqq " + " ".join(one.split()[34:50])), (None, "ÜNÏCÖDÉ ▁ ﬁ 中文"), (9, "Ünïcödé ▁ ﬁ 中文"), (10, "a" * 50000), (11, "the token the token"), (12, " ".join(texts[507].split()[20000:20200])),
    ]


def brute_contamination(rows, tests, window=10):
    windows = defaultdict(set)
    for item_id, text in tests:
        w = spoken(text)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            windows[size, tuple(w[s : s + size])].add("" if item_id is None else str(item_id))
    sizes = {s for s, _ in windows}
    out = []
    for doc_id, text in rows:
        w, hit, found = spoken(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if got := windows.get((size, tuple(w[s : s + size]))):
                    hit.update(range(s, s + size))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def tests_table(spark):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in items()], "item_id long, text string, doc_id string, row int")


@pytest.mark.parametrize("vocabulary", [decontamination.VOCABULARY_BROADCAST, 0])
def test_contamination(spark, edge, tests_table, vocabulary, monkeypatch):
    monkeypatch.setattr(decontamination.build_index, "__defaults__", (vocabulary,))
    assert Counter(map(tuple, decontamination.contamination(edge, tests_table).collect())) == brute_contamination(edge_rows(), items())


def test_contamination_of_frequent_words(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices("abc", k=rng.randrange(0, 60)))) for k in range(120)] + [(1000 + k, "a b " * 30 + "c") for k in range(20)]
    asked = [(k, " ".join(rng.choices("abc", k=rng.randrange(1, 9)))) for k in range(12)] + [(50, "a b " * 8)]
    table = spark.createDataFrame(asked, "item_id long, text string")
    assert Counter(map(tuple, decontamination.contamination(make(spark, rows), table, 6).collect())) == brute_contamination(rows, asked, 6)


def test_postings_do_not_move_when_rows_are_looked_up(spark, edge, tests_table):
    index = decontamination.build_index(edge, tests_table)
    few = index.headers().filter("n_words > 100").select("row").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontamination._of_rows(index, few)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # both sides lie in the buckets of their rows: nothing is dealt out anew
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity(spark, slop):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=40))) for k in range(60)]
    asked = [(1, "a b c"), (2, "h"), (3, "d d e"), (4, "zz a")]
    index = decontamination.build_index(make(spark, rows).coalesce(1), spark.createDataFrame(asked, "item_id long, text string"))
    named = decontamination.proximity_matches(index, slop).join(index.items.select("item", "item_id"), "item").join(index.headers(), "row")
    got = {(r["doc_id"], r["item_id"], r["diagonal"], r["spread"]) for r in named.collect()}
    count, want = Counter(w for _, t in rows for w in t.split()), set()
    for item_id, text in asked:
        terms = text.split()
        rare = min(range(len(terms)), key=lambda k: (count[terms[k]], k))
        for doc_id, t in rows:
            w = t.split()
            for at in (p - rare for p, x in enumerate(w) if x == terms[rare]):
                apart = [min((abs(p - at - k) for p, x in enumerate(w) if x == term), default=99) for k, term in enumerate(terms)]
                if max(apart) <= slop:
                    want.add((doc_id, str(item_id), at, max(apart)))
    assert got == want and want


def brute_audit(rows, labels):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    state = []
    for i, part, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i)
        mine = [x for x in labels if i is not None and x[0] == i]
        state.append((part or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out, shapley = [], Counter()
    for order in permutations("ABCDE"):
        gone = [False] * len(state)
        for step, name in enumerate(order, 1):
            f, now = "ABCDE".index(name), defaultdict(Counter)
            for k, (part, fails, good, toxic) in enumerate(state):
                removed = not gone[k] and fails[f]
                now[part].update(kept=not gone[k] and not fails[f], removed=removed, redundant=gone[k] and fails[f], unique=fails[f] and sum(fails) == 1, good=removed and good, toxic=removed and toxic)
                gone[k] |= removed
                shapley[part, name] += removed
            out += [(part, "".join(order), step, name, *(c[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic"))) for part, c in now.items()]
    return Counter((*x[:3], *x[4:], shapley[x[0], x[3]]) for x in out)


def test_filter_audit(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(0, 120), rng.choice([20, 300])) for _ in range(60)] + [words(rng, 70) + " #", words(rng, 70).upper(), "A B", None, "", " \n", "É" * 60 + " Ab"]
    rows = [(None if k % 17 == 0 else k % 150, [None, "", "s1", "s2", "only"][min(4, rng.randrange(80) // 15)], texts[rng.randrange(len(texts))]) for k in range(200)]
    labels = [(k % 90, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for k in range(110)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, fails int, n int, first long").repartition(3)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert Counter(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_lattice_and_steps():
    assert len(set(filter_audit.lattice())) == 80 and len(filter_audit.steps()) == 600
    assert {(b, f) for _, _, b, f in filter_audit.steps()} == set(filter_audit.lattice())


def test_filters_on_the_edge_fixture(edge):
    rows = edge_rows()
    got = Counter((r["doc_id"], r["fails"]) for r in filter_audit.failures(edge, "source").collect())
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = Counter((i, filter_audit.failed_alone((t or "").encode()) | 16 * (i is not None and first[t or ""] < i)) for i, t in rows)
    assert got == want


def ranked(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def brute_search(rows, asked, k):
    docs = [(i, Counter(ranked(t))) for i, t in rows if ranked(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in asked:
        found = []
        for doc_id, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(ranked(text)) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("docs_a_block", "items_a_block"), [(1024, 1024), (3, 4)])
def test_ranked_search(spark, edge, tests_table, docs_a_block, items_a_block, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", docs_a_block)
    monkeypatch.setattr(lexical_search, "QUERY_ITEMS", items_a_block)
    assert Counter(map(tuple, lexical_search.ranked_search(edge, tests_table, 5).collect())) == brute_search(edge_rows(), items(), 5)


def test_best_takes_ties_by_id():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores, ids, k = rng.integers(0, 5, 40), rng.permutation(40), int(rng.integers(1, 12))
        want = sorted((-s, i, n) for n, (s, i) in enumerate(zip(scores.tolist(), ids.tolist(), strict=True)) if s > 0)[:k]
        assert lexical_search.best(scores, ids, k).tolist() == [n for *_, n in want]


def test_empty_tables(spark, empty, edge, tests_table):
    none, labels = tests_table.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontamination.contamination(empty, tests_table).count() == 0
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert lexical_search.ranked_search(empty, tests_table).count() == lexical_search.ranked_search(edge, none).count() == 0
    clean = decontamination.contamination(edge, none).collect()
    assert len(clean) == len(edge_rows()) and not any(r["contaminated"] for r in clean)
