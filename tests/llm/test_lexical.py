import math
import random
import re

import numpy as np
import pytest

from featforge.llm import lexical as S
from featforge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    words = [terms(t) for _, t in docs]
    n_docs, n_terms = sum(bool(w) for w in words), sum(map(len, words))
    df = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for (k, _), w in zip(docs, words):
            score = 0
            for x in set(terms(text)):
                if tf := w.count(x):
                    m = 50 + 50 * len(w) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, k is None, k))
        out += [(item, i + 1, k, -s) for i, (s, _, k) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top])]
    return sorted(out, key=str)


def run(docs, items, **kwargs):
    return sorted((tuple(r) for r in S.ranked_search(docs, items, **kwargs).collect()), key=str)


def corpus(rng, n):
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]  # ties
    docs += [(5000, None), (5001, ""), (5002, "..."), (5003, "W1 É é-w2"), (5004, "w3 " * 20_000 + "rare"), (7, docs[7][1]), (None, docs[3][1]), (None, "w1 w2")]
    return docs


@pytest.mark.parametrize("block,leaf,dictionary", [(4096, 64, 1 << 14), (50, 4, 1 << 14), (128, 8, 30)])
def test_equals_brute_force(spark, monkeypatch, block, leaf, dictionary):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S.dictionaries, "__defaults__", (dictionary,))
    rng = random.Random(block)
    docs = corpus(rng, 500)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    items += [(12, docs[3][1]), (13, None), (14, "nowhere at all"), (15, "rare"), (16, "W1, w1 é"), (16, "w1 w2"), (17, " ".join(f"w{i}" for i in range(60)))]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, score int, item int").repartition(6)
    want = brute(docs, items, 10)
    got = run(df, spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, rank int"), top=10)
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "b"), (2, "")], "item_id bigint, text string")
    assert run(docs.limit(0), items) == run(docs, items.limit(0)) == run(docs.filter("text is null"), items) == []
    # One document with every term: ln(4 / 3) is above 0.
    assert [r[:3] for r in run(docs, items)] == [(1, 1, 1)]


def test_bounds_hold_and_prune():
    """Every bound is above the inner products below it, and a search for one of many groups of like documents leaves most balls out."""
    rng = np.random.default_rng(5)
    size, edges, at, value = 600, [0], [], []
    for i in range(1500):
        own = np.unique(np.concatenate((rng.integers(0, size, 3), rng.choice(np.arange(12) + 12 * (i % 50), 10))))
        at.append(own)
        value.append(rng.integers(1, 10 ** 9, len(own)))
        edges.append(edges[-1] + len(own))
    edges, at, value = np.array(edges), np.concatenate(at), np.concatenate(value)
    balls = S.Balls(edges, at, value, size, S.SLICES)
    items = S.Items([np.arange(12) + 12 * g for g in range(50)], np.ones(size, np.int64))
    bounds, visited = balls.bounds(items), 0
    for node, rows in enumerate(balls.rows):
        for g in range(50):
            mark = np.zeros(size, np.int64)
            mark[items.places[g]] = 1
            scores = [int((mark[at[edges[r]:edges[r + 1]]] * value[edges[r]:edges[r + 1]]).sum()) for r in rows[:20]]
            assert max(scores) <= bounds[node, g]
    best = [sorted(int(value[edges[r]:edges[r + 1]][(at[edges[r]:edges[r + 1]] // 12) == g].sum()) for r in range(1500))[-10] for g in range(50)]
    leaves = [i for i, c in enumerate(balls.children) if c is None]
    visited = sum(int(bounds[i, g] >= best[g]) for i in leaves for g in range(50))
    assert sorted(np.concatenate([balls.rows[i] for i in leaves]).tolist()) == list(range(1500))
    assert visited < 0.5 * 50 * len(leaves)


def test_query_equals_sql(spark):
    assert compare(QUERIES["op12_ranked_search"](spark, SF), connect(SF), ORACLE["op12_ranked_search"]) == []
