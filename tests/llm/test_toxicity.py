import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.llm import toxicity as T
from featforge.llm.hashset import HashFilter
from featforge.llm.language import held_out
from featforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def one(text):
    (t,) = X.chunks(pa.array([text]), X.PLAIN_LOWER)
    return t


def runs(word, k):
    padded = f"\x01{word}\x02"
    return [padded[i:i + k] for i in range(len(padded) - k + 1)]


def hash_of(run):
    """Hash of a character run, by a word that holds it."""
    word = run.strip("\x01\x02")
    for h, r in zip(T._runs(one(word), np.array([0]))[len(run) == T.LONG][1].tolist(), runs(word, len(run))):
        if r == run:
            return h
    t = one("x" + word + "x")
    found = dict(zip(runs("x" + word + "x", len(run)), T._runs(t, np.array([0]))[len(run) == T.LONG][1].tolist()))
    return found[run]


def test_counts_equal_brute_force(spark):
    texts = ["you are a fool", "a fool and a clown you are", "what a clown what a clown", "É é fool", "", None, "x", "you are a fool"]
    held = [bool(T.held_back(one(t or ""), *T._contexts(one(t or "")))[0]) for t in texts]
    rows = T._counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), None)
    got = {(r.level, r.key % 2 ** 64): (r.n, r.seen, r.n_held) for r in rows.withColumn("seen", T.contexts_seen("n", "mask")).collect()}
    n, contexts, n_held = Counter(), {}, Counter()
    for text, h in zip(texts, held):
        words = [w.replace("É", "É").lower() if w.isascii() else w for w in (text or "").split()]
        for before, w in zip([None, *words], words):
            of = [(0, int(one(w).word_hashes()[0]), before)]
            of += [(k, hash_of(r), w) for k in (T.SHORT, T.LONG) for r in runs(w, k)] if w.isascii() else []
            for level, key, context in of:
                (n_held if h else n)[level, key] += 1
                if not h:
                    contexts.setdefault((level, key), set()).add(context)
    for k in n | n_held:
        # Few contexts rarely share a bit, and 64 bits tell how many there are within one.
        assert got[k][0] == n[k] and got[k][2] == n_held[k] and abs(got[k][1] - len(contexts.get(k, ()))) <= 1


def test_contexts_seen_estimates_many(spark):
    rows = [(k, n, [int(v) for v in X.mix(np.arange(k, dtype=np.uint64) + np.uint64(7)) & np.uint64(63)]) for k, n in ((1, 1), (3, 9), (20, 100), (40, 500), (400, 900))]
    df = spark.createDataFrame([(k, n, int(np.bitwise_or.reduce(np.uint64(1) << np.array(b, np.uint64)).view(np.int64))) for k, n, b in rows],
                               "k int, n bigint, mask bigint").withColumn("seen", T.contexts_seen("n", "mask"))
    got = {r.k: r.seen for r in df.collect()}
    assert got[1] == 1 and abs(got[3] - 3) <= 1 and abs(got[20] - 20) <= 5 and abs(got[40] - 40) <= 14 and got[400] == 900


def test_log_ratios_equal_brute_force():
    rng = np.random.default_rng(2)
    size = 400
    cells = {"level": rng.integers(0, 2, size) * 4, "a": rng.integers(1, 8, size), "b": rng.integers(0, 8, size), "s": rng.integers(0, 5, size),
             "bad": rng.integers(0, 40, size), "good": rng.integers(0, 90, size)}
    got, rows = T.log_ratios(cells), list(zip(*[cells[c].tolist() for c in ("level", "a", "b", "s", "bad", "good")]))
    for i, (level, a, b, _, bad, good) in enumerate(rows):
        own = [r for r in rows if r[0] == level]
        scale = sum(r[4] for r in own if r[1] >= 4 <= r[2]) / sum(r[5] for r in own if r[1] >= 4 <= r[2])
        like = [r for r in own if r[1:3] == (a, b)]
        lean = ((sum(r[4] for r in like) + T.PRIOR) / (sum(r[5] for r in like) * scale + T.PRIOR)) ** 0.5
        assert abs(got[i] - np.log((bad + T.PART * lean) / (good * scale + T.PART / lean))) < 1e-9


def test_measures_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = ["you are a fool", "fool fool fool you", "a", "", "clowns and fools", "..."]
    words = sorted({w for t in texts for w in t.replace(".", "").split()})
    own = {w: float(v) for w, v in zip(words, rng.normal(0, 2, len(words))) if w != "and"}
    levels, spelled = {0: ({int(one(w).word_hashes()[0]): v for w, v in own.items()})}, {}
    for k in (T.SHORT, T.LONG):
        levels[k] = {h: float(rng.normal(0, 1)) for w in words for h in T._runs(one(w), np.array([0]))[k == T.LONG][1].tolist()}
    for w in words:
        short, long = ([levels[k][h] for h in T._runs(one(w), np.array([0]))[k == T.LONG][1].tolist()] for k in (T.SHORT, T.LONG))
        # The product of long runs, each given the short run it begins with.
        spelled[w] = short[0] if len(short) == 1 else sum(long) - sum(short[1:-1])
    arrays = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    model = T.Model({k: arrays(d) for k, d in levels.items()}, np.zeros(7))
    (t,) = X.chunks(pa.array(texts), X.PLAIN_LOWER)
    excess, x = model.measure(t)
    for i, text in enumerate(texts):
        ws = text.replace(".", "").split()
        sums = [f(ratio) for ratio in (own, spelled) for f in (lambda r: sum(r.get(w, 0) for w in ws), lambda r: sum(max(r.get(w, 0) - 1, 0) for w in set(ws)))]
        assert abs(excess[i] - sums[0]) < 1e-9
        n, d = max(1, len(ws)), max(1, len(set(ws)))
        want = [np.clip(sums[0] / n, -2, 2) * 10, np.clip(sums[1] / d, 0, 2) * 10, np.log1p(sums[1]),
                np.clip(sums[2] / n, -2, 2) * 10, np.clip(sums[3] / d, 0, 2) * 10, np.log1p(sums[3]), 1]
        assert np.allclose(x[i], want)


def test_query_finds_toxic_documents(spark):
    out = QUERIES["op7_toxicity"](spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    toxic = [r for r in held if r.toxic == 1]
    found = [r for r in held if r.predicted]
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic)
    assert sum(r.toxic for r in found) > 0.95 * len(found)


@pytest.mark.parametrize("suffixes,recall", [(4, 0.7), (16, 0.5)])
def test_rarer_expressions_are_found(spark, suffixes, recall):
    """Every word of a document gets one of some endings, so each expression is as many times rarer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    endings = F.array(*[F.lit(f"{chr(97 + k)}q") for k in range(suffixes)])
    own = F.element_at(endings, (F.pmod(F.xxhash64("doc_id"), F.lit(suffixes)) + 1).cast("int"))
    docs = docs.withColumn("text", F.regexp_replace("text", F.lit("([A-Za-zÀ-ÿ]+)"), F.concat(F.lit("$1"), own)))
    out = held_out(of=3, rest=1)
    model = T.fit_toxicity(docs, labels, ~out)
    rows = T.score_toxicity(docs, model).join(labels, "doc_id").filter(out).toPandas()
    bad, good = (rows.score[rows.toxic == c].to_numpy() for c in (1, 0))
    assert (bad > np.quantile(good, 0.99)).mean() >= recall
    assert (good >= 0.7).mean() <= 0.01
    scores = np.concatenate((bad, good)).argsort().argsort()[:len(bad)] + 1
    assert (scores.sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good)) > 0.82


def test_odd_rows(spark):
    rows = [(i, f"nice w{i} words number {i}", 0) for i in range(60)] + [(100 + i, f"nice w{i} idiot number {i}", 1) for i in range(60)]
    rows += [(200, None, 1), (201, "", 0), (None, "idiot", 1), (202, "idiot such " * 30_000, None), (203, "...", None), (0, "nice w0 words number 0", 0)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b, _ in rows], "doc_id bigint, text string, score double").repartition(3)
    labels = spark.createDataFrame([(a, c, c) for a, _, c in rows] + [(0, 0, 1)], "doc_id bigint, toxic int, text int")
    model = T.fit_toxicity(df, labels)
    got = {r.doc_id: r for r in T.score_toxicity(df, model).collect()}
    assert got[202].predicted == 1 and got[5].predicted == 0 and got[200].score == got[201].score == got[203].score
    assert T.score_toxicity(df, model).count() == len(rows) and T.score_toxicity(df.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        share = {r.score for r in T.score_toxicity(df, T.fit_toxicity(df, some)).collect()}
        assert len(share) == 1


def test_entries_beyond_the_bound_are_the_lightest(spark):
    df = spark.createDataFrame([(0, k, float(k) / 10, 4) for k in range(1, 101)] + [(4, 7, 3.0, 1)], "level int, key bigint, ratio double, all bigint")
    keys, ratio = T._entries(df, 0, 50)
    assert 0 < len(keys) <= 50 and min(ratio) > 5 and list(keys) == sorted(keys)
    assert len(T._entries(df, 0, 1000)[0]) == 100 and len(T._entries(df, 9, 10)[0]) == 0
    assert len(HashFilter.build(df, "key").has(np.array([7], np.uint64))) == 1
