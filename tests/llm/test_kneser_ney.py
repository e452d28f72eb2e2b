from collections import Counter

import numpy as np
import pyarrow as pa

from featforge.llm import kneser_ney as K
from featforge.llm import lookup as L
from featforge.llm import text as X
from featforge.llm import toxicity as T


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y, out = n[0] / max(1, n[0] + 2 * n[1]), []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else (out[-1] if out else 0.75)
        out.append(min(max(d, K.LEAST_DISCOUNT), k))
    return out


def counted(texts):
    pairs = Counter((v, w) for text in texts for v, w in zip(["", *text], text))
    return pairs, Counter(w for _, w in pairs)


def less(d, n):
    return max(n - d[min(n, 3) - 1], 0) if n else 0


def lower(counts, below):
    """Discounted share of a word among the different words before it, and what is freed times the probability below."""
    d, total = discounts(counts.values()), sum(counts.values())
    rest = sum(d[min(n, 3) - 1] for n in counts.values()) / total
    return lambda w: less(d, counts[w]) / total + rest * below(w)


def upper(pairs, below):
    d, contexts = discounts(pairs.values()), {}
    for (v, w), n in pairs.items():
        contexts.setdefault(v, Counter())[w] = n

    def after(v, w):
        of = contexts[v]
        return (less(d, of[w]) + sum(d[min(n, 3) - 1] for n in of.values()) * below(v, w)) / sum(of.values())
    return after, set(contexts)


def test_models_equal_brute_force(spark):
    """Pairs of both classes, copies, words of ordinary texts only, contexts of one class only and words of neither."""
    rng = np.random.default_rng(5)
    name = lambda c, n: [f"{c}{min(int(k), 39)}" for k in rng.zipf(1.4, n)]
    rows = [(int(i % 3 == 0), name("wx"[i % 2], int(rng.integers(0, 30))) + name("ab"[i % 3 == 0], 3)) for i in range(120)]
    rows += [rows[0], (1, []), (0, ["only"])]
    df = spark.createDataFrame([(y, " ".join(words)) for y, words in rows], "toxic int, text string").repartition(4)
    pairs, words = K.count_pairs(df, lambda t: (*T._contexts(t), t.doc))
    assert pairs.agg({"bad": "sum", "good": "sum"}).first().asDict() == {
        f"sum({c})": sum(len(w) for y, w in rows if y == k) for c, k in (("bad", 1), ("good", 0))}
    docs = [*df.select("text").toPandas()["text"], "idle w1 w2 b3 idle"]
    shared = Counter(w for text in docs for w in text.split())
    known = {w for _, text in rows for w in text}
    counts = T._corpus_counts(spark.createDataFrame([(t,) for t in docs], "text string"), T.HashFilter.build(words.selectExpr("bigint(word) as key"), "key"))
    model = K.word_models(pairs, words, counts.selectExpr("int(shiftright(key, 32)) as word", "shared"))
    classes = [counted([w for y, w in rows if y == k]) for k in (1, 0)]
    pairs_of_both, words_of_both = counted([w for _, w in rows])
    every = sum(shared[w] for w in known) + len(known) + 1
    alone = lower(words_of_both, lambda w: (shared[w] + 1 if w in known else 1) / every)
    after, contexts = upper(pairs_of_both, lambda v, w: alone(w))
    own = [lower(c[1], alone) for c in classes]
    both = lambda v, w: after(v, w) if v in contexts else alone(w)
    below = [lambda v, w, f=f: both(v, w) * f(w) / alone(w) for f in own]
    (bad, one), (good, two) = [upper(c[0], b) for c, b in zip(classes, below)]
    text = ["only", "w1", "w1", "x2", "a1", "b1", "w1", "zz", "w2", "b2", "b1", "a1", "a1", "idle", "x1", "x1"]
    (t,) = X.chunks(pa.array([" ".join(text)]), X.PLAIN_LOWER)
    which, ratio = model.ratios(*T._contexts(t))
    for i, (v, w) in enumerate(zip(["", *text], text)):
        p = [f(v, w) for f in ((bad, good) if v in one & two else below)]
        assert abs(ratio[which[i]] - np.log(p[0] / p[1])) < 1e-4
    bounded = K.word_models(pairs, words, counts.selectExpr("int(shiftright(key, 32)) as word", "shared"), entries=20)
    assert all(0 < len(keys) <= 20 for keys, _ in (bounded.pairs, bounded.contexts, bounded.words))


def test_discounts():
    assert np.allclose(K.discounts([100, 40, 20, 10]), [1 - 2 / 1.8 * 0.4, 2 - 3 / 1.8 * 0.5, 3 - 4 / 1.8 * 0.5])
    assert (K.discounts([0, 0, 0, 0]) == 0.75).all() and (K.discounts([1, 9, 50, 90]) >= K.LEAST_DISCOUNT).all()


def test_model_measures_pairs_by_length(spark):
    """A word that is toxic after one word only is told apart, and a longer text of the same words gets the same difference a word."""
    rows = [(i, f"{'you' if i % 2 else 'a'} clown {'ha' if i % 3 else 'ho'} w{i % 7}", i % 2) for i in range(400)]
    rows += [(400 + i, f"{'a' if i % 2 else 'you'} friend {'ha' if i % 3 else 'ho'} w{i % 7}", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    model = T.fit_toxicity(df, df)
    (t,) = X.chunks(pa.array(["you clown", "a clown", "a friend", "you friend", "you clown " * 50]), X.PLAIN_LOWER)
    excess, x = model.measure(t)
    assert excess[0] > 0.5 and excess[2] > 0.5 and excess[1] < -0.5 and excess[3] < -0.5
    assert np.allclose(x[:4, 0], np.clip(excess[:4] / 2, -2, 2) * 10) and abs(x[4, 0] - np.clip(excess[4] / 100, -2, 2) * 10) < 1e-9
    score = model.score(x)
    assert min(score[0], score[2]) > max(score[1], score[3])


def test_no_pair_is_left_out(spark):
    """More than the 1,048,576 pairs that the models were once bounded to."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 3000, (1200, 1100))
    df = spark.createDataFrame([(i % 2, " ".join(f"w{k}" for k in row)) for i, row in enumerate(ids.tolist())], "toxic int, text string").repartition(8)
    pairs, words = K.count_pairs(df, lambda t: (*T._contexts(t), t.doc))
    model = K.word_models(pairs, words, words.selectExpr("word", "both as shared"))
    inner = np.unique(ids[:, :-1].astype(np.int64) * 3000 + ids[:, 1:])
    assert len(inner) > 1 << 20
    assert len(model.pairs[0]) == len(inner) + len(np.unique(ids[:, 0])) and len(model.words[0]) == 3000 and len(model.contexts[0]) == 3001


def test_tasks_find_what_the_driver_finds(spark, monkeypatch):
    """Blocks of several tasks and many slices; texts without words, null and equal ones, unknown words, repeated and null ids."""
    monkeypatch.setattr(L, "SLICE", 16)
    rng = np.random.default_rng(4)
    text = lambda c, n: " ".join(f"{c}{k}" for k in rng.zipf(1.3, n) if k < 200)
    rows = [(i, text("ab"[i % 4 == 0] if i % 3 else "c", 12), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    model = T.fit_toxicity(df, df)
    docs = [*[r[:2] for r in rows[:90]], rows[0][:2], (500, None), (501, ""), (502, "zz yy zz"), (None, "a1 b1 c1"), (503, "a1 b1 c1")]
    got = T.score_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), model)
    (t,) = X.chunks(pa.array([d[1] for d in docs]), X.PLAIN_LOWER)
    excess, x = model.measure(t, model.models.whole())
    want = [(d[0], round(s, 9), round(e, 6)) for d, s, e in zip(docs, model.score(x).tolist(), excess.tolist())]
    assert sorted(want, key=str) == sorted(((r.doc_id, round(r.score, 9), round(r.excess, 6)) for r in got.collect()), key=str)
    assert np.allclose(model.measure(t)[0], excess)


def test_numbers_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64))
    assert (L.unmix(X.mix(keys)) == keys).all()
    for some in (keys, keys[:1], np.unique(keys >> np.uint64(50)), keys[[0, -1]]):
        assert (L.unpack(L.pack(some)) == some).all()
