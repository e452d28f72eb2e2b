import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from featforge.llm import language as L
from featforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    scores, step, first = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    scores[~mask] = 0
    got, pairs = L._marginals(scores, mask, step, first, np.array([1.0, 2.0]))
    moved = np.zeros((3, 3))
    for i in range(2):
        n = int(mask[i].sum())
        want, total = np.zeros((n, 3)), 0.0
        joint = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(first[path[0]] + sum(scores[i, t, k] for t, k in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, k in enumerate(path):
                want[t, k] += p
            for a, b in zip(path, path[1:]):
                joint[a, b] += p
        assert np.allclose(got[i, :n], want / total)
        moved += joint / total * (1 + i)
    assert np.allclose(pairs, moved)


def test_code_switched_words():
    rng = np.random.default_rng(1)
    chains = [(lang, [w + s for w, s in zip(rng.choice(stems, 30), rng.choice(ends, 30))])
              for lang, stems, ends in (("aa", ["tal", "mor", "kel"], ["ik", "un"]), ("bb", ["zos", "pri", "wen"], ["eau", "oy"]))
              for _ in range(30)]
    model = L.Crf.fit(chains, L.Settings(rounds=30, buckets=1 << 12))
    text = ["talik", "morun", "kelik", "talun", "zoseau", "prioy", "weneau", "zosoy"]
    assert model.label_words(text) == ["aa"] * 4 + ["bb"] * 4
    assert model.predict([None, "", "12 _ ²", "talik morun"])[0] == ["und", "und", "und", "aa"]
    assert L.Crf.fit([], L.Settings()).predict(["abc"]) == (["und"], [0.0])


def test_query_is_right_on_held_out_rows(spark):
    out = QUERIES["op6_language_id"](spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    right = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean(right) > 0.97


def test_odd_rows(spark):
    docs = [(i, f"wort{'ä' * (i % 3)} und nicht das haus mit", "de", 0.5) for i in range(12)]
    docs += [(i + 20, "the house and not with water", "en", 0.5) for i in range(12)]
    docs += [(50, None, "en", 1.0), (51, "", None, 1.0), (None, "the water", "en", 1.0), (52, "123 ... ²", "xx", 1.0),
             (53, "the water " * 20_000, None, 1.0), (53, "nicht mit", None, 1.0), (53, "nicht mit", None, 1.0), (54, "\U0001F600 日本", "en", 2.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score double").repartition(3)
    model = L.fit_language(df, ~L.held_out())
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in L.predict_language(df, model).collect()}
    assert L.predict_language(df, model).count() == len(docs)
    assert got[(50, None)] == got[(51, "")] == got[(52, "123 ... ²")] == ("und", 0.0)
    assert got[(None, "the water")][0] == got[(53, "the water " * 20_000)][0] == "en" and got[(53, "nicht mit")][0] == "de"
    assert L.predict_language(df.limit(0), model).count() == 0
    assert L.fit_language(df.limit(0)).labels == []
    assert L.fit_language(df.filter(F.col("lang") == "de")).predict(["abc"])[0] == ["de"]


def test_words_are_runs_of_letters():
    assert L.words_of("x² m² H₂O ½kg a_b 12c") == ["x", "m", "h", "o", "kg", "a", "b", "c"]
    assert L.words_of("² ½ 12 _") == [] and L.words_of(None) == []
    long = "ab" * 2500
    assert "".join(L.words_of(long)) == long and {len(w) for w in L.words_of(long)} == {L.LONGEST}
    # What tells the language of a run without spaces may stand anywhere in it.
    rng = np.random.default_rng(1)
    chains = [(lang, ["".join(rng.choice(stems, 4)) for _ in range(30)]) for lang, stems in (("aa", ["tal", "mor", "kel"]), ("bb", ["zos", "pri", "wen"]))
              for _ in range(30)]
    model = L.Crf.fit(chains, L.Settings(rounds=30, buckets=1 << 12))
    text = "".join(["tal"] * 12 + ["zos", "wen", "pri"] * 400 + ["mor"] * 12)
    assert model.predict([text, "x²"])[0][0] == "bb" and model.predict(["x²"])[0][0] != "und"
