import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.llm.quality import LIMITS, measure, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "\n", "a\n\na\n", " x ", "\n\nabc def\nabc def", "a b c d e a b c d e a", "é\x00b", "x " * 3000,
       "\n".join(["one two three four five six seven eight nine ten eleven"] * 3), "#*$ %&|<> é b", "q" * 100_000]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
           "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "line_chars": sum(map(len, lines)),
           "dup_line_chars": sum(len(x) for x in lines if lines.count(x) > 1)}
    for n in sorted({5, *LIMITS}):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        often = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(n)}
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in inside)
        if n == 5:
            out["n_repeat_words"] = len(inside)
    return out


def test_counts_equal_brute_force(spark, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = [brute(x) for x in texts]
    for limit in (1, 1000, X.CHUNK):
        monkeypatch.setattr(X.chunks, "__defaults__", (limit,))
        got = measure(pa.array(texts), sorted(LIMITS))
        for name in want[0]:
            assert got[name].tolist() == [w[name] for w in want], (name, limit)


def test_query_rules_and_odd_rows(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "w " * 12, 0), (3, ODD[3], 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept int").repartition(3)
    got = quality(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            b = brute(ODD[r.doc_id])
            assert r.base_failed == (b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"])
        assert not (r.base_failed and r.kept)
    assert quality(df.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality(docs).groupBy("base_failed", "kept").count().collect()
    counts = {(r.base_failed, r.kept): r["count"] for r in out}
    assert counts[(False, True)] > 0.95 * sum(n for (failed, _), n in counts.items() if not failed)
    assert quality(docs).filter(F.col("base_failed") & F.col("kept")).count() == 0


def test_query_equals_sql(spark):
    from featforge.llm.queries import ORACLE, QUERIES
    from tests.oracle import compare, connect
    sf_dir = "/root/testdata/sf0.001"
    assert compare(QUERIES["op8_quality_rules"](spark, sf_dir), connect(sf_dir), ORACLE["op8_quality_rules"]) == []
