import hashlib
import re

from featforge.llm import decontaminate as D
from featforge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, names = words(text), set(), set()
    for name, body in items:
        item = words(body)
        n = min(10, len(item))
        for w in range(len(item) - n + 1) if n else []:
            for i in range(len(doc) - n + 1):
                if doc[i:i + n] == item[w:w + n]:
                    hit |= set(range(i, i + n))
                    names.add("" if name is None else str(name))
    return (len(doc), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))


def test_odd_rows_equal_brute_force(spark):
    items = [(1, LONG), (10, "Zebra-crossing!"), (2, "alpha"), (None, "é É ñandú x y"), (3, ""), (4, None), (5, "x y"), (5, "p q r"),
             (6, " ".join(LONG.split()[2:12])), (7, "the the the the the the the the the the the")]
    docs = [(1, LONG), (2, f"a {LONG.upper()}; b {LONG}"), (3, "zebra, CROSSING. alphas Alpha"), (4, None), (5, ""),
            (6, " ".join(LONG.split()[:11])), (7, " ".join(LONG.split()[3:12])), (None, "é É ñandú x y"), (8, "x  y p q"),
            (9, "the " * 500), (9, "the " * 500), (10, "ten " * 3000 + LONG), (11, "p q r"), (12, "-.-")]
    df = spark.createDataFrame([(a, b, 7) for a, b in docs], "doc_id bigint, text string, words int").repartition(3)
    bench = spark.createDataFrame([(a, b, 7) for a, b in items], "item_id bigint, text string, n int").repartition(2)
    got = sorted((tuple(r) for r in D.decontaminate(df, bench).drop("text_hash").collect()), key=str)
    assert got == sorted(((k, *brute(t, items)) for k, t in docs), key=str)
    assert D.decontaminate(df.limit(0), bench).count() == 0
    assert D.decontaminate(df, bench.limit(0)).filter("contaminated").count() == 0
    assert D.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_query_equals_sql(spark):
    assert compare(QUERIES["op3_decontamination"](spark, SF), connect(SF), ORACLE["op3_decontamination"]) == []
