import re
from collections import defaultdict

from featforge.llm import line_dedup as L
from featforge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def keys(line):
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x09-\x0D\x20]+", line)]
    n = len(tokens)
    if n < 3:
        return []
    out = [(-1, tuple(tokens))]
    if n >= 8:
        for s in range(3):
            low, high = 2 + (n - 2) * s // 3, 2 + (n - 2) * (s + 1) // 3
            out.append((s, n, tuple(tokens[:low]), tuple(tokens[high:])))
    return out


def brute(docs):
    number = lambda d: -(1 << 63) if d[0] is None else d[0]
    seen = defaultdict(list)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            for k in keys(line):
                seen[k].append(number(d))
    size = lambda k: len(k[1]) if k[0] == -1 else k[1]
    first = {k: min(v) for k, v in seen.items() if len(v) >= (2 if size(k) >= 50 else 3) and len(set(v)) > 1}
    out = []
    for d in docs:
        if d[1] is None:
            out.append((d[0], None, 0))
            continue
        lines = d[1].split("\n")
        kept = [x for x in lines if not any(k in first and first[k] != number(d) for k in keys(x))]
        out.append((d[0], "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_odd_rows_equal_brute_force(spark):
    shared = "All rights reserved by us"
    docs = [(1, None), (2, ""), (3, f"a b c\n{shared}\n\nx y"), (4, f"{shared}\nown line here"), (5, f"{shared}"), (5, f"{shared}"),
            (None, f"no id but\n{shared}\n"), (6, "x y\nx y"), (7, "x y"), (8, "x y\n"), (9, "call 555-1234 now\ncall 555-9 now"),
            (10, "call 1 now\r\ncall two now"), (11, "Served by node alpha in 12 ms for user bob today ok"),
            (12, "Served by node alpha in 7 ms for user carol_x today ok"), (13, "Served by node alpha in 9 ms for user dan today ok"),
            (14, "\n".join(f"line {'abc'[i % 3]} of many {i}" for i in range(400))), (15, "line a of many 7\n" * 200), (16, "w " * 30_000),
            (17, "é ü  3ñ\té\nthe end"), (18, "é ü 4 é\n"), (19, "é  ü 5x é"), (20, "x" * 50_000),
            (22, "long " * 49 + "line"), (23, "own\n" + "long " * 49 + "line"), (24, "much " * 48 + "line"), (25, "much " * 48 + "line"),
            (26, "a b " + "c " * 30 + "d " * 30), (27, "a b " + "c " * 30 + "e " * 30), (21, f"same id\n{shared}"), (21, f"{shared} \x0b\n other")]
    df = spark.createDataFrame([(a, b, 1, "s", 5) for a, b in docs],
                               "doc_id bigint, text string, key int, first string, lines_dropped int").repartition(4)
    out = L.dedup_lines(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = sorted((tuple(r) for r in out.select("doc_id", "text", "lines_dropped").collect()), key=str)
    assert got == brute(docs)
    assert L.dedup_lines(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_brute_force_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.text, r.lines_dropped) for r in QUERIES["op9_line_dedup"](spark, SF).collect()]
    assert sorted(got, key=str) == brute(docs)
    assert compare(QUERIES["op9_line_dedup"](spark, SF), connect(SF), ORACLE["op9_line_dedup"]) == []
