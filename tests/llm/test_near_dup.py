import random
import re

from featforge.llm import near_dup as N
from featforge.llm.graph import components
from featforge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, percent=85):
    found = [sets(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old = max(label[i], label[j])
                label = [min(label[i], label[j]) if x == old else x for x in label]
    out = []
    for i, (k, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if label[j] == label[i] and docs[j][0] is not None]
        first = min(ids) if ids else None
        out.append((k, len(found[i]), first, k == first))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in N.near_duplicates(df).drop("row_key").collect()), key=str)


def copies(rng, n, words, edits, start):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append((start + k, " ".join(text)))
    return out


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 300), (7, 7), (900, 900)]
    got = dict(components(spark.createDataFrame(rows, "a int, b int").repartition(5)).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 300, 400: 300, 300: 300, 900: 900}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_odd_rows_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(900, None), (901, ""), (902, " \n"), (1, "a b"), (2, "A  B"), (3, "a b c"), (4, "a b c d e f"), (5, "a b c d e f"),
            (5, "a b c d e f"), (None, "only null id here one two three"), (None, "x y z x y z"), (6, "X y z x y z"),
            (950, "É é"), (951, "é é"), (7, "same " * 4000), (8, "same " * 3000)]
    docs += copies(rng, 60, 120, 4, 100) + copies(rng, 30, 40, 1, 200) + copies(rng, 12, 2000, 40, 300)
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, node int").repartition(5)
    want = brute(docs)
    assert run(df) == want
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 600)
    assert run(df) == want
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    assert compare(QUERIES["op5_minhash_near_dup"](spark, SF), connect(SF), ORACLE["op5_minhash_near_dup"]) == []


def test_match_threshold_follows_the_similarity(spark):
    rng = random.Random(6)
    docs = []
    for k in range(300):  # 40 of 80 distinct shingles shared
        word = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
        shared = word(44)
        docs += [(2 * k, " ".join([*shared, *word(20)])), (2 * k + 1, " ".join([*shared, *word(20)]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, 0.5).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}
    assert N.near_duplicates(df, 0.51).filter("kept").count() == len(docs)
    assert N.thresholds(0.85) == (32, 16) and N.thresholds(0.8) == (32, 13) and N.thresholds(1.0) == (32, 32)
    assert N.thresholds(0.5) == (64, 13)


def test_links_of_a_group_grow_with_its_nodes(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    rng, per_node = random.Random(8), []
    for n in (150, 600):
        docs = spark.createDataFrame(copies(rng, n, 300, 2, 0), "doc_id bigint, text string").repartition(5)
        rows = N._described(docs.selectExpr("doc_id", "text", "doc_id as row_key"), 5, 32)
        found = N.candidate_links(rows.dropDuplicates(["node"]), 0.85, 32, 16)
        per_node.append((found.count() / n, found.distinct().count() / n))
        got = components(found).groupBy("label").count().collect()
        assert len(got) == 1
    assert per_node[0][0] < 20 and per_node[1][0] < 20
    assert per_node[1][0] < 1.3 * per_node[0][0] and per_node[1][1] < 1.3 * per_node[0][1]
