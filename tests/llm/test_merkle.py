import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.llm import merkle as M
from featforge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(row):
    """Levels of nodes from leaves to root."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for row in levels[:-1]:
        first = at - at % 3
        out.append(("".join(row[first:at]), "".join(row[at + 1:first + 3])))
        at //= 3
    return out


def brute(docs, strip):
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = {g: sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d))) for g in names}
    trees = {g: tree([leaf(*d) for d in order[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for pos, g in enumerate(names):
        for i, d in enumerate(order[g]):
            way = path(trees[g], i) + path(top, pos)
            other = (d[0], d[1], d[2].replace("\n", "")) if d[2] is not None and strip(d[0]) else d
            root = M.fold(leaf(*other), way)
            out.append((d[0], leaf(*d), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in way)), root, root == top[-1][0]))
    return sorted(out, key=str)


def run(df, **kwargs):
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = M.build_manifest(df, COLUMNS, "source", "doc_id", {"text": text})
    return manifest, manifest.prove(**kwargs)


def rows(df):
    return sorted((tuple(r) for r in df.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("levels", [7, 2, 1])
def test_odd_rows_equal_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "SPAN", 3 ** levels)
    rng = random.Random(levels)
    docs = [(i, "hot", f"line {i}\nnext " + "é" * rng.randrange(4)) for i in range(130)]
    docs += [(1000 + i, f"s{rng.randrange(9)}", rng.choice([None, "", "\n", "a\nb", "x" * 100_000 + "\n"])) for i in range(60)]
    docs += [(2000, None, "no\nsource"), (2001, "", "empty\nname"), (None, "hot", "no id"), (None, None, None), (3, "hot", "line 3\nnext "),
             (3000, "Z", "twice\n"), (3000, "Z", "twice\n"), (3001, "é", "bytes"), (3002, "z\U0001F600", "x"), (3003, "z￿", "y")]
    df = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id bigint, source string, text string, tree string, at int").repartition(7)
    want = brute(docs, lambda i: i is not None and i % 2 == 0)
    manifest, got = run(df)
    got = got.cache()
    assert rows(got) == want
    for r in got.limit(50).collect():
        other = M.fold(r.leaf, [(p.left, p.right) for p in r.proof])
        assert other == r.root and h(*[p.left + p.right for p in r.proof]) == r.proof_sha256
    assert [r.root for r in manifest.root().collect()] == [want[0][3]]
    # Proofs of some leaves are the same, though siblings must then be fetched.
    some = run(df, which=F.col("key") % 11 == 0)[1]
    assert rows(some) == [r for r in want if r[0] is not None and r[0] % 11 == 0]


def test_small_tables(spark):
    df = spark.createDataFrame([(5, None, "a\n")], "doc_id bigint, source string, text string")
    manifest, got = run(df)
    one = leaf(5, None, "a\n")
    assert rows(got) == [(5, one, one, one, h(""), one, True)]
    manifest, got = run(df.limit(0))
    assert got.count() == 0 and manifest.root().count() == 0


def test_missing_is_minimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 9, 10, 28, 82):
        for _ in range(20):
            at = np.unique(rng.integers(0, n, rng.integers(1, n + 1)))
            asked = M.missing(at, n)
            assert len(set(asked)) == len(asked)
            known, levels = {(0, i) for i in at.tolist()}, M.height(n)
            # No node that follows from the leaves is asked for, and none is asked for that is no sibling on a path.
            for k in range(levels):
                assert not {c for c in asked if c in known}
                parents = {i // 3 for lv, i in known if lv == k}
                run_ = {(k, i) for p in parents for i in range(3 * p, min(3 * p + 3, M.width(n, k)))}
                assert {c for c in asked if c[0] == k} == run_ - known
                known |= {(k + 1, p) for p in parents}
            assert (levels, 0) in known


def test_query_equals_sql_and_tampering_shows(spark):
    got = QUERIES["op13_merkle_manifest"](spark, SF).cache()
    assert compare(got, connect(SF), ORACLE["op13_merkle_manifest"]) == []
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.collect():
        tampered = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified == (not tampered)
