import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featforge.llm import packing as K
from featforge.llm import token_files as T
from featforge.llm.queries import QUERIES
from featforge.llm.tokens import encoded
from featforge.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", None, "<|endoftext|> x<|ENDOFTEXT|>y<|startoftext|>", "it's they'RE", "H̱ ẖ À ̀a İ",
       "a\x1cb \x85 \xa0x y", "q" * 500 + " ok " * 3, "ΑΣ σας", "123 4.5, a_b", "x\u0000y",
       "日本語 テ", "don't. wait!? (no)", "l'été, où?", "é É.", "ẞ ß",
       "T'S'S.", "A1.", "<|endoftext|>.", "foo<|", "B.", "very long " * 3000]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_the_library(plain):
    for texts in [ODD, *[[t] for t in ODD]]:
        got = []
        for _, ids, at in encoded(pa.array(texts, pa.string()), PATH):
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [plain(t) for t in texts]


def test_sorted_sections():
    rng = random.Random(5)
    for values in ([], [0], [7], [0, 0, 0], [0, 1 << 62], sorted(rng.choices(range(10 ** 9), k=1000)), list(range(300)),
                   [5] * 200 + [10 ** 6] * 200):
        read = T.Sorted(T.pack_sorted(np.array(values, np.uint64)))
        assert read.all().tolist() == values and [read[i] for i in range(len(values))] == values
    many = np.cumsum(np.random.default_rng(1).integers(1, 900, 10_000))
    assert len(T.pack_sorted(many)) * 8 < len(many) * (2 + np.log2(many[-1] / len(many)) + 1.5)


def test_files_round_trip(spark, plain):
    rows = [(i * 3 - 9, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id bigint, text string, ids string").repartition(4)
    folder = scratch_path(spark, "tokens")
    T.write_token_files(df, folder, PATH, file_ids=50)
    got = sorted(T.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    at, texts = 0, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
        texts.setdefault(r.doc_id, []).append(ids)
    for k in {k for k, _ in rows}:
        assert sorted(texts[k]) == sorted([*plain(t), 2] for q, t in rows if q == k)
    empty = scratch_path(spark, "tokens")
    assert T.write_token_files(df.limit(0), empty, PATH).count() == 0
    assert T.read_token_files(spark, empty).count() == 0


def test_token_query(spark, plain):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(QUERIES["op4_token_files"](spark, SF).collect())
    at = 0
    for d, g in zip(docs, got, strict=True):
        ids = [*plain(d.text), 2]
        assert tuple(g) == (d.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_fullest_is_the_best_sum():
    rng = random.Random(3)
    for _ in range(200):
        room = rng.randint(1, 40)
        counts = {rng.randint(1, 15): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        sums = {0}
        for size, n in counts.items():
            sums = {s + size * k for s in sums for k in range(n + 1) if s + size * k <= room}
        found = K._fullest(counts, sorted(counts, reverse=True), room)
        assert sum(s * k for s, k in found.items()) == max(sums)
        assert all(k <= counts[s] for s, k in found.items())


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_odd_rows(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1, None), (1, None)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, sequence_id int").repartition(3)
    got = K.pack(df, PATH, 64).collect()
    check_places(got, 64)
    want = []
    for k, t in rows:
        ids = [*plain(t), 0]
        want += [(k, n, a, len(ids[a:a + 64]), crc(ids[a:a + 64])) for n, a in enumerate(range(0, len(ids), 64))]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)
    assert K.pack(df.limit(0), PATH, 64).count() == 0
    pieces = K.cut_pieces(df, PATH, 64)
    placed = K.place(pieces, 64)
    full = {r.sequence_id: r.ids for r in K.sequences(placed).collect()}
    for r in placed.collect():
        assert full[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == r.ids


def test_pack_query_is_near_the_bound(spark):
    got = QUERIES["op1_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    total = sum(r.length for r in got)
    assert check_places(got, 2048) <= -(-total // 2048) + 1


def test_hot_length_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"),
                                  F.when(F.col("id") % 3 < 2, 700).otherwise(F.col("id") % 600 + 1).cast("bigint").alias("length"))
    got = K.place(df, 2048, salts=16).collect()
    # Two pieces of 700 fit in a sequence, so 1000 sequences is the least.
    assert len(got) == 3000 and check_places(got, 2048) == 1000
