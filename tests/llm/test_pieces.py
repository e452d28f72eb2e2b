import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece

from featforge.llm import pieces as Q
from featforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("abc  \n\t é☃▁\U0001F600日本ﬁ①　 ́´\x00ＡＢ​½Å\r")


def texts(n, seed=0):
    rng = random.Random(seed)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(n)]
    return ["", " ", "  a ", "▁", "a▁b", "▁▁ x", "<s> </s> <unk> <0x0A>", "x" * 300 + " y", "日本語" * 50, *some]


def spans(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def ours(model, some):
    out = []
    for t, (ids, starts, ends) in zip(some, model.encode(some)):
        assert ids[-1] == model.end and starts[-1] == ends[-1] == len(t.encode())
        out.append(list(zip(ids.tolist()[:-1], starts.tolist(), ends.tolist())))
    return out


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("flags", [(1, 1, 1), (1, 0, 1), (0, 1, 1), (0, 0, 0), (1, 1, 0)])
def test_ids_and_spans_equal_the_library_under_any_normaliser(tmp_path, rule, flags):
    """The model file with another character map and other rules for white space, kept in a temporary folder."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    spec += b"".join(bytes([field << 3, on]) for field, on in zip((3, 4, 5), flags))
    with open(PATH, "rb") as f:
        parts = b"".join(Q._message(k, v) for k, v in Q._fields(f.read()) if k in (1, 2))
    path = str(tmp_path / "other.model")
    with open(path, "wb") as f:
        f.write(parts + Q._message(3, spec))
    some = texts(400)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert ours(Q.Pieces(path), some) == [spans(library, t) for t in some]


def test_unknown_pieces_kept_symbols_and_no_byte_fallback(tmp_path):
    with open(PATH, "rb") as f:
        fields = list(Q._fields(f.read()))
    parts, n = b"", 0
    for k, v in fields:
        if k == 1 and dict(Q._fields(v)).get(3) == 6:
            v = Q._message(1, b"\xe2\x96\x84%d" % n) + b"\x15\0\0\xf0\xc1"  # an ordinary piece instead of a byte
            n += 1
        if k == 1 and dict(Q._fields(v))[1] == "▁the".encode():
            v = Q._message(1, b"c  a") + b"\x15\0\0\0\0\x18\x04"  # a symbol that is kept as it is
        if k == 2:
            v += b"\x98\x02\0"  # no byte fallback
        if k in (1, 2):
            parts += Q._message(k, v)
    path = str(tmp_path / "unknown.model")
    with open(path, "wb") as f:
        f.write(parts + Q._message(3, sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_normalizer_spec()))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    some = [*texts(300, 4), "ac  ab c  a", "☃☃ ☃a☃"]
    assert ours(Q.Pieces(path), some) == [spans(library, t) for t in some]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one  two\n"), (3, "one  two\n"), (None, "no id"), (4, "long " * 100_000 + "☃"), (5, "日" * 5000)]
    df = spark.createDataFrame([(*r, [1], "x") for r in rows], "doc_id bigint, text string, ids array<int>, decoded string").repartition(3)
    encoded = Q.encode_pieces(df, PATH)
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((k, ids, library.decode(ids)))
    got = [(r.doc_id, r.ids, r.decoded) for r in Q.decode_pieces(encoded, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in encoded.collect():
        assert len(r.ids) == len(r.starts) == len(r.ends) and r.starts[1:] == r.ends[:-1] and r.starts[0] == 0
    assert Q.encode_pieces(df.limit(0), PATH).count() == 0
    assert [r.decoded for r in Q.decode_pieces(spark.createDataFrame([(None,)], "ids array<int>"), PATH).collect()] == [None]


def test_query_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in QUERIES["op11_sentence_pieces"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode(d.text or "", add_eos=True), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest() and r.n_bytes == len((d.text or "").encode())
