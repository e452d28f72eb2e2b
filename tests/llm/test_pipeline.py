import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as line_dedup
from tests.llm.test_near_dup import brute as near_dup
from tests.llm.test_tokens import check_places

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=str)


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows_of(docs)
    frame = P.identify_language(spark, docs, SF).cache()
    rows = rows_of(frame)
    assert set(rows) <= set(before) and len(rows) > 0.97 * len(before)
    assert all(any(c.isalpha() for c in r[1]) for r in rows)
    frame = P.drop_template_lines(spark, frame, SF).cache()
    rest = {r[0]: r[2:4] for r in rows}
    want = [(k, t, *rest[k], len(t)) for k, t, n in line_dedup([r[:2] for r in rows]) if not n or t.strip(" \t\n\r\f\v")]
    rows = rows_of(frame)
    assert rows == sorted(want, key=str)
    frame = P.drop_near_duplicates(spark, frame, SF).cache()
    kept = {k for k, *_, own in near_dup([r[:2] for r in rows], 80) if own}
    rows = [r for r in rows if r[0] in kept]
    assert rows_of(frame) == rows
    frame = P.drop_contaminated(spark, frame, SF).cache()
    rows = [r for r in rows if not contaminated(r[1], items)[-1]]
    assert rows_of(frame) == rows
    packed = P.pack_sequences(spark, frame, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
    found = {}
    for r in packed:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == sizes
    check_places(packed, P.CAPACITY)
    whole = P.run(spark, SF).collect()
    key = lambda r: tuple(r)[:5]
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_odd_rows(spark):
    long = "a very long text of many words " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (8, long, "en", "s", len(long)), (3, "a line that comes again and again here", "en", "s", 1),
            (4, "a line that comes again and again here", None, "s", 1), (5, "a line that comes again and again here\n \n", "en", None, 1),
            (6, "only here", "en", "s", 9), (6, "only here", "en", "s", 9), (None, "no id at all", "en", "s", 2), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint, _hash int, kept int").repartition(3)
    lang = P.identify_language(spark, df, SF)
    assert lang.columns == P.COLUMNS and {r.doc_id for r in lang.collect()} == {3, 4, 5, 6, 8, None}
    lines = P.drop_template_lines(spark, df, SF)
    assert lines.columns == P.COLUMNS and sorted(str(r.doc_id) for r in lines.collect()) == ["1", "2", "3", "6", "6", "8", "None", "None"]
    near = P.drop_near_duplicates(spark, df, SF)
    assert near.columns == P.COLUMNS and sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "3", "6", "8", "None", "None"]
    clean = P.drop_contaminated(spark, df, SF)
    assert clean.columns == P.COLUMNS and clean.count() == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
