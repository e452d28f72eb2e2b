"""The operators over the supplied tables with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


_SPACED = r"'[^\x20\x09-\x0D]+'"
_LIMITS = {5: 0.20, 6: 0.20, 7: 0.18, 8: 0.16, 9: 0.14, 10: 0.12}


@query("op8_quality_rules", f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_SPACED}) as words from documents),
g as (select doc_id, n, i, words[i:i + n - 1] as gram from d, unnest({list(_LIMITS)}) t(n), unnest(range(1, len(words) - n + 2)) u(i)),
r as (select doc_id, n, i from g qualify count(*) over (partition by doc_id, n, gram) > 1),
c as (select distinct doc_id, n, unnest(range(i, i + n)) as q from r),
s as (select doc_id, count(*) filter (n = 5) as n_repeat_words,
             {", ".join(f"sum(length(words[q])) filter (n = {n}) as c{n}" for n in _LIMITS)} from c join d using (doc_id) group by 1),
l as (select doc_id, line, count(*) over (partition by doc_id, line) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
      where regexp_matches(line, {_SPACED})),
m as (select doc_id, count(*) - count(distinct line) as n_dup_lines, sum(length(line)) as line_chars,
             sum(if(k > 1, length(line), 0)) as dup_line_chars from l group by 1),
w as (select doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(line_chars, 0)::bigint as line_chars,
             coalesce(dup_line_chars, 0)::bigint as dup_line_chars, coalesce(c5, 0)::bigint as dup_chars_5, coalesce(c10, 0)::bigint as dup_chars_10,
             {" and ".join(f"coalesce(c{n}, 0) <= {limit}::double * word_chars" for n, limit in _LIMITS.items())} as few
      from d left join s using (doc_id) left join m using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from w)
select * exclude (few), not base_failed and few and dup_line_chars <= 0.30::double * line_chars as kept from b""")
def op8(spark, sf_dir):
    from featforge.llm.quality import quality
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "line_chars", "dup_line_chars", "dup_chars_5", "dup_chars_10")


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    from featforge.llm.packing import pack
    return pack(documents(spark, sf_dir), tokenizer())


@query("op4_token_files")
def op4(spark, sf_dir):
    from pyspark.sql import functions as F

    from featforge.llm.token_files import read_token_files, write_token_files
    from featforge.session import scratch_path
    folder = scratch_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), folder, tokenizer())
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op3_decontamination", f"""
with d as (select doc_id, {_PLAIN} as words from documents), b as (select item_id, {_PLAIN} as words from benchmark),
w as (select distinct item_id, words[i:i + least(10, len(words)) - 1] as win from b, unnest(range(1, greatest(len(words) - 10, 0) + 2)) t(i)
      where len(words) > 0),
n as (select distinct len(win) as n from w),
p as (select doc_id, i, n, words[i:i + n - 1] as win from d, n, unnest(range(1, len(words) - n + 2)) t(i)),
h as (select doc_id, i, n, item_id from p join w using (win)),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(i, i + n)) as q from h) group by 1),
s as (select doc_id, count(distinct item_id::varchar) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
      from h group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join c using (doc_id) left join s using (doc_id)""")
def op3(spark, sf_dir):
    from featforge.llm.decontaminate import decontaminate
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(documents(spark, sf_dir), items).drop("text_hash")


@query("op5_minhash_near_dup", f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as words
      from documents),
s as (select distinct doc_id, words[i:i + 4] as shingle from w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) t(i) where len(words) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y using (shingle) where x.doc_id != y.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
c as (select a as doc_id, min(b) as other from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id,
       doc_id <= coalesce(other, doc_id) as kept
from documents left join n using (doc_id) left join c using (doc_id)""")
def op5(spark, sf_dir):
    from featforge.llm.near_dup import near_duplicates
    return near_duplicates(documents(spark, sf_dir)).drop("row_key")


@query("op2_secret_scan")
def op2(spark, sf_dir):
    from featforge.llm.secrets import secrets
    return secrets(documents(spark, sf_dir)).drop("text_hash", "parts")


@query("op9_line_dedup", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos
           from documents where text is not null),
t as (select doc_id, pos, list_transform(regexp_extract_all(line, '[^\x09-\x0D\x20]+'), lambda x: if(regexp_matches(x, '[0-9]'), '<*>', x)) as t from l),
n as (select *, len(t) as n from t),
k as (select doc_id, pos, -1 as s, n, t as a, null as b from n where n >= 3
      union all select doc_id, pos, s, n, t[:2 + (n - 2) * s // 3], t[2 + (n - 2) * (s + 1) // 3 + 1:]
      from n, unnest([0, 1, 2]) u(s) where n >= 8),
r as (select s, n, a, b, min(doc_id) as first from k group by all having count(*) >= if(n >= 50, 2, 3) and min(doc_id) != max(doc_id)),
x as (select distinct doc_id, pos from k join r on k.s = r.s and k.n = r.n and k.a = r.a and k.b is not distinct from r.b
      where doc_id != first),
g as (select doc_id, count(*) as n from x group by 1),
o as (select l.doc_id, string_agg(line, chr(10) order by pos) as text from l anti join x on l.doc_id = x.doc_id and l.pos = x.pos group by 1)
select d.doc_id, case when d.text is null then null else coalesce(o.text, '') end as text, coalesce(g.n, 0)::bigint as lines_dropped
from documents d left join o using (doc_id) left join g using (doc_id)""")
def op9(spark, sf_dir):
    from featforge.llm.line_dedup import dedup_lines
    return dedup_lines(documents(spark, sf_dir))


@query("op6_language_id")
def op6(spark, sf_dir):
    from pyspark.sql import functions as F

    from featforge.llm.language import fit_language, held_out, predict_language
    model = fit_language(documents(spark, sf_dir, "doc_id", "text", "lang"), ~held_out())
    out = predict_language(documents(spark, sf_dir), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def op7(spark, sf_dir):
    from pyspark.sql import functions as F

    from featforge.llm.language import held_out
    from featforge.llm.toxicity import fit_toxicity, score_toxicity
    out_of_fit = held_out(of=3, rest=1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, labels, ~out_of_fit)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(out_of_fit, F.lit(False)).alias("held_out"), "score", "predicted",
                                              "excess", "n_words")


@query("op10_license_scan")
def op10(spark, sf_dir):
    from featforge.llm.licenses import licenses
    return licenses(documents(spark, sf_dir))


#: CRC-32 of the digits of doc_id, bit by bit, and sha256 of a leaf.
_CRC = ("xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint), lambda c, b: list_reduce(list_prepend("
        "xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: if(a & 1 = 1, xor(a >> 1, 3988292384), a >> 1)), 4294967295::bigint), 4294967295)")


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


@query("op13_merkle_manifest", f"""
with recursive d as (select *, {_leaf_sql('text')} as leaf, row_number() over (order by doc_id) as row from documents),
p as (select row, doc_id, leaf, source, row_number() over (partition by source order by doc_id, leaf) - 1 as idx,
             if({_CRC} % 2 = 0, {_leaf_sql("replace(text, chr(10), '')")}, leaf) as other from d),
n as (select source, 0 as level, idx, leaf as h, count(*) over (partition by source) as n from p
      union all select source, level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), any_value((n + 2) // 3) from n where n > 1 group by source, level, idx // 3),
r as (select source, h as subroot, level as tall, row_number() over (order by source nulls first) - 1 as pos from n where n = 1),
t as (select 0 as level, pos as idx, subroot as h, count(*) over () as n from r
      union all select level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), any_value((n + 2) // 3) from t where n > 1 group by level, idx // 3),
a as (select row, tall, other, p.source, idx, pos, subroot from p join r on p.source is not distinct from r.source),
s as (select row, n.level, string_agg(n.h, '' order by n.idx) filter (n.idx < a.idx // (3 ** n.level)::bigint) as l,
             string_agg(n.h, '' order by n.idx) filter (n.idx > a.idx // (3 ** n.level)::bigint) as r
      from a join n on a.source is not distinct from n.source and n.level < a.tall and n.idx // 3 = a.idx // (3 ** (n.level + 1))::bigint
      group by all),
u as (select pos, t.level, string_agg(t.h, '' order by t.idx) filter (t.idx < pos // (3 ** t.level)::bigint) as l,
             string_agg(t.h, '' order by t.idx) filter (t.idx > pos // (3 ** t.level)::bigint) as r
      from r join t on t.n > 1 and t.idx // 3 = pos // (3 ** (t.level + 1))::bigint group by all),
w as (select row, level, coalesce(l, '') as l, coalesce(r, '') as r from s
      union all select row, tall + level, coalesce(l, ''), coalesce(r, '') from a join u using (pos)),
f as (select row, 0 as level, other as h from a
      union all select f.row, f.level + 1, sha256(w.l || f.h || w.r) from f join w on f.row = w.row and f.level = w.level),
e as (select row, max_by(h, level) as folded_root from f group by 1),
q as (select row, sha256(string_agg(l || r, '' order by level)) as proof_sha256 from w group by 1)
select doc_id, leaf, subroot, (select h from t where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root,
       folded_root = (select h from t where n = 1) as verified
from p join a using (row) join e using (row) left join q using (row)""")
def op13(spark, sf_dir):
    from pyspark.sql import functions as F

    from featforge.llm.merkle import build_manifest
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = build_manifest(documents(spark, sf_dir, *columns), columns, "source", "doc_id", {"text": text})
    return manifest.prove(proofs=False).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pieces_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_sentence_pieces")
def op11(spark, sf_dir):
    from pyspark.sql import functions as F

    from featforge.llm.pieces import decode_pieces, encode_pieces
    encoded = encode_pieces(documents(spark, sf_dir), pieces_model())
    encoded = encoded.select("doc_id", "ids", F.element_at("ends", -1).cast("bigint").alias("n_bytes"))
    return decode_pieces(encoded, pieces_model()).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes")


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_ranked_search", f"""
with t as (select doc_id, unnest({_TERMS}) as term from documents),
f as (select doc_id, term, count(*)::bigint as tf from t group by all),
n as (select doc_id, count(*)::bigint as n from t group by 1),
s as (select count(*)::bigint as nd, sum(n)::bigint as nt from n),
w as (select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, s group by term),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::bigint as score
      from q join w using (term) join f using (term) join n using (doc_id), s group by all),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50""")
def op12(spark, sf_dir):
    from featforge.llm.lexical import ranked_search
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
