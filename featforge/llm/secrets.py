"""Secret scan by multipart credential linking, in DataFrame functions only.

Base spans (assignments, access keys, long hexadecimal runs) stand by themselves. Weak parts do not: identifiers, mixed
tokens and endpoints are everywhere. A weak part is reported only if complementary parts begin within ``reach`` code
points of it: a base span of another role, or one part of each of the two other roles. An identifier or endpoint that
overlaps a base span of another role, but is not inside one, is reported with it. Parts are interval-joined by
cells of ``reach`` points: each cell of a document keeps the first and the last start of each role, so a weak part
meets a few rows in its own and the two neighbouring cells, however many parts lie there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featforge.session import cut_lineage

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that look made up by a machine; ``_mixed`` decides.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = r"""(?i:client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = (r"(?:https?|ftp|ssh|jdbc|amqp|redis|mongodb|postgres|postgresql|mysql)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
            r"|(?i:host|hostname|endpoint|server)\x20*[:=]\x20*[A-Za-z0-9._-]{3,}"
            r"|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{1,5}")
REACH = 200

#: Kind, pattern, role; the first three are the base kinds, and their order breaks ties of the start.
KINDS = [("assign", ASSIGN, "secret"), ("access", ACCESS, "identifier"), ("hex", HEX, "secret"),
         ("token", TOKEN, "secret"), ("identifier", IDENTIFIER, "identifier"), ("endpoint", ENDPOINT, "endpoint")]
_BASE = 3
_TOKEN = 3
#: A text without one of these has no secret and no access key, so nothing in it can be reported.
_ANY = rf"AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|(?=[A-Za-z0-9+/_-]{{16}})[A-Za-z+/_-]*[0-9]|{ASSIGN}"


def _mixed(match: Column) -> Column:
    """Upper and lower case and digits in 20 or more, or letters and digits of a hexadecimal number."""
    return ((F.length(match) >= 20) & match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")) | (
        match.rlike("^[0-9a-f]+$") & match.rlike("[0-9]") & match.rlike("[a-f]"))


def _parts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind (place in KINDS), start, end of every part; equal rows once.

    Starts come from the lengths of the pieces between matches, added up by a window over the matches of a text.
    """
    key = ["doc_id", "text_hash"]
    some = docs.filter(F.col("text").rlike(_ANY))
    found = []
    for n, (name, pattern, _) in enumerate(KINDS):
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        good = (F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= 6) if name == "assign"
                else F.transform(matches, _mixed) if name == "token" else F.transform(matches, lambda v: F.lit(True)))
        found.append(F.struct(F.lit(n).alias("kind"), F.arrays_zip(
            F.transform(F.split("text", pattern, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("width"),
            good.alias("good")).alias("list")))
    kinds = some.select(*key, F.explode(F.array(*found)).alias("of")).dropDuplicates([*key, "of"])
    rows = kinds.select(*key, "of.kind", F.posexplode("of.list").alias("i", "m"))
    by = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce("m.width", F.lit(0))).over(by)
    rows = rows.select(*key, "kind", end.alias("end"), "m.width", "m.good")
    return rows.filter("width is not null and good").select(*key, "kind", (F.col("end") - F.col("width")).alias("start"), "end")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts with complementary parts around them."""
    key = ["doc_id", "text_hash"]
    role = F.element_at(F.array(*[F.lit(r) for *_, r in KINDS]), F.col("kind") + 1)
    base = F.col("kind") < _BASE
    by = Window.partitionBy(*key).orderBy("start", "kind", "end")
    secret = base & (F.col("role") == "secret")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    ends, starts = (lambda of: F.max(F.when(of, F.col("end"))).over(before)), (lambda of: F.min(F.when(of, F.col("start"))).over(after))
    meets = lambda end, start: (F.coalesce(end, F.lit(0)) > F.col("start")) | (F.coalesce(start, F.col("end")) < F.col("end"))
    seen = parts.withColumn("role", role).select("*", ends(base).alias("end_any"), starts(base).alias("start_any"),
                                                 ends(secret).alias("end_secret"), starts(secret).alias("start_secret"))
    # What a base span covers is already reported (one that covers a weak part comes before it), and so is a token that
    # runs on from a base span. An identifier or endpoint with a base span of another role inside or across is its partner.
    out = F.when(F.col("kind") == _TOKEN, meets("end_any", "start_any")).otherwise(F.coalesce("end_any", F.lit(0)) >= F.col("end"))
    partner = F.when(F.col("role") == "endpoint", meets("end_any", "start_any")).otherwise(
        (F.col("role") == "identifier") & meets("end_secret", "start_secret"))
    free = seen.filter(base | ~out).select(*key, "kind", "start", "end", "role", base.alias("strong"),
                                           (~base & partner).alias("held"), F.expr(f"start div {reach}").alias("cell"))
    posts = free.groupBy(*key, "cell", "role", "strong").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    probes = free.filter(~F.col("strong")).select("*", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("at"))
    p, q = probes.alias("p"), posts.alias("q")
    near = p.join(q, F.col("p.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("p.text_hash") == F.col("q.text_hash"))
                  & (F.col("p.at") == F.col("q.cell")) & (F.col("p.role") != F.col("q.role"))
                  & (F.col("q.low") <= F.col("p.start") + reach) & (F.col("q.high") >= F.col("p.start") - reach))
    whole = near.groupBy("p.doc_id", "p.text_hash", "p.kind", "p.start", "p.end").agg(
        F.bool_or("q.strong").alias("strong"), F.min("q.role").alias("one"), F.max("q.role").alias("other"))
    spans = [*key, "kind", "start", "end"]
    return whole.filter("strong or one != other").select(*spans).unionByName(free.filter("held").select(*spans)).dropDuplicates(spans)


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, spans, parts.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then in the order of ``KINDS``, comma-joined;
    ``base_sha256`` is the digest of the same list of base kinds alone; ``parts`` has the spans as an array of (start,
    kind, end). Null and empty texts have none. A row is known by its doc_id and text: equal rows get the same answer,
    once each; a null doc_id is a value like others. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    parts = cut_lineage(_parts(rows))
    spans = parts.filter(F.col("kind") < _BASE).unionByName(_linked(parts, reach))
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    listed = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    text = lambda found: F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))
    base = F.filter("f.found", lambda s: s["kind"] < _BASE)
    count = lambda n: F.coalesce(F.size(F.filter("f.found", lambda s: s["kind"] == n)), F.lit(0)).cast("bigint")
    out = rows.select(*key).alias("d").join(listed.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                                            & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    return out.select("d.doc_id", "d.text_hash", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(F.coalesce(text(base), F.lit("")), 256).alias("base_sha256"),
                      F.coalesce(text(F.col("f.found")), F.lit("")).alias("spans"), F.col("f.found").alias("parts"))
