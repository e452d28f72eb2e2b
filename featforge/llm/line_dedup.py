"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: lines are told apart by their number of tokens, then by their first ``DEPTH`` tokens, where a
token with a digit is a variable field and becomes a wildcard. In a leaf, lines that agree in all but one of ``SEGMENTS``
equal runs of the remaining tokens belong to one template with that run generalised, and lines that agree in all tokens
to one template without. So a line has a fixed number of keys, one for each template that it can be an instance of, and
finding templates is counting keys: no line is compared with another, whatever the size of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featforge.session import cut_lineage

DEPTH = 2
SEGMENTS = 3
#: Lines of fewer tokens are never templates; generalising a run asks for this many more than the depth.
MIN_TOKENS = 3
GENERAL_TOKENS = 6
#: Lines of a recurring template, or of one with ``LONG_TOKENS`` tokens or more: chance does not repeat such a line.
MIN_LINES = 3
LONG_TOKENS = 50
LONG_LINES = 2
WILDCARD = "<*>"

_VARIABLE = r"(?<![^\x09-\x0D\x20])[^\x09-\x0D\x200-9]*+[0-9][^\x09-\x0D\x20]*+"
#: Dropped lines are kept as bits of words of this many lines.
_BITS = 63
_NO_ID = -(1 << 63)


def tokens(line: Column) -> Column:
    """Tokens between ASCII white space; those with a digit are the wildcard."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, WILDCARD)).otherwise(line)
    return F.array_remove(F.split(F.translate(masked, "\t\n\u000b\f\r", "     "), " "), "")


def _keys(depth: int, segments: int, min_tokens: int) -> Column:
    """Keys of the templates that a line with ``tokens`` and their number ``n`` can be an instance of."""
    n = F.col("n")
    rest, keys = n - depth, [F.xxhash64(F.lit(-1), n, "tokens")]
    for s in range(segments):
        low = (F.lit(depth) + F.floor(rest * s / segments)).cast("int")
        high = (F.lit(depth) + F.floor(rest * (s + 1) / segments)).cast("int")
        keys.append(F.xxhash64(F.lit(s), n, F.slice("tokens", F.lit(1), low), F.slice("tokens", high + 1, n - high)))
    return F.when(n >= depth + GENERAL_TOKENS, F.array(*keys)).when(n >= min_tokens, F.array(keys[0]))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, depth: int = DEPTH, segments: int = SEGMENTS,
                min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """All columns of ``docs`` with the lines of recurring templates dropped from ``text``, and ``lines_dropped``.

    A template recurs if at least ``min_lines`` lines, or ``LONG_LINES`` of ``long_tokens`` tokens or more, are instances of it and not all in
    one document. They stay in its
    first document, the one with the smallest doc_id, and are dropped elsewhere, so copies of a document lose their lines
    to one that stays whole. Lines end at \\n; blank lines and lines under ``min_tokens`` tokens always stay. A row is
    known by its doc_id: rows of one id are one document, and those with a null id are one that comes before all others.
    Null and empty texts stay as they are. A column ``lines_dropped`` is replaced; other columns pass through.
    """
    key = ["doc_id", "text_hash"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Outer explodes: the others put a filter on the array below it, which would compute all of it once more.
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    lines = rows.select(*key, F.posexplode_outer("lines").alias("at", "line"))
    lines = lines.select(*key, "at", tokens(F.col("line")).alias("tokens")).withColumn("n", F.size("tokens"))
    keyed = cut_lineage(lines.select(*key, "at", (F.col("n") >= long_tokens).alias("long"), _keys(depth, segments, min_tokens).alias("keys")))
    keyed = keyed.select(*key, "at", "long", F.explode_outer("keys").alias("key")).filter("key is not null")
    number = F.coalesce("doc_id", F.lit(_NO_ID))
    # The number of tokens is part of the key, so all lines of a template are long or none is.
    templates = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.min(number).alias("first"), F.max(number).alias("last"),
                                         F.max("long").alias("long"))
    enough = F.col("lines") >= F.when(F.col("long"), F.lit(min(LONG_LINES, min_lines))).otherwise(F.lit(min_lines))
    recurring = cut_lineage(templates.filter(enough & (F.col("first") < F.col("last"))).select("key", "first"))
    hit = keyed.join(recurring, "key").filter(number != F.col("first"))
    words = hit.groupBy(*key, F.expr(f"at div {_BITS}").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(at % {_BITS} as int))")).alias("bits"))
    dropped = words.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"),
                                      F.max("word").alias("last"))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")),
                        lambda w: F.coalesce(F.element_at("found", w), F.lit(0).cast("bigint")))
    dropped = dropped.select(*[F.col(k).alias(f"_{k}") for k in key], dense.alias("_bits"))
    marked = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    out = marked.join(dropped, marked["doc_id"].cast("bigint").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("_text_hash")),
                      "left")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> "
                  f"coalesce(shiftright(try_element_at(_bits, cast(i div {_BITS} as int) + 1), i % {_BITS}) & 1, 0) = 0), '\\n')")
    count = F.aggregate("_bits", F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w))
    return out.select(*[c for c in docs.columns if c not in ("text", "lines_dropped")],
                      F.when(F.col("_bits").isNull(), F.col("text")).otherwise(kept).alias("text"),
                      F.coalesce(count, F.lit(0)).cast("bigint").alias("lines_dropped"))
