"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A window is ``size`` consecutive words of an item (an item of fewer words is one window). Its tokens are its shingles of
``shingle`` words. Exact containment means that all of them occur, so a prefix of one is enough: the rarest in the
corpus. Documents post their occurrences of prefix shingles only; each is joined with the windows that have it, the
position of the shingle in the window gives the one place where the window can lie, which must be inside the document,
and the words there are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.llm.hashset import HashFilter
from featforge.session import cut_lineage

WINDOW = 10
SHINGLE = 3


def _words(t: X.Texts, first: int, last: int) -> list[str]:
    """Words of a chunk as text, in lower case."""
    return [bytes(t.data[a:b]).lower().decode() for a, b in zip(t.start[first:last].tolist(), t.end[first:last].tolist())]


def item_windows(items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, text: str = "text",
                 key: str = "item_id") -> DataFrame:
    """Rows (item, words, offset, n, h): every window of every item with each of its shingles.

    ``n`` is the number of words in a shingle, the whole window if that is shorter. An item without words has no window;
    a null item id counts as the id "".
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in X.chunks(batch.column(1), X.PLAIN_LOWER):
                hashes, item, words, offset, n, h = t.word_hashes(), [], [], [], [], []
                for d, (a, b) in enumerate(zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist())):
                    if a == b:
                        continue
                    name, text_words, width = batch.column(0)[t.first + d].as_py(), _words(t, a, b), min(size, b - a)
                    k = min(shingle, width)
                    grams = X.ngrams(hashes[a:b], np.zeros(b - a, np.int64), k)[0].view(np.int64).tolist()
                    for start in range(b - a - width + 1):
                        for o in range(width - k + 1):
                            item.append(name)
                            words.append(text_words[start:start + width])
                            offset.append(o)
                            n.append(k)
                            h.append(grams[start + o])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(words, pa.list_(pa.string())),
                                                  pa.array(offset, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64())],
                                                 ["item", "words", "offset", "n", "h"])

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "item string, words array<string>, offset int, n int, h bigint")


def _shingle_counts(docs: DataFrame, keep: HashFilter, sizes: list[int]) -> DataFrame:
    """How often each shingle that passes ``keep`` occurs in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in X.chunks(batch.column(0), X.PLAIN_LOWER):
                hashes = t.word_hashes()
                found = [g[keep.has(g)] for g in (X.ngrams(hashes, t.doc, n)[0] for n in sizes)]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("often"))


def _postings(docs: DataFrame, keep: HashFilter, sizes: list[int], size: int) -> DataFrame:
    """A row for each document (``at`` null) and one for each occurrence of a prefix shingle, with the words around it."""
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("h", pa.int64()),
              ("at", pa.int64()), ("before", pa.int32()), ("around", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in X.chunks(batch.column(1), X.PLAIN_LOWER):
                rows, count = np.arange(t.n) + t.first, np.diff(t.bounds)
                head = [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(count)]
                yield pa.RecordBatch.from_arrays(head + [pa.nulls(t.n, kind) for _, kind in fields[3:]], names=[f for f, _ in fields])
                hashes = t.word_hashes()
                for n in sizes:
                    grams, at = X.ngrams(hashes, t.doc, n)
                    hit = np.flatnonzero(keep.has(grams))
                    for some in np.array_split(hit, -(-len(hit) // 20_000)) if len(hit) else []:
                        word, doc = at[some], t.doc[at[some]]
                        low = np.maximum(t.bounds[doc], word - size + 1)
                        high = np.minimum(t.bounds[doc + 1], word + size)
                        around = [_words(t, a, b) for a, b in zip(low.tolist(), high.tolist())]
                        row = pa.array(doc + t.first)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(row), batch.column(2).take(row), pa.array(count[doc]),
                             pa.array(grams[some].view(np.int64)), pa.array(word - t.bounds[doc]),
                             pa.array((word - low).astype(np.int32)), pa.array(around, pa.list_(pa.string()))],
                            names=[f for f, _ in fields])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_words bigint, h bigint, at bigint, before int, "
                                "around array<string>")


def benchmark_hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): (doc_id, text_hash, n_words) of each row, and every occurrence of a window in a document as
    (doc_id, text_hash, start, n, words), start counted in words.

    ``docs`` has doc_id and text; it is scanned twice. What is sent to every task is a bit filter of bounded size.
    """
    spark = docs.sparkSession
    windows = cut_lineage(item_windows(items, size, shingle))
    sizes = [r.n for r in windows.select("n").distinct().collect()]  # at most ``shingle`` values
    if not sizes:
        empty = _postings(docs, HashFilter(np.zeros(64, np.uint64)), [], size)
        none = spark.createDataFrame([], "doc_id bigint, text_hash bigint, start bigint, n int, words array<string>")
        return empty.select("doc_id", "text_hash", "n_words"), none
    often = _shingle_counts(docs, HashFilter.build(windows.select("h").distinct(), "h"), sizes)
    distinct = windows.groupBy("words", "offset", "n", "h").agg(F.lit(1))
    counted = distinct.join(often, "h", "left")
    prefix = counted.groupBy("words").agg(
        F.min(F.struct("often", "offset", "h")).alias("rarest"), F.count("often").alias("seen"), F.count(F.lit(1)).alias("all"))
    # A window with a shingle that the corpus lacks occurs nowhere.
    prefix = cut_lineage(prefix.filter("seen = all").select("words", "rarest.offset", "rarest.h"))
    posted = cut_lineage(_postings(docs, HashFilter.build(prefix.select("h").distinct(), "h"), sizes, size))
    found = posted.filter("at is not null").join(prefix, "h")
    n = F.size("words")
    begin = F.col("before") - F.col("offset")
    hits = found.filter((begin >= 0) & (F.col("at") - F.col("offset") + n <= F.col("n_words"))
                        & (F.slice("around", F.greatest(begin, F.lit(0)) + 1, n) == F.col("words")))
    hits = hits.select("doc_id", "text_hash", (F.col("at") - F.col("offset")).alias("start"), n.alias("n"), "words")
    return posted.filter("at is null").select("doc_id", "text_hash", "n_words"), hits


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A row is known by its doc_id and its text: equal rows get the same answer, once each; a null doc_id is a value like
    others. Null or empty texts have no words and are never contaminated. No items: nothing is contaminated. Other
    columns are not read, so their names do not matter.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, hits = benchmark_hits(docs, items, size, shingle)
    hits = cut_lineage(hits)
    key = ["doc_id", "text_hash"]
    by = Window.partitionBy(*key).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*key, "start", "n").distinct().withColumn("past", F.coalesce(F.max(F.col("start") + F.col("n")).over(by), F.lit(0)))
    covered = spans.groupBy(*key).agg(F.sum(F.greatest(
        F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "past"))).alias("n_hit"))
    named = item_windows(items, size, shingle).select("item", "words").distinct()
    listed = hits.select(*key, "words").distinct().join(named, "words").groupBy(*key).agg(F.collect_set("item").alias("items"))
    same = lambda other: [F.col(f"d.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in key]
    out = rows.alias("d").join(covered.alias("c"), same("c"), "left").join(listed.alias("i"), same("i"), "left")
    return out.select("d.doc_id", "d.text_hash", "d.n_words", F.coalesce("c.n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.coalesce(F.size("i.items"), F.lit(0)).cast("bigint").alias("n_items"),
                      F.sha2(F.coalesce(F.concat_ws(",", F.array_sort("i.items")), F.lit("")), 256).alias("items_sha256"),
                      F.col("c.n_hit").isNotNull().alias("contaminated"))
