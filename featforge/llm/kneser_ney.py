"""Interpolated Kneser-Ney models of a word after another, one for each of two classes of texts, with the modified discounts of Chen and Goodman.

Of the occurrences of a pair of words, a discount for counts of 1, 2 and 3 or more is taken off. What a context frees goes to the word
by itself, which counts by the different words before it, discounted likewise; what is freed there goes to the word's share of
all documents. All words that no text of the classes has share one place.

Pairs, contexts and words are counted in either class and in both together. A class has less to learn from than both, so its pairs back off to the
pairs of both, and its words to the words of both: where a class knows nothing, the models agree. The pairs that a class
backs off to are scaled by how much likelier it makes the word, as models are adapted by marginals. After a word that only
one class has, the pairs of that class don't count: the class with more texts would win whatever follows.

Every pair, context and word of the texts is counted, by Spark, and has its place in the models (``WordTables``); tasks look up those that their
texts hold (``lookup``). Words are told apart by 32 bits: of 10 million, one in 400 shares its number with another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.llm.lookup import Answers, answers
from featforge.session import scratch_path

#: Words that a task counts at once.
WORDS = 1 << 21
#: A discount is at least this, so that every context leaves something to unseen words.
LEAST_DISCOUNT = 0.1
_HALF = np.uint64(32)
_CLASSES = ("bad", "good")
_COUNTS = (*_CLASSES, "both")
_KNOWN = (*_COUNTS, *[f"{c}_left" for c in _COUNTS], "bad_total", "good_total")
_GROUPED = "before int, word int, bad bigint, good bigint"


def pair_keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The upper halves of the hashes of the word before and of the word."""
    return (before >> _HALF) << _HALF | words >> _HALF


def _ids(halves: np.ndarray) -> np.ndarray:
    return halves.astype(np.uint32).view(np.int32)


def _pair_counts(texts: DataFrame, counted: Callable[[X.Texts], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(before, word) with the occurrences in both classes, of ``texts`` (toxic, text); ``counted`` gives words, those before them and their texts."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        toxic = np.concatenate([y for _, y in parts])
        bad, every = np.bincount(which[toxic], minlength=len(keys)), np.bincount(which, minlength=len(keys))
        rows = pa.RecordBatch.from_arrays([pa.array(_ids(keys >> _HALF)), pa.array(_ids(keys & np.uint64(0xFFFFFFFF))), pa.array(bad),
                                           pa.array(every - bad)], ["before", "word", "bad", "good"])
        yield from (rows.slice(at, 50_000) for at in range(0, len(keys), 50_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            toxic = batch.column(0).to_numpy() == 1
            for t in X.chunks(batch.column(1), X.PLAIN_LOWER):
                words, before, doc = counted(t)
                parts.append((pair_keys(words, before), toxic[t.first + doc]))
                size += len(words)
                if size >= WORDS:
                    yield from summed(parts)
                    parts, size = [], 0
        if size:
            yield from summed(parts)

    # Pairs of a context come together, so that its totals need no further shuffle.
    rows = texts.select("toxic", "text").mapInArrow(run, _GROUPED).repartition("before")
    return rows.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in _CLASSES], F.sum(F.col("bad") + F.col("good")).alias("both"))


def _with_contexts(pairs: DataFrame) -> DataFrame:
    """The pairs with what is known of their context in each class and in both: occurrences, pairs, pairs counted once and twice; ``first`` marks one pair of each."""
    of = Window.partitionBy("before")
    sums = [s.over(of).alias(f"{c}_{name}") for c in _COUNTS for name, s in (
        ("total", F.sum(c)), ("pairs", F.count_if(F.col(c) > 0)), ("ones", F.count_if(F.col(c) == 1)), ("twos", F.count_if(F.col(c) == 2)))]
    return pairs.select("*", (F.row_number().over(of.orderBy("word")) == 1).alias("first")).select("*", *sums)


def discounts(counts: list[int]) -> np.ndarray:
    """What is taken off counts of 1, 2 and 3 or more, from how many expressions have counts of 1, 2, 3 and 4."""
    y, out = counts[0] / max(1, counts[0] + 2 * counts[1]), []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * counts[k] / counts[k - 1] if counts[k - 1] else (out[-1] if out else 0.75)
        out.append(min(max(d, LEAST_DISCOUNT), k))
    return np.array(out)


def _measured(rows: DataFrame) -> list[tuple[np.ndarray, int, float]]:
    """For each of the columns of counts the discounts, the sum, and the share of it that they take off."""
    got, out = list(rows.agg(*[f for c in _COUNTS for f in (*[F.count_if(F.col(c) == k) for k in (1, 2, 3, 4)], F.count_if(F.col(c) > 0),
                                                           F.coalesce(F.sum(c), F.lit(0)))]).first()), []
    for at in range(0, len(got), 6):
        d, (ones, twos, _, _, some, total) = discounts(got[at:at + 4]), got[at:at + 6]
        out.append((d, total, float((ones * d[0] + twos * d[1] + (some - ones - twos) * d[2]) / total) if total else 1.0))
    return out


def _less(count: str, d: np.ndarray) -> Column:
    """The count without its discount."""
    off = F.when(F.col(count) == 1, float(d[0])).when(F.col(count) == 2, float(d[1])).otherwise(float(d[2]))
    return F.when(F.col(count) > 0, F.greatest(F.col(count) - off, F.lit(0.0))).otherwise(0.0)


def _freed(ones: Column, twos: Column, every: Column, d: np.ndarray) -> Column:
    """All that the discounts take off."""
    return ones * float(d[0]) + twos * float(d[1]) + (every - ones - twos) * float(d[2])


def _heaviest(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """At most ``most`` rows, with the largest weights."""
    rows = rows.withColumn("weight", F.floor(F.log2(weight + 1) * 8).cast("int"))
    count, bound = 0, None
    for r in sorted(rows.groupBy("weight").count().collect(), key=lambda r: -r["weight"]):
        count += r["count"]
        if count > most:
            break
        bound = r["weight"]
    return rows.filter(F.lit(False) if bound is None else F.col("weight") >= bound).drop("weight")


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, ``other`` for unknown ones."""
    if not len(keys):
        return np.tile(other, (len(wanted), 1))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at].astype(float), other)


@dataclass
class WordModels:
    """Sorted keys with a number for either class and for both: discounted shares of pairs in their context, what contexts leave, probabilities of words."""

    pairs: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    unknown: np.ndarray

    def ratios(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct pair each word is with the one before it, and the log-ratios of the classes' probabilities of the distinct pairs."""
        keys, which = np.unique(pair_keys(words, before), return_inverse=True)
        alone = _found(*self.words, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.unknown)
        left = _found(*self.contexts, (keys >> _HALF).astype(np.uint32), np.ones(3))
        share = _found(*self.pairs, keys, np.zeros(3))
        both = share[:, 2] + left[:, 2] * alone[:, 2]
        p = share[:, :2] + left[:, :2] * (both / alone[:, 2])[:, None] * alone[:, :2]
        return which, np.log(p[:, 0]) - np.log(p[:, 1])


def wanted(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, and words and contexts, that texts ask ``WordTables`` for: mixed keys, ascending."""
    ids = np.unique(np.concatenate((words >> _HALF, before >> _HALF)))
    return np.unique(X.mix(pair_keys(words, before))), np.sort(X.mix(ids))


@dataclass
class WordTables:
    """All pairs with a context of both classes (key and occurrences in either class), and all words (``_KNOWN``), as saved tables."""

    tables: list[DataFrame] | None
    off: np.ndarray
    unknown: np.ndarray

    def models(self, pairs: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]) -> WordModels:
        """The models of some keys of either table with their values, one row a key."""
        (keys, counts), (ids, known) = [(keys[order], values[order]) for keys, values, order in ((*t, np.argsort(t[0])) for t in (pairs, words))]
        ids, told, context = ids.astype(np.uint32), known[:, 2] > 0, known[:, 6] > 0
        totals = _found(ids[context], known[context, 6:8], (keys >> _HALF).astype(np.uint32), np.zeros(2))
        some, share = totals[:, 0] > 0, np.zeros((len(keys), 3), np.float32)
        counts, totals = [np.concatenate((n, n.sum(1, keepdims=True)), 1)[some] for n in (counts.astype(float), totals)]
        for c in range(3):
            n = counts[:, c]
            off = self.off[c][np.clip(n, 1, 3).astype(int) - 1]
            share[some, c] = np.where(n > 0, np.maximum(n - off, 0), 0) / totals[:, c]
        return WordModels((keys, share), (ids[context], known[context, 3:6]), (ids[told], known[told, :3]), self.unknown)

    def _read(self, tables: list[DataFrame]) -> WordModels:
        got = [t.toArrow() for t in tables]
        return self.models(*[(t[0].to_numpy().view(np.uint64), np.stack([c.to_numpy() for c in t.columns[1:]], 1)) for t in got])

    def whole(self) -> WordModels:
        return self._read(self.tables)

    def near(self, words: np.ndarray, before: np.ndarray) -> WordModels:
        """The models of a few texts, on the driver."""
        asked = [pa.table({"key": np.unique(k).view(np.int64)}) for k in (pair_keys(words, before), np.concatenate((words, before)) >> _HALF)]
        return self._read([t.join(F.broadcast(t.sparkSession.createDataFrame(keys)), "key") for t, keys in zip(self.tables, asked)])

    def ask(self, rows: DataFrame, blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> AskedTables:
        """The answers to the blocks of a scan of ``rows``; ``blocks`` gives the words of each block and those before them."""
        return AskedTables(replace(self, tables=None), answers(rows, lambda batches: (wanted(*block) for block in blocks(batches)), self.tables))


@dataclass
class AskedTables:
    """What tasks get: no table, but the place of the answers to their blocks."""

    tables: WordTables
    answers: Answers

    def near(self, words: np.ndarray, before: np.ndarray) -> WordModels:
        """The models of a block."""
        return self.tables.models(*self.answers.of(wanted(words, before)))


def count_pairs(texts: DataFrame, counted: Callable[[X.Texts], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """Pairs with their contexts' totals, and words with the number of different words before them in either class; both are saved."""
    spark, saved = texts.sparkSession, [scratch_path(texts.sparkSession, name) for name in ("pairs", "words")]
    _with_contexts(_pair_counts(texts, counted)).write.option("compression", "zstd").parquet(saved[0])
    pairs = spark.read.parquet(saved[0])
    pairs.groupBy("word").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in _COUNTS]).write.option("compression", "zstd").parquet(saved[1])
    return pairs, spark.read.parquet(saved[1])


def _unsigned(id: str) -> Column:
    return F.col(id).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def word_tables(pairs: DataFrame, words: DataFrame, shared: DataFrame, entries: int | None = None) -> WordTables:
    """From the tables of ``count_pairs`` and ``shared`` (word, shared): how often words occur in all documents; ``entries`` bounds the rows of each table.

    Where only one class has a context, all that follows backs off in either class, so that these contexts and their pairs need no place.
    """
    spark, d, known = pairs.sparkSession, _measured(pairs), F.col("bad_total") * F.col("good_total") > 0
    pairs, contexts = pairs.filter(known), pairs.filter(known & F.col("first"))
    left = [(_freed(*[F.col(f"{c}_{name}") for name in ("ones", "twos", "pairs")], off) / F.col(f"{c}_total")).alias(f"{c}_left")
            for c, (off, _, _) in zip(_COUNTS, d)]
    contexts = contexts.select(_unsigned("before").alias("key"), *left, "bad_total", "good_total", F.col("both_total").alias("w"))
    # The same one level down, where a word's count is the number of different words before it.
    (bad, bad_total, bad_left), (good, good_total, good_left), (both, both_total, both_left) = _measured(words)
    every = (shared.agg(F.sum("shared")).first()[0] or 0) + words.count() + 1
    of_both = _less("both", both) / float(max(1, both_total)) + (F.coalesce("shared", F.lit(0)) + 1) / float(every) * both_left
    rows = words.join(shared, "word", "left").withColumn("base", of_both)
    alone = [(_less(c, off) / float(max(1, total)) + F.col("base") * rest).alias(c)
             for c, off, total, rest in (("bad", bad, bad_total, bad_left), ("good", good, good_total, good_left))]
    alone = rows.select(_unsigned("word").alias("key"), *alone, F.col("base").alias("both"), F.col("both").alias("w"))
    if entries is not None:
        # Pairs by how far the classes differ in their context and by the root of their count.
        apart = F.abs(F.log((F.col("bad") + 0.5) / (F.col("bad_total") + 0.5)) - F.log((F.col("good") + 0.5) / (F.col("good_total") + 0.5)))
        pairs = _heaviest(pairs, apart * F.sqrt("both") * 8, entries)
        contexts, alone = [_heaviest(t, F.col("w"), entries) for t in (contexts, alone)]
    key = F.shiftleft(_unsigned("before"), 32).bitwiseOR(_unsigned("word"))
    tables = [pairs.select(key.alias("key"), *[F.col(c).cast("float").alias(c) for c in _CLASSES]),
              alone.drop("w").join(contexts.drop("w"), "key", "full").na.fill(0.0).select("key", *[F.col(c).cast("float").alias(c) for c in _KNOWN])]
    saved = [scratch_path(spark, name) for name in ("pair-table", "word-table")]
    for table, path in zip(tables, saved):
        table.write.option("compression", "zstd").parquet(path)
    return WordTables([spark.read.parquet(path) for path in saved], np.stack([off for off, _, _ in d]),
                      np.array([bad_left, good_left, 1.0]) * both_left / every)


def word_models(pairs: DataFrame, words: DataFrame, shared: DataFrame, entries: int | None = None) -> WordModels:
    """The whole ``word_tables`` on the driver, for small ones."""
    return word_tables(pairs, words, shared, entries).whole()
