"""Toxicity by class-conditional Kneser-Ney models of words, with evidence of single words and of the characters inside words.

Toxic and ordinary labelled texts give one interpolated Kneser-Ney model of a word after another each (``kneser_ney``): every pair of words
counts in its class, less modified discounts for counts 1, 2 and 3 or more, and both classes back off to the words of all documents.

Expressions too rare for that are weighed besides. They count by the contexts that they stand in: a word by the different words before
it, a run of 4 or 5 characters by the different words that hold it, so copies of a text add next to nothing. Labelled rows are dealt into
counting and held-back ones, and the probability of an expression in a class is how often expressions with the same counts in
both classes, and about the same shared count over all documents, occur in held-back texts of the class. Where counts don't
tell the classes apart, both back off to the same probability; a rare or unseen word backs off to its characters.

A text is compared by the differences of its log-likelihoods under the two classes, normalised by its length. Since a few words decide
about long texts, the parts of the differences above ``CLEAR`` are measured by themselves. A logistic curve, fitted on a
bounded number of held-back rows with both classes weighted by their sizes, turns this into a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.llm.hashset import HashFilter
from featforge.llm.kneser_ney import AskedTables, WordModels, WordTables, count_pairs, word_tables
from featforge.session import cut_lineage, scratch_path

#: Labelled rows of a class that the logistic curve is fitted on, about; one in ``HELD_BACK`` rows is held back from the counts.
ROWS = 6000
HELD_BACK = 4
#: Largest number of entries of a level in the model that is sent to tasks: those with the largest ratios and counts. Others back off.
ENTRIES = 4_000_000
#: Entries with a smaller log-ratio back off too; parts above ``CLEAR`` are measured by themselves.
LEAST = 0.1
CLEAR = 1.0
#: Lengths of character runs, with a mark at each end of a word.
SHORT, LONG = 4, 5
#: Pseudo-counts of held-back occurrences in a cell of like counts, and in its part with like shared counts.
PRIOR, PART = 0.5, 2.0
_PAIR = np.uint64(0x9FB21C651E98DF25)
_CELLS = 16
#: Bytes of text, about, that a task looks up the pairs of words of at once.
BLOCK = 1 << 23


def _contexts(t: X.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and of the one before it, 0 at the start of a text."""
    words = t.word_hashes()
    before = np.zeros_like(words)
    before[1:] = np.where(t.doc[1:] == t.doc[:-1], words[:-1], np.uint64(0))
    return words, before


def held_back(t: X.Texts, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which texts the counts leave out: by their smallest pair of words, so that copies and most near copies go together."""
    pairs = X.mix(words ^ X.mix(before * _PAIR) * _PAIR)
    least = np.zeros(t.n, np.uint64)
    some = np.flatnonzero(np.diff(t.bounds))
    if len(some):
        least[some] = np.minimum.reduceat(pairs, t.bounds[some])
    return X.mix(least) % np.uint64(HELD_BACK) == 0


def _counted(t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the ones before them, and their texts, without the texts that are held back."""
    words, before = _contexts(t)
    some = ~held_back(t, words, before)[t.doc]
    return words[some], before[some], t.doc[some]


def _runs(t: X.Texts, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For short and long runs of characters of the words ``at``: which word, from left to right, and the run's hash."""
    start, size = t.start[at], t.end[at] - t.start[at] + 2
    total = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(at)), size)
    off = np.arange(total[-1]) - total[owner]
    code = np.where(off == 0, 1000, 1001).astype(np.uint64)
    inner = (off > 0) & (off < size[owner] - 1)
    code[inner] = t._codes[(start[owner] + off - 1)[inner]]
    out = []
    for k in (SHORT, LONG):
        n = max(0, len(code) - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(1009) + code[j:j + n]
        whole = owner[:n] == owner[k - 1:k - 1 + n]
        out.append((owner[:n][whole], X.mix(h[whole] + np.uint64(k))))
    return out


def _summed(keys: np.ndarray, n: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sums of ``n`` and with a bit for each of 64 shares of contexts they stand in."""
    if not len(keys):
        return keys, n, np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, bits = keys[order], np.uint64(1) << (X.mix(context[order]) & np.uint64(63))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first), np.bitwise_or.reduceat(bits, first)


def _counts(texts: DataFrame, keep: HashFilter | None) -> DataFrame:
    """(level, key) with occurrences and bits of contexts, in counted rows (n, mask) and in those held back (n_held, mask_held).

    Level 0 has words, the others runs of so many characters. With ``keep``, only keys that it holds.
    """
    shared = texts.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in batches:
            for t in X.chunks(batch.column(0), X.PLAIN_LOWER):
                words, before = _contexts(t)
                held = held_back(t, words, before)[t.doc]
                for fold in (0, 1):
                    some = np.flatnonzero(held == bool(fold))
                    own, first, n = np.unique(words[some], return_index=True, return_counts=True)
                    levels = [(0, words[some], np.ones(len(some), np.int64), before[some])]
                    levels += [(k, h, n[of], own[of]) for k, (of, h) in zip((SHORT, LONG), _runs(t, some[first]))]
                    for level, keys, count, context in levels:
                        if keep is not None and len(keys):
                            known = keep.has(keys)
                            keys, count, context = keys[known], count[known], context[known]
                        keys, count, mask = _summed(keys, count, context)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)),
                             pa.array(np.full(len(keys), fold, np.int32)), pa.array(count), pa.array(mask.view(np.int64))],
                            ["level", "key", "fold", "n", "mask"])

    rows = texts.select("text").mapInArrow(run, "level int, key bigint, fold int, n bigint, mask bigint")
    of = lambda f, c: F.when(F.col("fold") == f, F.col(c)).otherwise(F.lit(0).cast("bigint"))
    return rows.groupBy("level", "key").agg(F.sum(of(0, "n")).alias("n"), F.bit_or(of(0, "mask")).alias("mask"),
                                            F.sum(of(1, "n")).alias("n_held"), F.bit_or(of(1, "mask")).alias("mask_held"))


def contexts_seen(n: str, mask: str) -> Column:
    """About how many contexts set the bits, at most the occurrences; where nearly all bits are set, the occurrences."""
    bits = F.bit_count(mask)
    return F.when(bits > 48, F.col(n)).otherwise(F.least(F.col(n), F.round(-64 * F.log(1 - F.least(bits, F.lit(48)) / 64.0)).cast("bigint")))


def _cell(count: Column) -> Column:
    """Counts below 4 by themselves, then three cells for each factor of 4."""
    wide = 4 + F.floor(F.log2(F.greatest(count, F.lit(4)) / 4.0) * 1.5)
    return F.when(count < 4, count).otherwise(F.least(wide, F.lit(_CELLS - 1))).cast("int")


def _corpus_counts(docs: DataFrame, keep: HashFilter) -> DataFrame:
    """(key, shared): how often the words whose upper halves pass ``keep`` occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in batches:
            for t in X.chunks(batch.column(0), X.PLAIN_LOWER):
                words = t.word_hashes()
                some, n = np.unique(words[keep.has(words >> np.uint64(32))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("shared"))


def log_ratios(cells: dict[str, np.ndarray]) -> np.ndarray:
    """Log-ratio of the classes' probabilities in each cell, from what held-back rows hold of its expressions.

    ``cells`` has level, a and b (cells of the toxic and ordinary counts), s (of the shared count), bad and good (held-back counts). Expressions
    well known in both classes set the scale. A part with like shared counts is smoothed towards its whole cell.
    """
    level, a, b, bad, good = (cells[c] for c in ("level", "a", "b", "bad", "good"))
    out = np.zeros(len(level))
    for k in np.unique(level):
        of = np.flatnonzero(level == k)
        known = of[(a[of] >= 4) & (b[of] >= 4)]
        if not bad[known].sum() or not good[known].sum():
            known = of
        scale = max(bad[known].sum(), PRIOR) / max(good[known].sum(), PRIOR)
        cell = a[of] * _CELLS + b[of]
        whole = np.log(np.bincount(cell, bad[of], _CELLS ** 2) + PRIOR) - np.log(np.bincount(cell, good[of], _CELLS ** 2) * scale + PRIOR)
        lean = np.exp(whole[cell] / 2)
        out[of] = np.log(bad[of] + PART * lean) - np.log(good[of] * scale + PART / lean)
    return out


@dataclass
class Model:
    """Sorted hashes of words and of short and long character runs with their log-ratios; weights of the logistic curve; the Kneser-Ney models."""

    levels: dict[int, tuple[np.ndarray, np.ndarray]]
    curve: np.ndarray
    models: WordTables | AskedTables | None = None

    def ratios(self, t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which distinct word each word is; log-ratios of the distinct words by the word itself and by its characters."""
        _, first, which = np.unique(t.word_hashes(), return_index=True, return_inverse=True)
        own = _lookup(*self.levels[0], t.word_hashes()[first])
        (short_of, short), (long_of, long) = _runs(t, first)
        low, high = _distinct(*self.levels[SHORT], short), _distinct(*self.levels[LONG], long)
        # A long run given the short one that it begins with: what two long runs share is counted once.
        first_, last = np.ones(len(short), bool), np.ones(len(short), bool)
        first_[1:] = last[:-1] = short_of[1:] != short_of[:-1]
        shared = ~first_ & ~last
        spelled = np.bincount(long_of, high, len(first)) - np.bincount(short_of[shared], low[shared], len(first))
        spelled += np.bincount(short_of, np.where(first_ & last, low, 0), len(first))
        return which, own, spelled

    def measure(self, t: X.Texts, near: WordModels | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Difference of the models' log-likelihoods of each text (without models of the single words'), and the inputs of the curve.

        ``near`` are the models of the words of ``t``, if they are known.
        """
        n, parts = np.diff(t.bounds), []
        which, *ratios = self.ratios(t)
        # Clear parts count once a text, or a word that a text repeats would outweigh all others.
        once = np.unique(t.doc * np.int64(max(1, len(ratios[0]))) + which)
        doc, word = once // max(1, len(ratios[0])), once % max(1, len(ratios[0]))
        for ratio in ratios:
            parts += [np.bincount(t.doc, ratio[which], t.n), np.bincount(doc, np.maximum(ratio[word] - CLEAR, 0), t.n)]
        x = inputs(n, np.bincount(doc, minlength=t.n), *parts)
        if self.models is None:
            return parts[0], x
        words, before = _contexts(t)
        which, ratio = (near or self.models.near(words, before)).ratios(words, before)
        once = np.unique(t.doc * np.int64(max(1, len(ratio))) + which)
        doc, pair = once // max(1, len(ratio)), once % max(1, len(ratio))
        excess, clear = np.bincount(t.doc, ratio[which], t.n), np.bincount(doc, np.maximum(ratio[pair] - CLEAR, 0), t.n)
        return excess, np.concatenate((_compared(n, np.bincount(doc, minlength=t.n), excess, clear), x), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _distinct(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    own, which = np.unique(wanted, return_inverse=True)
    return _lookup(keys, values, own)[which]


def inputs(n: np.ndarray, distinct: np.ndarray, words: np.ndarray, clear_words: np.ndarray, spelled: np.ndarray,
           clear_spelled: np.ndarray) -> np.ndarray:
    """By words and by characters: the difference a word, its clear part a distinct word, and the size of the clear part; and a constant."""
    return np.concatenate((_compared(n, distinct, words, clear_words), _compared(n, distinct, spelled, clear_spelled), np.ones((len(n), 1))), 1)


def _compared(n: np.ndarray, distinct: np.ndarray, whole: np.ndarray, clear: np.ndarray) -> np.ndarray:
    n, distinct = np.maximum(n, 1), np.maximum(distinct, 1)
    return np.stack([np.clip(whole / n, -2, 2) * 10, np.clip(clear / distinct, 0, 2) * 10, np.log1p(clear)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Weights of a logistic curve by Newton steps."""
    out = np.zeros(x.shape[1])
    shrink = penalty * np.eye(len(out))
    shrink[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        slope = x.T @ (weight * (y - p)) - shrink @ out
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + shrink + 1e-9 * np.eye(len(out)), slope)
        out += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return out


def _texts_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of the documents with a label, saved once for all counts: others are mostly left in their tasks by a bit filter, whatever the number of labels."""
    hashed = lambda: F.xxhash64("doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(HashFilter.build(labels.select(hashed().alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shared.value.has(batch.column(2).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(known)) for i in (0, 1)], ["doc_id", "text"])

    rows = docs.select("doc_id", "text").filter("doc_id is not null").withColumn("h", hashed())
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The number of labels grows with the documents, so the same join is used at every size.
    path = scratch_path(docs.sparkSession, "labelled")
    rows = rows.mapInArrow(run, f"doc_id {kind}, text string").join(labels.hint("merge"), "doc_id").select("toxic", "text")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _entries(table: DataFrame, level: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and log-ratios of a level, the ``most`` with the largest products of ratio and root of count if there are more."""
    rows = table.filter((F.col("level") == level) & (F.abs("ratio") >= LEAST))
    rows = rows.select("key", "ratio", F.floor(F.log2(F.abs("ratio") * F.sqrt("all") + 1) * 8).cast("int").alias("weight"))
    by = sorted(((r["weight"], r["count"]) for r in rows.groupBy("weight").count().collect()), reverse=True)
    bound, count = (by[0][0] + 1 if by else 0), 0
    for weight, some in by:
        count += some
        if count > most:
            break
        bound = weight
    found = rows.filter(F.col("weight") >= bound).select("key", "ratio").toArrow()
    keys, ratio = found["key"].to_numpy().view(np.uint64), found["ratio"].to_numpy()
    order = np.argsort(keys)
    return keys[order], ratio[order]


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = ROWS, entries: int = ENTRIES) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``train`` is a condition on doc_id of labels.

    The counts cover all labelled rows (of repeated labels the largest counts, null labels and ids not at all), the shared counts all
    documents. Only the curve is fitted on a sample, of about ``rows`` held-back documents of each class, drawn by a hash
    of their id. Without documents of both classes every score is the share of toxic labels, 0 if there are none.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if train is not None:
        known = known.filter(F.coalesce(train, F.lit(False)))
    known = cut_lineage(known.filter("toxic in (0, 1)"))
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = _texts_of(docs, known)
    pairs, words = count_pairs(texts, _counted)
    shared = _corpus_counts(docs, HashFilter.build(words.select(F.col("word").cast("bigint").alias("key")), "key"))
    shared = cut_lineage(shared.select("key", F.shiftright("key", 32).cast("int").alias("word"), "shared"))
    models = word_tables(pairs, words, shared.groupBy("word").agg(F.sum("shared").alias("shared")))
    bad = cut_lineage(_counts(texts.filter("toxic = 1"), None).filter("n > 0"))
    keep = HashFilter.build(bad.select("key"), "key")
    good = _counts(texts.filter("toxic = 0"), keep)
    seen = lambda df, name: df.select("level", "key", contexts_seen("n", "mask").alias(name),
                                      contexts_seen("n_held", "mask_held").alias(f"{name}_held"))
    table = seen(bad, "bad").join(seen(good, "good"), ["level", "key"], "left")
    table = table.join(shared.select(F.lit(0).alias("level"), "key", "shared"), ["level", "key"], "left").na.fill(0)
    part = F.when(F.col("level") == 0, F.least(F.floor(F.log2(F.col("shared") + 1) / 2), F.lit(9))).otherwise(0).cast("int")
    table = cut_lineage(table.select("level", "key", _cell(F.col("bad")).alias("a"), _cell(F.col("good")).alias("b"), part.alias("s"),
                                     (F.col("bad") + F.col("good")).alias("all"), "bad_held", "good_held"))
    # At most 3 * 16 * 16 * 10 cells.
    cells = table.groupBy("level", "a", "b", "s").agg(F.sum("bad_held").alias("bad"), F.sum("good_held").alias("good")).toArrow()
    cells = {c: cells[c].to_numpy() for c in cells.column_names}
    ratio = log_ratios(cells)
    values = [(int(k), int(a), int(b), int(s), float(r)) for k, a, b, s, r in zip(*[cells[c] for c in ("level", "a", "b", "s")], ratio)]
    cells_of = spark.createDataFrame(values, "level int, a int, b int, s int, ratio double")
    table = table.join(cells_of, ["level", "a", "b", "s"])
    model = Model({k: _entries(table, k, entries) for k in (0, SHORT, LONG)}, np.zeros(10), models)
    share = F.lit(1.0)
    for c in (0, 1):
        share = F.when(F.col("toxic") == c, F.lit(HELD_BACK * rows / max(1, count.get(c, 0)))).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < share)
    # At most about 2 * HELD_BACK * rows labels, whatever the number of documents.
    drawn = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    tuned = _tuned(drawn, model).toArrow()
    y, n = tuned["toxic"].to_numpy().astype(float), {c: max(1, count.get(c, 0)) for c in (0, 1)}
    if count.get(0) and count.get(1) and 0 < y.sum() < len(y):
        x = tuned["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        weight = np.where(y == 1, n[1] / y.sum(), n[0] / (len(y) - y.sum()))
        model.curve = _logistic(x, y, weight * len(y) / weight.sum())
    else:
        rate = min(max(count.get(1, 0) / max(1, sum(count.values())), 1e-9), 1 - 1e-9)
        model.curve = np.append(np.zeros(9), np.log(rate / (1 - rate)))
    return model


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.RecordBatch, X.Texts, np.ndarray, np.ndarray]]]:
    """Chunks of the texts in the second column with their words and the ones before them, in blocks of about ``BLOCK`` bytes."""
    held, size = [], 0
    for batch in batches:
        for t in X.chunks(batch.column(1), X.PLAIN_LOWER):
            held.append((batch, t, *_contexts(t)))
            size += len(t.data)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _together(block: list[tuple[pa.RecordBatch, X.Texts, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([words for *_, words, _ in block]), np.concatenate([before for *_, before in block])


def _measured(rows: DataFrame, model: Model, schema: str, made: Callable[[pa.RecordBatch, X.Texts, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What ``made`` makes of the first column of ``rows``, the texts in the second one, their differences and their inputs of the curve.

    The rows are scanned twice, and both scans must see the same ones: the first asks for the pairs of words of its blocks, the second measures.
    """
    asked = model.models and model.models.ask(rows, lambda batches: (_together(block) for block in _blocks(batches)))
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, models=asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in _blocks(batches):
            near = model.models and model.models.near(*_together(block))
            for batch, t, *_ in block:
                yield made(batch, t, *model.measure(t, near))

    return rows.mapInArrow(run, schema)


def _tuned(rows: DataFrame, model: Model) -> DataFrame:
    """toxic and the inputs of the curve of the held-back texts among ``rows`` (toxic, text)."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in X.chunks(batch.column(1), X.PLAIN_LOWER):
                yield batch.take(pa.array(np.flatnonzero(held_back(t, *_contexts(t))) + t.first))

    def made(batch: pa.RecordBatch, t: X.Texts, excess: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        edges = pa.array(np.arange(t.n + 1, dtype=np.int32) * x.shape[1])
        return pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), pa.ListArray.from_arrays(edges, pa.array(x.ravel()))], ["toxic", "x"])

    path = scratch_path(rows.sparkSession, "held-back")
    rows.mapInArrow(held, "toxic int, text string").write.option("compression", "zstd").parquet(path)
    return _measured(rows.sparkSession.read.parquet(path), model, "toxic int, x array<double>", made)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score, predicted, excess (toxic less ordinary log-likelihood of its words), n_words.

    A null or empty text has no words, an excess of 0 and the score of that. Other columns are not read, repeated rows score alike.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    curve = replace(model, levels={}, models=None)

    def made(batch: pa.RecordBatch, t: X.Texts, excess: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        score = curve.score(x)
        return pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                                           pa.array(excess), pa.array(np.diff(t.bounds))],
                                          ["doc_id", "score", "predicted", "excess", "n_words"])

    return _measured(docs.select("doc_id", "text"), model, f"doc_id {kind}, score double, predicted int, excess double, n_words bigint", made)
