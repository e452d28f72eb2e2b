"""Ranked lexical search as an exact inner-product search in ball trees of sparse document vectors.

The score of a document for an item is the inner product of the item's indicator vector with the document's vector of weighted
term impacts. One scan of the texts counts terms over all documents and keeps each document's counts of the items' terms. Those vectors
are then searched in blocks: the documents of a block are split again and again by their distances to two far apart ones,
and every ball knows its centroid, its radius, and its radii within slices of the dictionary. An item's inner product
with anything in a ball is at most that with the centroid plus norm times radius, so balls are visited best first until
none can reach the best documents found so far. Bounds are floating point and rounded up by more than their error; documents in
visited leaves are scored in 64-bit integers, so the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.session import cut_lineage

TOP = 50
#: Documents of a block, and of a leaf of its tree.
BLOCK = 4096
LEAF = 64
#: Terms of the items searched in one pass; more items take more passes over the saved vectors.
DICTIONARY = 1 << 14
#: Slices of the dictionary that a ball has radii for.
SLICES = 256
#: Share of the documents searched first, for scores that the best of all documents can't be below.
FIRST = 64
#: Relative error allowed to bounds, far above that of sums of at most ``DICTIONARY`` doubles.
SLACK = 1e-9


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[list, list[np.ndarray]]:
    """Keys of the items and the hashes of their distinct terms, both bounded by the stated set of items."""
    table = items.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).toArrow()
    terms: list[np.ndarray] = []
    for t in X.chunks(table["text"], X.PLAIN_LOWER):
        hashes = t.word_hashes()
        terms += [np.unique(hashes[a:b]) for a, b in zip(t.bounds, t.bounds[1:])]
    return table["key"].to_pylist(), terms


def dictionaries(terms: list[np.ndarray], most: int = DICTIONARY) -> Iterator[tuple[list[int], np.ndarray]]:
    """(items, sorted terms): runs of items whose terms are at most ``most``, or one item that has more."""
    run, known = [], np.empty(0, np.uint64)
    for i, t in enumerate(terms):
        both = np.union1d(known, t)
        if run and len(both) > most:
            yield run, known
            run, both = [], t
        run.append(i)
        known = both
    if run:
        yield run, known


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value, -1 if it is not there."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def _vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """key, n (terms with repeats), at and tf (places in ``terms`` and counts) of each document, and per batch rows with a null ``n``
    whose ``tf`` are the numbers of documents that hold the terms ``at``, the number with any term, and the number of all terms."""
    kind = docs.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = ["key", "n", "at", "tf"], shared.value
        for batch in batches:
            df, some, all_ = np.zeros(len(known), np.int64), 0, 0
            for t in X.chunks(batch.column(1), X.PLAIN_LOWER):
                n = np.diff(t.bounds)
                place = _find(known, t.word_hashes())
                hit = place >= 0
                pairs, tf = np.unique(t.doc[hit] * np.int64(max(1, len(known))) + place[hit], return_counts=True)
                doc, at = pairs // max(1, len(known)), pairs % max(1, len(known))
                df += np.bincount(at, minlength=len(known))
                some, all_ = some + int((n > 0).sum()), all_ + int(n.sum())
                held = np.unique(doc)
                edges = np.append(np.searchsorted(doc, held), len(doc)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(held + t.first)), pa.array(n[held]), pa.ListArray.from_arrays(edges, pa.array(at.astype(np.int32))),
                     pa.ListArray.from_arrays(edges, pa.array(tf.astype(np.int64)))], names)
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, batch.schema.field(0).type), pa.nulls(1, pa.int64()), pa.array([[*at.tolist(), -1, -2]], pa.list_(pa.int32())),
                 pa.array([[*df[at].tolist(), some, all_]], pa.list_(pa.int64()))], names)

    return docs.mapInArrow(run, f"key {kind}, n bigint, at array<int>, tf array<bigint>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer impact of a term that occurs ``tf`` times among the ``n`` of a document."""
    m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Items:
    """Terms of some items as places in a dictionary, their weights, and the norms that bounds need."""

    def __init__(self, places: list[np.ndarray], weight: np.ndarray):
        self.places, self.weight, self.n = places, weight, len(places)
        size = len(weight)
        self.matrix = np.zeros((size, self.n))
        self.slices = np.zeros((min(SLICES, max(1, size)), self.n))
        for i, p in enumerate(places):
            self.matrix[p, i] = 1
            # The indicator of an item with k terms in a slice has the norm sqrt(k) there.
            self.slices[:, i] = np.sqrt(np.bincount(p % len(self.slices), minlength=len(self.slices)))
        self.norm = np.sqrt([len(p) for p in places])


class Balls:
    """A ball tree over sparse vectors of one block: places ``at`` and values between ``edges``, one run a document."""

    def __init__(self, edges: np.ndarray, at: np.ndarray, value: np.ndarray, size: int, slices: int):
        self._edges, self._at, self._value = edges, at, value.astype(np.float64)
        self._size, self._slices = size, slices
        self._row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self._square = np.bincount(self._row, self._value ** 2, len(edges) - 1)
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        centres, radii, sliced = [], [], []
        todo = [(np.arange(len(edges) - 1), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.rows)
            if parent >= 0:
                self.children[parent] = (node, self.children[parent][1]) if side == 0 else (self.children[parent][0], node)
            centre, radius, per_slice = self._ball(rows)
            centres.append(centre)
            radii.append(radius)
            sliced.append(per_slice)
            self.rows.append(rows)
            halves = self._halves(rows) if len(rows) > LEAF else None
            self.children.append((-1, -1) if halves else None)
            if halves:
                todo += [(halves[0], node, 0), (halves[1], node, 1)]
        self.centre, self.radius, self.sliced = np.stack(centres), np.array(radii), np.stack(sliced)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the rows, and which of ``rows`` each belongs to."""
        low, count = self._edges[rows], self._edges[rows + 1] - self._edges[rows]
        total = np.concatenate(([0], np.cumsum(count)))
        return np.repeat(low - total[:-1], count) + np.arange(total[-1]), np.repeat(np.arange(len(rows)), count)

    def _ball(self, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        entry, of = self._entries(rows)
        at, value = self._at[entry], self._value[entry]
        centre = np.bincount(at, value, self._size) / len(rows)
        piece = np.arange(self._size) % self._slices
        still = np.bincount(piece, centre ** 2, self._slices)
        # |x - c|^2 in a slice is |c|^2 there, changed where x has entries.
        change = (value - centre[at]) ** 2 - centre[at] ** 2
        square = np.bincount(of * self._slices + at % self._slices, change, len(rows) * self._slices).reshape(len(rows), -1) + still
        error = SLACK * (still + np.bincount(at % self._slices, value ** 2, self._slices))
        whole = square.sum(1).max() + error.sum()
        return centre, math.sqrt(max(whole, 0)), np.sqrt(np.maximum(square.max(0), 0) + error)

    def _distances(self, rows: np.ndarray, entry: np.ndarray, of: np.ndarray, pivot: int) -> np.ndarray:
        point = np.zeros(self._size)
        part = slice(self._edges[pivot], self._edges[pivot + 1])
        point[self._at[part]] = self._value[part]
        product = np.bincount(of, self._value[entry] * point[self._at[entry]], len(rows))
        return self._square[rows] + self._square[pivot] - 2 * product

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows nearer to one of two far apart rows; equal halves if that leaves nearly nothing on one side."""
        entry, of = self._entries(rows)
        a = rows[np.argmax(self._distances(rows, entry, of, rows[0]))]
        to_a = self._distances(rows, entry, of, a)
        b = rows[np.argmax(to_a)]
        lean = to_a - self._distances(rows, entry, of, b)
        near = lean < 0
        if min(near.sum(), (~near).sum()) < max(1, len(rows) // 16):
            near = np.zeros(len(rows), bool)
            near[np.argsort(lean, kind="stable")[:len(rows) // 2]] = True
        return rows[near], rows[~near]

    def bounds(self, items: Items) -> np.ndarray:
        """(nodes, items): no document of the node has a larger inner product with the item."""
        middle = self.centre @ items.matrix
        far = np.minimum(self.radius[:, None] * items.norm, self.sliced @ items.slices)
        return np.ceil((middle + far) * (1 + SLACK) + 1)


def _search(vectors: DataFrame, items: Items, floors: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, key, score): of each task's documents, those that are among its ``top`` best of an item, and not below its floor."""
    kind = vectors.schema["key"].dataType.simpleString()
    size, slices = len(items.weight), len(items.slices)
    shared = vectors.sparkSession.sparkContext.broadcast((items, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = shared.value
        keys: list = []
        # For each item a heap with its best documents so far: score, then the smaller key; null keys are last.
        best: list[list] = [[] for _ in range(items.n)]

        def visit(part: pa.RecordBatch) -> None:
            n, at, tf = part.column(1).to_numpy(), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            edges = np.concatenate(([0], np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            impact = impacts(tf, np.repeat(n, np.diff(edges)), n_docs, n_terms) * items.weight[at]
            names = part.column(0).to_pylist()
            balls = Balls(edges, at, impact, size, slices)
            bounds = balls.bounds(items)
            leaves: dict[int, tuple] = {}
            for i in np.flatnonzero(bounds[0] >= np.maximum(floors, 1)).tolist():
                heap, held = [(-bounds[0, i], 0)], best[i]
                mark = None
                while heap:
                    bound, node = heapq.heappop(heap)
                    least = max(int(floors[i]), held[0][0] if len(held) == top else 1)
                    if -bound < least:
                        break
                    children = balls.children[node]
                    if children is not None:
                        for child in children:
                            if bounds[child, i] >= least:
                                heapq.heappush(heap, (-bounds[child, i], child))
                        continue
                    if mark is None:
                        mark = np.zeros(size, np.int64)
                        mark[items.places[i]] = 1
                    if node not in leaves:
                        rows = balls.rows[node]
                        entry, _ = balls._entries(rows)
                        starts = np.concatenate(([0], np.cumsum(edges[rows + 1] - edges[rows])))[:-1]
                        leaves[node] = rows, at[entry], impact[entry], starts
                    rows, places, values, starts = leaves[node]
                    score = np.add.reduceat(values * mark[places], starts)
                    for j in np.flatnonzero(score >= least).tolist():
                        name = names[rows[j]]
                        entry = (int(score[j]), name is not None, -name if name is not None else 0)
                        if len(held) < top:
                            heapq.heappush(held, entry)
                        elif entry > held[0]:
                            heapq.heapreplace(held, entry)

        waiting, count = [], 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            while count >= BLOCK:
                table = pa.Table.from_batches(waiting).combine_chunks()
                visit(table.slice(0, BLOCK).to_batches()[0])
                waiting, count = table.slice(BLOCK).to_batches(), count - BLOCK
        if count:
            visit(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
        out = [(i, None if not known else -name, score) for i, held in enumerate(best) for score, known, name in held]
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                         ["item", "key", "score"])

    return vectors.mapInArrow(run, f"item int, key {kind}, score bigint")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each item with their rank; first within shares of the tasks, so that none sees all of an item's rows."""
    order = (F.col("score").desc(), F.col("key").asc_nulls_last())
    share = found.withColumn("_share", F.spark_partition_id() % 64)
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_share").orderBy(*order))).filter(F.col("rank") <= top)
    return share.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top).drop("_share")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """For each row of ``items`` (``item_key``, text) its ``top`` best rows of ``docs`` (``key``, text): item_key, rank, key, score.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower case, told apart by 64-bit hashes. Equal scores are ordered by
    ascending key, null keys last; repeated rows of documents are ranked each, repeated items are searched each. Null and
    empty texts have no terms: such items return nothing. Other columns are not read. The items are a stated set of queries that the driver holds;
    ``key`` must be an integer. Scores stay below 2**63 for items of up to 10**8 terms.
    """
    names, terms = item_terms(items, item_key)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    out = None
    for run, known in dictionaries(terms):
        saved = cut_lineage(_vectors(rows, known))
        counts = saved.filter("n is null").select(F.explode(F.arrays_zip("at", "tf")).alias("c")).groupBy("c.at").agg(F.sum("c.tf").alias("n"))
        counts = {r["at"]: r["n"] for r in counts.collect()}
        n_docs, n_terms = counts.get(-1, 0), max(1, counts.get(-2, 0))
        weight = weights(np.array([counts.get(i, 0) for i in range(len(known))], np.int64), n_docs)
        chosen = Items([_find(known, terms[i]) for i in run], weight)
        vectors = saved.filter("n is not null")
        # Any ``top`` documents show what the best must reach, so those of a small share of the rows spare most of the others' balls.
        seed = vectors.filter(F.pmod(F.xxhash64("key", "n", "at"), F.lit(FIRST)) == 0)
        floors = np.zeros(chosen.n, np.int64)
        for r in _best(_search(seed, chosen, floors, n_docs, n_terms, top), top).filter(F.col("rank") == top).collect():
            floors[r["item"]] = r["score"]
        best = _best(_search(vectors, chosen, floors, n_docs, n_terms, top), top)
        labels = spark.createDataFrame([(k, names[i]) for k, i in enumerate(run)], f"item int, {item_key} {kind}")
        part = best.join(labels, "item").select(item_key, F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], f"{item_key} {kind}, rank int, {key} bigint, score bigint")
    return out
