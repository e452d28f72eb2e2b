"""Near-duplicate documents: an inverted join on MinHash signature coordinates, confirmed on whole shingle sets.

1. Every document gets the set of its shingles, a digest of it and a signature of minima. Documents with
   the same set are one node.
2. Nodes are posted under each (coordinate, value) pair. A pair of nodes that may be linked shares at least ``matches``
   values (``thresholds``), so it shares one among the ``coordinates - matches + 1`` rarest of each: only those are merged,
   the long lists are skipped, and nodes that share fewer than ``matches`` values with anybody are out at once.
3. Lists are merged in blocks: collisions of whole signatures are counted, and pairs above the threshold become
   candidates. A block returns a spanning star of each group, never its pairs.
4. Groups of candidates are compared by their whole sets, again in blocks and returned as stars; the connected
   components of the confirmed links are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.llm.graph import components
from featforge.llm.hashset import HashFilter
from featforge.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.85
#: Coordinates are taken in steps of so many, until a pair of the similarity asked for has fewer than ``LEAST_MATCHES`` equal
#: minima, or fewer than the larger number that ``thresholds`` finds, with a probability of at most ``MISS``.
STEP = 32
LEAST_MATCHES = 8
MISS = 6e-7
#: Nodes, and shingles, of a block.
BLOCK = 512
BLOCK_SHINGLES = 250_000


def thresholds(similarity: float) -> tuple[int, int]:
    """(coordinates, matches): a pair of ``similarity`` or more has fewer matches with probability ``MISS`` at most."""
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity {similarity} is not in (0, 1]")
    coordinates = 0
    while True:
        coordinates += STEP
        missed, matches = (1 - similarity) ** coordinates, 0
        while missed <= MISS and matches < coordinates:  # missed: the probability of at most ``matches`` equal minima
            matches += 1
            missed += math.comb(coordinates, matches) * similarity ** matches * (1 - similarity) ** (coordinates - matches)
        if matches >= LEAST_MATCHES:
            return coordinates, matches


def _functions(coordinates: int) -> Iterator[tuple[np.uint64, np.uint64]]:
    """Mask and factor of each coordinate; those of fewer coordinates come first among those of more."""
    for low in range(0, coordinates, STEP):
        random = np.random.default_rng(20240501 + low)
        factors = random.integers(1, 1 << 63, STEP, np.uint64) * np.uint64(2) + np.uint64(1)
        yield from zip(random.integers(0, 1 << 63, STEP, np.uint64), factors)


def shingle_sets(t: X.Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of each text, ascending, and where each text begins.

    A text of fewer than ``n`` words has its whole sequence as its shingle; one without words has none.
    """
    hashes, count = t.word_hashes(), np.diff(t.bounds)
    keys, at = X.ngrams(hashes, t.doc, n)
    keys, docs = [keys], [t.doc[at]]
    for k in range(1, n):
        if np.any(count == k):
            short, at = X.ngrams(hashes, t.doc, k)
            whole = count[t.doc[at]] == k
            keys.append(short[whole])
            docs.append(t.doc[at[whole]])
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(keys)
    order = order[np.argsort(docs[order].astype(np.int16 if t.n < 1 << 15 else np.int64), kind="stable")]
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], np.searchsorted(docs[new], np.arange(t.n + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima of ``coordinates`` hash functions over each set, one row a set; rows of empty sets mean nothing."""
    out = np.zeros((len(bounds) - 1, coordinates), np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k, (mask, factor) in enumerate(_functions(coordinates)):
            out[some, k] = np.minimum.reduceat(((keys ^ mask) * factor) >> np.uint64(32), bounds[some])
    return out


def _digests(keys: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    raw = keys.tobytes()
    return [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _described(docs: DataFrame, n: int, coordinates: int) -> DataFrame:
    """doc_id, row_key, n_shingles, node (digest of the set, null for an empty one), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in X.chunks(batch.column(1), X.SPACED_LOWER):
                keys, bounds = shingle_sets(t, n)
                flat = pa.array(signatures(keys, bounds, coordinates).view(np.int32).ravel())
                edges = pa.array(np.arange(t.n + 1, dtype=np.int32) * coordinates)
                rows = pa.array(np.arange(t.n) + t.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(np.diff(bounds)),
                     pa.array(_digests(keys, bounds), pa.binary()), pa.ListArray.from_arrays(edges, flat)],
                    ["doc_id", "row_key", "n_shingles", "node", "signature"])

    return docs.mapInArrow(run, "doc_id bigint, row_key bigint, n_shingles bigint, node binary, signature array<int>")


def _sets(docs: DataFrame, keep: HashFilter, n: int) -> DataFrame:
    """node, shingles (binary) of the documents whose row key passes ``keep``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = keep.has(batch.column(2).to_numpy().view(np.uint64))
            for t in X.chunks(batch.column(1).filter(pa.array(some)), X.SPACED_LOWER):
                keys, bounds = shingle_sets(t, n)
                raw, nodes = keys.tobytes(), _digests(keys, bounds)
                sets = [raw[8 * a:8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node binary, shingles binary")


def _in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that it takes part in, the pairs of blocks being (x, y), x <= y.

    A group of ``blocks`` blocks is spread over that many squared half tasks, each of two blocks.
    """
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col(blocks)).cast("int")
    out = rows.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    out = out.withColumn("x", F.least("block", "_other")).withColumn("y", F.greatest("block", "_other")).drop("_other", blocks)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, key, "x", "y").sortWithinPartitions(key, "x", "y")


def _stars(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index that each row is connected with in a symmetric boolean matrix."""
    label = np.arange(len(adjacent))
    while True:
        near = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(axis=1, initial=len(label)))
        near = near[near]
        if np.array_equal(near, label):
            return label
        label = near


def _linked(rows: DataFrame, compare: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Links (a, b) inside each run of rows of the same (key, x, y): stars of what ``compare`` finds adjacent.

    A group of N nodes in B blocks gives at most N links inside its blocks and, as blocks of near copies are few components,
    about one for each pair of blocks.
    """
    def links(table: pa.Table) -> tuple[list, list]:
        adjacent, nodes = compare(table), table["node"].to_pylist()
        if table["x"][0].as_py() == table["y"][0].as_py():
            root = np.arange(len(nodes))
            label = _stars(adjacent)
        else:  # components inside one block are linked by x = y; here one link joins two of them, however many pairs do
            block = table["block"].to_numpy()
            inside = block[:, None] == block[None, :]
            own = _stars(adjacent & inside)
            root, index = np.unique(own, return_inverse=True)
            a, b = np.nonzero(adjacent & ~inside)
            joined = np.zeros((len(root), len(root)), bool)
            joined[index[a], index[b]] = True
            label = root[_stars(joined)]
        far = np.flatnonzero(label != root)
        return [nodes[i] for i in root[far].tolist()], [nodes[i] for i in label[far].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def emit(table: pa.Table, final: bool):
            key = [table[c].to_numpy() for c in ("key", "x", "y")]
            change = np.zeros(len(table), bool)
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(table)]
            last = len(edges) - 1 if final else len(edges) - 2
            a, b = [], []
            for low, high in zip(edges[:last], edges[1:last + 1]):
                if high - low > 1:
                    left, right = links(table.slice(low, high - low))
                    a += left
                    b += right
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            return out, table.slice(edges[last]) if not final else None

        # The last run of a batch may go on in the next; a run is two blocks at most.
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            first, end = rest[0], batch
            if all(first.column(c)[0].as_py() == end.column(c)[end.num_rows - 1].as_py() for c in ("key", "x", "y")):
                continue
            out, left = emit(pa.Table.from_batches(rest).combine_chunks(), False)
            rest = left.to_batches()
            yield out
        if rest:
            yield emit(pa.Table.from_batches(rest).combine_chunks(), True)[0]

    return rows.mapInArrow(run, "a binary, b binary")


def _sizes_near(table: pa.Table, percent: int) -> np.ndarray:
    n = table["n_shingles"].to_numpy()
    return 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])


def candidate_links(nodes: DataFrame, similarity: float, coordinates: int, matches: int) -> DataFrame:
    """Spanning links (a, b) of the pairs of nodes with at least ``matches`` equal coordinates."""
    posted = nodes.select("node", F.posexplode("signature").alias("at", "value")).select(
        "node", (F.col("at").cast("bigint") * (1 << 32) + F.col("value")).alias("key"))
    often = posted.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = posted.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("lists"))
    # The coordinates that nobody shares come first in order of rarity, then the shortest lists.
    shared = shared.filter(F.size("lists") >= matches).select(
        "node", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (matches - 1))).alias("list"))
    rows = shared.join(nodes, "node").select(
        "list.key", "node", "n_shingles", "signature", F.ceil(F.col("list.often") / BLOCK).alias("blocks"))
    percent = round(100 * similarity)

    def compare(table: pa.Table) -> np.ndarray:
        values = table["signature"].combine_chunks().flatten().to_numpy().reshape(-1, coordinates)
        if len(values) == 2:  # most lists
            hit = bool((values[0] == values[1]).sum() >= matches)
            return np.array([[False, hit], [hit, False]]) & _sizes_near(table, percent)
        equal = np.zeros((len(values), len(values)), np.uint8 if coordinates < 256 else np.int32)
        for k in range(coordinates):
            equal += values[:, k, None] == values[None, :, k]
        return (equal >= matches) & _sizes_near(table, percent)

    return _linked(_in_blocks(rows, "key", "blocks"), compare)


def _similar(table: pa.Table, percent: int) -> np.ndarray:
    """Which pairs of rows have 100 * intersection >= percent * union, on whole sets."""
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(1, (1 << 22) // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (low, low + step))
        part = np.zeros((len(sets), step), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id, kept.

    Documents whose distinct ``shingle``-word shingles (words between ASCII white space, A-Z in lower case) have at least
    ``similarity`` of their union in common are linked; ``component_id`` is the smallest doc_id that links reach, and
    ``kept`` says that it is the document's own. Null, empty and wordless texts are linked with nothing. Repeated rows
    are in one class and all kept if their id is the smallest; a null doc_id is linked like others, gives its class no
    id, and is kept only if no other id is in the class. ``row_key`` is a hash of doc_id and text. Other columns are not
    read. A link of the similarity asked for is missed with probability ``MISS`` at most. The texts are scanned twice, the second time only for documents with a candidate.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    coordinates, matches = thresholds(similarity)
    described = cut_lineage(_described(rows, shingle, coordinates))
    nodes = described.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.max("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"))
    nodes = cut_lineage(nodes)
    groups = components(candidate_links(nodes, similarity, coordinates, matches))
    known = nodes.select("node", "row_key", "n_shingles").join(groups, "node")
    known = cut_lineage(known)
    weight = known.groupBy("label").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES),
                                                   F.ceil(F.count(F.lit(1)) / BLOCK)).alias("blocks"))
    sets = _sets(rows, HashFilter.build(known, "row_key"), shingle)
    members = sets.join(known.join(weight, "label").select("node", F.xxhash64("label").alias("key"), "blocks", "n_shingles"), "node")
    percent = round(100 * similarity)

    def compare(table: pa.Table) -> np.ndarray:
        return _similar(table, percent) & _sizes_near(table, percent)

    labels = components(_linked(_in_blocks(members, "key", "blocks"), compare))
    classes = nodes.select("node", "first_id").join(labels, "node")
    smallest = classes.groupBy("label").agg(F.min("first_id").alias("component"))
    linked = classes.join(smallest, "label").select("node", "component")
    single = nodes.join(linked, "node", "left").select("node", F.coalesce("component", "first_id").alias("component"))
    out = described.join(single, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
