"""Minority oversampling by interpolation between near neighbours (SMOTE).

Rows at the same place have the same neighbours, so of each place only the ``k + 1`` smallest ids are searched (``_places``); any further
row there has the ``k`` smallest of them. Neighbours of the others are found exactly or by hashing.

For exact ones, a tree of median cuts along the widest feature deals the rows into cells. It is fitted on a bounded sample, which decides
nothing but the layout. A cell is searched block by block, nearest block first; a row then visits the cells whose box of rows is
within its k-th distance found so far. On many features without structure that can be all cells, a quadratic sweep by nature.

For hashed ones, every table splits the rows again and again into quarters along random directions, until a bucket has about
``LEAF`` rows, and a row meets its own bucket and the next one on its nearer side. The first cuts come from a bounded sample, the last
are made by the task that has the rows. Work is linear in the rows; the recall that a number of tables gives can be measured (``measured_recall``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featforge.functions.numeric import col
from featforge.operators.sampling import class_counts, hash_order, sample_n
from featforge.session import cut_lineage

_PAIRS = "id {key_type}, distance double, neighbour {key_type}"
#: Tables of hashed neighbours, rows of a bucket, and rows of a query set whose recall is measured.
TABLES = 12
LEAF = 512
QUERIES = 256
#: Rows and numbers of the sample that layouts are fitted on, at most, and rows of it in a cell or coarse bucket, at least.
SAMPLE, SAMPLE_VALUES, SAMPLE_LEAST = 1 << 18, 1 << 22, 16
#: A cell of the exact search holds this many blocks, a task of the hashed one this many buckets of a table, about.
BLOCKS, BUCKETS = 16, 64
#: Distances to boxes are rounded in another way than those to rows.
_SLACK = 1 + 1e-9


def _meet(x: np.ndarray, code: np.ndarray, guests: np.ndarray, hosts: np.ndarray, d: np.ndarray, at: np.ndarray,
          bound: np.ndarray | None = None) -> None:
    """Merge the k nearest ``hosts`` of each of ``guests``, rows of ``x``, into ``d`` and ``at``; equal distances go to the smaller row.

    Rows of the same ``code`` don't count, nor those beyond ``bound``.
    """
    k = d.shape[1]
    for start in range(0, len(guests), 256):  # differences, not dot products: equal rows are at distance 0 exactly
        g = guests[start:start + 256]
        e = np.sqrt(sum((x[g, j][:, None] - x[hosts, j][None, :]) ** 2 for j in range(x.shape[1])))
        e[(code[g][:, None] == code[hosts][None, :]) | np.isnan(e)] = np.inf
        limit = d[g, -1] if bound is None else np.minimum(d[g, -1], bound[g])
        if len(hosts) > k:
            limit = np.minimum(limit, np.partition(e, k - 1, axis=1)[:, k - 1])
        row, c = np.nonzero((e <= limit[:, None]) & np.isfinite(e))
        if not len(row):
            continue
        old, o = np.nonzero(np.isfinite(d[g]))
        row, far, who = np.concatenate((old, row)), np.concatenate((d[g][old, o], e[row, c])), np.concatenate((at[g][old, o], hosts[c]))
        order = np.lexsort((who, far, row))
        row, far, who = row[order], far[order], who[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < k
        near, place = np.full((len(g), k), np.inf), np.zeros((len(g), k), np.int64)
        near[row[first], rank[first]], place[row[first], rank[first]] = far[first], who[first]
        d[g], at[g] = near, place


def _best(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of ``right`` for each row of ``left``, itself excluded; ties by neighbour id."""
    if left.empty or right.empty:
        return pd.DataFrame({"id": left["id"][:0], "distance": np.zeros(0), "neighbour": right["id"][:0]})
    right = right.sort_values("id")
    x = np.concatenate((np.stack(right["x"].to_numpy()), np.stack(left["x"].to_numpy())))
    ids = np.concatenate((right["id"].to_numpy(), left["id"].to_numpy()))
    d, at = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)
    _meet(x, np.unique(ids, return_inverse=True)[1], np.arange(len(right), len(x)), np.arange(len(right)), d, at)
    row, rank = np.nonzero(np.isfinite(d))
    return pd.DataFrame({"id": ids[row], "distance": d[row, rank], "neighbour": ids[at[row, rank]]})


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _points(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """id, x of the rows with a key and finite features: others are no one's neighbours and have none."""
    finite = col(key).isNotNull()
    for f in features:
        finite = finite & F.coalesce(F.abs(col(f).cast("double")) < float("inf"), F.lit(False))  # nan is above inf
    return df.filter(finite).select(col(key).alias("id"), F.array(*[col(f).cast("double") for f in features]).alias("x"))


def _places(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows to search and the neighbours of all others.

    The first are id, x, times (how often the row comes): the ``k + 1`` smallest ids of each place. A further row has the ``k`` smallest as its
    nearest, at distance 0: id, distance, neighbour, times (of the pair).
    """
    rows = cut_lineage(points.groupBy("id", "x").agg(F.count(F.lit(1)).alias("times")))
    first = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    hosts = cut_lineage(rows.withColumn("_at", first).filter(F.col("_at") <= k + 1))
    full = hosts.groupBy("x").agg(F.max("id").alias("_last"), F.array_sort(F.collect_list(F.struct("_at", "id", "times"))).alias("_head")).filter(
        F.size("_head") > k)
    rest = rows.join(full, "x").filter(F.col("id") > F.col("_last")).select("id", "times", F.explode(F.slice("_head", 1, k)).alias("_n"))
    rest = rest.select("id", F.lit(0.0).alias("distance"), F.col("_n")["id"].alias("neighbour"), (F.col("times") * F.col("_n")["times"]).alias("times"))
    return hosts.drop("_at"), rest


def _sample(rows: DataFrame, n: int, width: int, seed: int) -> np.ndarray:
    """Some x of ``rows``, drawn by a hash: a bounded number, all if they are few."""
    share = min(1.0, min(SAMPLE, max(SAMPLE_LEAST, SAMPLE_VALUES // width)) / max(1, n))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "x", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return _matrix(drawn.select("x").toArrow()["x"], width)


def _matrix(x: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in x.chunks] or [np.zeros(0)]).reshape(-1, width)


def _by_id(t: pa.Table, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows ordered by id, their x, and a number for each id."""
    t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")]))
    ids = t["id"].to_numpy()
    return t, _matrix(t["x"], width), np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)


def _halves(x: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """``at``, rows of ``x``, halved along the widest feature down to ``size``."""
    out, todo = [], [at]
    while todo:
        some = todo.pop()
        if len(some) <= size:
            out.append(np.sort(some))
            continue
        part = x[some]
        order = np.argsort(part[:, np.argmax(part.max(0) - part.min(0))], kind="stable")
        todo += [some[order[:len(some) // 2]], some[order[len(some) // 2:]]]
    return out


class _Cells:
    """A tree of cuts: ``x[dim] > cut`` goes to the right child, which follows the left one; a leaf is a cell."""

    def __init__(self, sample: np.ndarray, least: int):
        self.dim, self.cut, self.child = [0], [0.0], [-1]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, some = todo.pop()
            if len(some) < 2 * least:
                continue
            part = sample[some]
            dim = int(np.argmax(part.max(0) - part.min(0)))
            values = np.sort(part[:, dim])
            below = values[values < values[-1]]
            if not len(below):
                continue
            cut = min(values[(len(values) - 1) // 2], below[-1])
            right = part[:, dim] > cut
            if min(right.sum(), (~right).sum()) < min(least, SAMPLE_LEAST):
                continue
            self.dim[node], self.cut[node], self.child[node] = dim, cut, len(self.child)
            todo += [(len(self.child), some[~right]), (len(self.child) + 1, some[right])]
            self.dim, self.cut, self.child = self.dim + [0, 0], self.cut + [0.0, 0.0], self.child + [-1, -1]
        self.dim, self.cut, self.child = np.array(self.dim), np.array(self.cut), np.array(self.child)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.child[node] >= 0)):
            at = node[inner]
            node[inner] = self.child[at] + (x[inner, self.dim[at]] > self.cut[at])
        return node


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Distances of a box, or a point, to boxes."""
    return np.sqrt((np.maximum(0, np.maximum(lows - high, low - highs)) ** 2).sum(-1))


def _search(x: np.ndarray, code: np.ndarray, guests: np.ndarray, hosts: np.ndarray, k: int, block: int,
            bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of the k nearest of ``hosts`` for ``guests``: blocks near each other are compared first, far ones not at all."""
    d, at = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)
    blocks = _halves(x, hosts, block)
    lows, highs = np.array([x[b].min(0) for b in blocks]), np.array([x[b].max(0) for b in blocks])
    for some in _halves(x, guests, min(block, 256)) if len(guests) else []:
        apart = _apart(x[some].min(0), x[some].max(0), lows, highs)
        for b in np.argsort(apart, kind="stable"):
            reach = d[some, -1] if bound is None else np.minimum(d[some, -1], bound[some])
            if apart[b] > reach.max() * _SLACK:
                break
            _meet(x, code, some, blocks[b], d, at, bound)
    return d, at


def nearest_neighbours(df: DataFrame, key: str, features: Sequence[str], k: int = 5, block: int = 1024) -> DataFrame:
    """``(id, distance, neighbour, rank)``: the k nearest other rows of each row by Euclidean distance; ties go to the smaller id.

    Rows without a key or with features that aren't finite are left out. If ids repeat, each pair of rows counts.
    """
    spark, width = df.sparkSession, len(features)
    hosts, rest = _places(_points(df, key, features), k)
    kind = hosts.schema["id"].dataType.simpleString()
    n = hosts.count()
    sample = _sample(hosts, n, width, 7) if n > BLOCKS * block else np.zeros((0, width))
    cells = _Cells(sample, max(SAMPLE_LEAST, 2 * k + 2, len(sample) * BLOCKS * block // (2 * max(1, n))))
    shared = spark.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.of(_matrix(pa.chunked_array([batch.column(1)]), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "x", "times", "cell"])

    rows = cut_lineage(hosts.mapInArrow(deal, f"id {kind}, x array<double>, times bigint, cell bigint"))
    # At most SAMPLE / SAMPLE_LEAST cells.
    ends = [f(F.col("x")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(width)]
    edges = rows.groupBy("cell").agg(*ends).toArrow()
    boxes = [np.stack([edges[f"{name}{j}"].to_numpy() for j in range(width)], 1) for name in ("low", "high")]
    near_cells = spark.sparkContext.broadcast((edges["cell"].to_numpy(), *boxes))
    schema = f"id {kind}, distance double, neighbour {kind}, times bigint, target bigint, x array<double>"

    def pairs(t: pa.Table, d: np.ndarray, at: np.ndarray, times: np.ndarray) -> pa.Table:
        row, rank = np.nonzero(np.isfinite(d))
        to = at[row, rank]
        return pa.table({"id": t["id"].take(pa.array(row)), "distance": d[row, rank], "neighbour": t["id"].take(pa.array(to)),
                         "times": times[row] * times[to], "target": pa.nulls(len(row), pa.int64()), "x": pa.nulls(len(row), pa.list_(pa.float64()))})

    def at_home(t: pa.Table) -> pa.Table:
        """Neighbours within a cell, and for each other cell in reach a row with the distance, the target and x."""
        home = t["cell"][0].as_py()
        t, x, code = _by_id(t, width)
        times, every = t["times"].to_numpy(), np.arange(len(x))
        d, at = _search(x, code, every, every, k, block)
        names, lows, highs = near_cells.value
        reach, row, to = d[:, -1] * _SLACK, [], []
        for some in _halves(x, every, 256):
            there = np.flatnonzero((_apart(x[some].min(0), x[some].max(0), lows, highs) <= reach[some].max()) & (names != home))
            for part in np.array_split(there, -(-len(there) // 512) or 1):
                r, c = np.nonzero(_apart(x[some][:, None], x[some][:, None], lows[part][None], highs[part][None]) <= reach[some][:, None])
                row.append(some[r])
                to.append(names[part][c])
        row, to = np.concatenate(row), np.concatenate(to)
        visits = pa.table({"id": t["id"].take(pa.array(row)), "distance": d[row, -1], "neighbour": pa.nulls(len(row), t["id"].type), "times": times[row],
                           "target": to, "x": t["x"].take(pa.array(row))})
        return pa.concat_tables([c.cast(visits.schema) for c in (pairs(t, d, at, times), visits)])

    found = cut_lineage(rows.groupBy("cell").applyInArrow(at_home, schema))
    inside, visits = found.filter("target is null"), found.filter("target is not null")
    # A cell that many rows visit is searched in several tasks, each with about one cell's worth of visitors.
    parts = visits.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / (BLOCKS * block)).alias("parts"))
    visitors = visits.join(parts, "target").select("target", F.pmod(F.xxhash64("id", "x"), F.col("parts")).alias("part"), F.lit(True).alias("guest"), "id", "x",
                                                   "times", "distance")
    met = rows.join(parts, rows["cell"] == parts["target"]).select(
        "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("guest"), "id", "x", "times",
        F.lit(0.0).alias("distance"))

    def abroad(t: pa.Table) -> pa.Table:
        t, x, code = _by_id(t, width)
        guest = t["guest"].to_numpy()
        d, at = _search(x, code, np.flatnonzero(guest), np.flatnonzero(~guest), k, block, t["distance"].to_numpy())
        return pairs(t, d, at, t["times"].to_numpy())

    outside = visitors.unionByName(met).groupBy("target", "part").applyInArrow(abroad, schema)
    near = _nearest(inside.unionByName(outside).drop("target", "x").unionByName(rest), k)
    before = F.sum("times").over(Window.partitionBy("id").orderBy("distance", "neighbour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")
    near = near.withColumn("_before", before).filter(F.col("_before") < k)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("times", k - F.col("_before"))))
    return near.withColumn("_copy", copy).select("id", "distance", "neighbour", (F.col("_before") + F.col("_copy")).cast("int").alias("rank"))


def _quarters(p: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """The quartiles of ``p`` in each of the nodes."""
    order = np.lexsort((p, node))
    count = np.bincount(node, minlength=nodes)
    at = (np.cumsum(count) - count)[:, None] + np.array([1, 2, 3])[None] * count[:, None] // 4 - 1
    return p[order][np.clip(at, 0, max(0, len(p) - 1))] if len(p) else np.zeros((nodes, 3))


def _way(seed: int, table: int, level: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, table, level]).normal(size=width)


def _refined(x: np.ndarray, table: int, first: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each row, and the neighbouring one on the side where it is nearer to the edge, -1 without one; cuts from level ``first``."""
    node, near, level = np.zeros(len(x), np.int64), np.full(len(x), -1), 0
    while len(x) > leaf * 4 ** level:
        p = x @ _way(seed, table, first + level, x.shape[1])
        cuts = _quarters(p, node, 4 ** level)[node]
        child = (cuts < p[:, None]).sum(1)
        low, high = np.take_along_axis(cuts, np.maximum(child - 1, 0)[:, None], 1)[:, 0], np.take_along_axis(cuts, np.minimum(child, 2)[:, None], 1)[:, 0]
        down = (child == 3) | ((child > 0) & (p - low < high - p))
        node, near, level = node * 4 + child, node * 4 + np.where(down, child - 1, child + 1), level + 1
    return node, near


def _deal(t: pa.Table, width: int, first: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, part, neighbouring bucket and its part of each row: what no direction tells apart is dealt at random, another way in each table."""
    x, table = _matrix(t["x"], width), t["t"][0].as_py()
    node, near = _refined(x, table, first, leaf, seed)
    parts = -(-np.bincount(node, minlength=max(int(node.max()), int(near.max())) + 1) // (2 * leaf))
    draw = np.random.default_rng([seed, table, len(x)])
    part, there = draw.integers(0, 1 << 30, len(x)) % parts[node], draw.integers(0, 1 << 30, len(x)) % np.maximum(parts[near], 1)
    return node, part, np.where((near >= 0) & (parts[near] > 0), near, -1), there


def _coarse(points: DataFrame, width: int, tables: int, leaf: int, seed: int) -> tuple[DataFrame, int]:
    """id, x, t, coarse, share: each row in each table with its coarse bucket, dealt in shares where that has many rows; and the cuts made."""
    n = points.count()
    sample = _sample(points, n, width, seed) if n > BUCKETS * leaf else np.zeros((0, width))
    levels = 0
    while n > BUCKETS * leaf * 4 ** levels and len(sample) >= SAMPLE_LEAST * 4 ** (levels + 1):
        levels += 1
    cuts = []
    for table in range(tables):
        node, own = np.zeros(len(sample), np.int64), []
        for level in range(levels):
            p = sample @ _way(seed, table, level, width)
            own.append(_quarters(p, node, 4 ** level))
            node = node * 4 + (own[-1][node] < p[:, None]).sum(1)
        cuts.append(own)
    shared = points.sparkSession.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(1)]), width)
            for table, own in enumerate(shared.value):
                node = np.zeros(len(x), np.int64)
                for level, c in enumerate(own):
                    node = node * 4 + (c[node] < (x @ _way(seed, table, level, width))[:, None]).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(x), table, np.int32)), pa.array(node)],
                                                 ["id", "x", "t", "coarse"])

    kind = points.schema["id"].dataType.simpleString()
    rows = points.select("id", "x").mapInArrow(deal, f"id {kind}, x array<double>, t int, coarse bigint")
    most = 8 * max(BUCKETS * leaf, n // 4 ** levels)
    sizes = rows.groupBy("t", "coarse").agg(F.ceil(F.count(F.lit(1)) / most).alias("shares")).filter("shares > 1")
    rows = rows.join(F.broadcast(sizes), ["t", "coarse"], "left")  # at most SAMPLE / SAMPLE_LEAST a table
    share = F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.coalesce("shares", F.lit(1)))
    return rows.withColumn("share", share).drop("shares"), levels


def _buckets(points: DataFrame, width: int, tables: int, leaf: int, seed: int) -> DataFrame:
    """id, x, t, node, part, near, near_part: the bucket of each row in each table, and the part of a bucket that can't be split by place.

    ``near`` is the neighbouring bucket on the side where the row is nearer to the edge, null without one.
    """
    rows, levels = _coarse(points, width, tables, leaf, seed)

    def fine(t: pa.Table) -> pa.Table:
        node, part, near, there = _deal(t, width, levels, leaf, seed)
        name = np.int64(t["coarse"][0].as_py()) << np.int64(32) | np.int64(t["share"][0].as_py()) << np.int64(20)
        out = t.select(["id", "x", "t"]).append_column("node", pa.array(name + node)).append_column("part", pa.array(part))
        return out.append_column("near", pa.array(name + near, mask=near < 0)).append_column("near_part", pa.array(there))

    kind = points.schema["id"].dataType.simpleString()
    return rows.groupBy("t", "coarse", "share").applyInArrow(fine, f"id {kind}, x array<double>, t int, node bigint, part bigint, near bigint, near_part bigint")


def hashed_neighbours(df: DataFrame, key: str, features: Sequence[str], k: int = 5, tables: int = TABLES, leaf: int = LEAF,
                      seed: int = 42) -> DataFrame:
    """``(id, distance, neighbour, rank)`` as ``nearest_neighbours`` gives, with the nearest rows that share a bucket in some table.

    Exact for up to ``leaf`` rows. Each row is compared with at most ``4 * leaf`` others a table, about. Ties go to the smaller id;
    repeated pairs of ids count once.
    """
    width = len(features)
    hosts, rest = _places(_points(df, key, features), k)
    rows, levels = _coarse(hosts, width, tables, leaf, seed)

    def meet(t: pa.Table) -> pa.Table:
        t, x, code = _by_id(t, width)
        node, part, near, there = _deal(t, width, levels, leaf, seed)
        d, at = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)
        most = int(part.max()) + 1
        most = max(most, int(there.max()) + 1)
        own, guest = node * most + part, np.where(near >= 0, near * most + there, -1)
        order, visits = np.argsort(own, kind="stable"), np.argsort(guest, kind="stable")
        names, begin = np.unique(own[order], return_index=True)
        for name, some in zip(names, np.split(order, begin[1:])):
            low, high = np.searchsorted(guest[visits], [name, name + 1])
            _meet(x, code, np.concatenate((some, visits[low:high])), some, d, at)
        row, rank = np.nonzero(np.isfinite(d))
        return pa.table({"id": t["id"].take(pa.array(row)), "distance": d[row, rank], "neighbour": t["id"].take(pa.array(at[row, rank]))})

    schema = _PAIRS.format(key_type=hosts.schema["id"].dataType.simpleString())
    met = rows.groupBy("t", "coarse", "share").applyInArrow(meet, schema).unionByName(rest.drop("times"))
    return _nearest(met.groupBy("id", "neighbour").agg(F.min("distance").alias("distance")), k).select("id", "distance", "neighbour", "rank")


def measured_recall(df: DataFrame, key: str, features: Sequence[str], found: DataFrame, k: int = 5, queries: int = QUERIES,
                    seed: int = 42) -> float:
    """Share of the true k nearest of a stated query set that ``found`` has, or has another row as near in place of.

    At most ``queries`` rows, chosen by a hash, are compared with all rows, batch by batch; 1.0 without any.
    """
    points = _points(df, key, features)
    schema = _PAIRS.format(key_type=points.schema["id"].dataType.simpleString())
    chosen = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(queries).toPandas()
    if chosen.empty:
        return 1.0
    shared = df.sparkSession.sparkContext.broadcast(chosen)
    near = points.mapInPandas(lambda batches: (_best(shared.value, b, k) for b in batches), schema)
    least = _nearest(near, k).groupBy("id").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("n"))
    hit = found.join(least, "id", "right").groupBy("id").agg(F.count(F.when(F.col("distance") <= F.col("reach") * (1 + 1e-12), 1)).alias("hits"),
                                                              F.first("n").alias("n"))
    total = hit.agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return float(total["hits"] or 0) / float(total["n"] or 1)


def smote(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, seed: int = 42,
          block: int = 1024, method: str = "hashed") -> DataFrame:
    """``(key, features, label)`` with synthetic minority rows (null key) until both classes have equal size.

    Every minority row gets the same number of synthetic rows, up to one. Each lies between the row and one of its
    k neighbours, by ``method`` hashed (linear work) or exact; which one and how far is a hash of key, copy and seed. Minority rows with a missing or infinite
    feature, and a minority of one row, have no neighbours and raise: impute first.
    """
    if method not in ("hashed", "exact"):
        raise ValueError(f"method {method!r} is neither hashed nor exact")
    counted = class_counts(df, label)
    sizes = {c: n for c, n in (counted or {}).items() if c is not None}
    if len(sizes) != 2:
        raise ValueError(f"{label!r} must have two classes, found {'too many' if counted is None else sorted(sizes)}")
    minority = min(sizes, key=lambda c: (sizes[c], c))
    missing = max(sizes.values()) - sizes[minority]
    real = df.select(col(key), *[col(f).cast("double").alias(f) for f in features], col(label))
    if missing == 0:
        return real
    rare = cut_lineage(real.where(col(label) == F.lit(minority)))
    finite = F.lit(True)
    for f in features:
        finite = finite & col(f).isNotNull() & ~F.isnan(col(f)) & (F.abs(col(f)) != float("inf"))
    if bad := rare.filter(~F.coalesce(finite, F.lit(False))).count():
        raise ValueError(f"{bad} rows of class {minority!r} have features without a finite value; impute them first")
    if sizes[minority] < 2:
        raise ValueError(f"class {minority!r} has a single row, so no neighbours to draw from")
    near = nearest_neighbours(rare, key, features, k, block) if method == "exact" else hashed_neighbours(rare, key, features, k, seed=seed)
    near = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))  # k at most
    each, extra = divmod(missing, sizes[minority])
    more = sample_n(rare, extra, key, seed).select(col(key).alias("id"), F.lit(1).alias("_more")) if extra else None
    copies = near.withColumn("_copies", F.lit(each))
    if more is not None:
        copies = near.join(more, "id", "left").withColumn("_copies", F.lit(each) + F.coalesce("_more", F.lit(0)))
    drawn = copies.where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    pick = F.pmod(hash_order(["id", "copy"], seed), F.size("near").cast("long")).cast("int")
    gap = F.pmod(hash_order(["id", "copy"], seed + 1), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    drawn = drawn.select("id", gap.alias("gap"), F.element_at("near", pick + 1)["neighbour"].alias("other"))
    a = rare.select(col(key).alias("id"), *[col(f).alias(f"a{i}") for i, f in enumerate(features)])
    b = rare.select(col(key).alias("other"), *[col(f).alias(f"b{i}") for i, f in enumerate(features)])
    made = drawn.join(a, "id").join(b, "other").select(
        F.lit(None).cast(df.schema[key].dataType).alias(key),
        *[(F.col(f"a{i}") + F.col("gap") * (F.col(f"b{i}") - F.col(f"a{i}"))).alias(f) for i, f in enumerate(features)],
        F.lit(minority).cast(df.schema[label].dataType).alias(label))
    return real.unionByName(made)
