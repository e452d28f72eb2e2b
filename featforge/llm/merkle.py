"""Merkle manifest of a dataset, with proofs of many rows at once (octopus multiproofs).

Every row is a leaf. The leaves of a group stand in order, runs of ``ARITY`` consecutive nodes become one node, level by
level, and the roots of the groups are the leaves of the top tree. A tree is cut into blocks of ``ARITY ** LEVELS``
consecutive nodes, each a task's work, whose roots make the next, smaller layer; so a hot group is many blocks, and a
billion leaves need three layers.

A proof is asked for by block: the task knows its own leaves, derives every node above them that they determine, and asks
for the smallest set of other nodes that its leaves need. Each coordinate is asked for and fetched once a block, and the
proofs of single leaves are expanded from what is known and what was fetched.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featforge.llm.runs import whole_runs
from featforge.session import cut_lineage

ARITY = 3
#: Levels of a block: 2187 leaves.
LEVELS = 7
SPAN = ARITY ** LEVELS
_TOP = "top"

_NODE = "tree string, level int, at bigint, digest binary"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values one after another: ``-`` for null, else the UTF-8 length, a colon and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])
                  .cast("binary"), 256)


def _parent(digests: Sequence[bytes]) -> bytes:
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def missing(at: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The smallest set of coordinates (level, index) from which, with the leaves ``at`` (ascending), the root follows."""
    out, level = [], 0
    while n > 1:
        parents = np.unique(at // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        children = children[children < n]
        out += [(level, i) for i in np.setdiff1d(children, at, assume_unique=True).tolist()]
        at, n, level = parents, -(-n // ARITY), level + 1
    return out


def _place(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, the index within ``tree`` in the given order, and ``n``, the leaves of the tree.

    Rows are cut into ranges of (tree, order), so a hot tree lies in many tasks; offsets of ranges come from their counts.
    """
    by = ["tree", *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    fixed = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.expr("shiftright(_id, 33)"))
    ranges = fixed.groupBy("tree", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("tree", "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    return fixed.join(ranges, ["tree", "_range"]).withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def _in_blocks(rows: DataFrame, *then: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", *then)


def _layer(nodes: DataFrame, below: int) -> DataFrame:
    """The next nodes, up to ``LEVELS`` levels, over nodes (tree, n, at, digest) of level ``below``; n counts the leaves."""
    rows = _in_blocks(nodes.select("tree", F.expr(f"at div {SPAN}").alias("block"), "n", "at", "digest"), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_runs(batches, ("tree", "block")):
            tree, n, at = table["tree"].to_pylist(), table["n"].to_pylist(), table["at"].to_pylist()
            digest = table["digest"].to_pylist()
            out = [], [], [], []
            for low, high in zip(edges, edges[1:]):
                row, first = digest[low:high], at[low]
                for level in range(below, min(below + LEVELS, height(n[low]))):
                    row, first = [_parent(row[i:i + ARITY]) for i in range(0, len(row), ARITY)], first // ARITY
                    out[0].extend([tree[low]] * len(row))
                    out[1].extend([level + 1] * len(row))
                    out[2].extend(range(first, first + len(row)))
                    out[3].extend(row)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                                              pa.array(out[3], pa.binary())], ["tree", "level", "at", "digest"])

    return rows.mapInArrow(run, _NODE)


@dataclass
class Trees:
    """Trees over placed leaves: ``leaves`` has tree, n, at, digest and what came along, ``nodes`` every node above them."""

    leaves: DataFrame
    nodes: DataFrame

    @staticmethod
    def grow(rows: DataFrame, order: Sequence[str]) -> Trees:
        leaves = cut_lineage(_place(rows, order))
        sizes = leaves.filter("at = 0").select("tree", "n")
        tallest = height(sizes.agg(F.max("n")).first()[0] or 0)
        layers, last = [], leaves
        for below in range(0, tallest, LEVELS):
            layers.append(cut_lineage(_layer(last, below)))
            last = layers[-1].filter(F.col("level") == below + LEVELS).join(sizes, "tree")
        nodes = layers[0] if layers else leaves.sparkSession.createDataFrame([], _NODE)
        for more in layers[1:]:
            nodes = nodes.union(more)
        return Trees(leaves, nodes)

    def all_nodes(self) -> DataFrame:
        return self.nodes.union(self.leaves.select("tree", F.lit(0).alias("level"), "at", "digest"))

    def roots(self) -> DataFrame:
        """(tree, digest): the root of each tree, a lone leaf being its own."""
        return self.all_nodes().filter("at = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))

    def fetched(self, wanted: DataFrame) -> DataFrame:
        """(tree, block, level, at, digest): the nodes that the blocks of the leaves ``wanted`` (tree, n, at) lack, each once."""
        rows = _in_blocks(wanted.select("tree", F.expr(f"at div {SPAN}").alias("block"), "n", "at"), "at")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, edges in whole_runs(batches, ("tree", "block")):
                trees, at, n = table["tree"].to_pylist(), table["at"].to_numpy(), table["n"].to_pylist()
                out = []
                for low, high in zip(edges, edges[1:]):
                    block = int(at[low]) // SPAN
                    out += [(trees[low], block, *c) for c in missing(np.unique(at[low:high]), n[low])]
                columns = list(zip(*out)) or [[], [], [], []]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "block", "level", "at"])

        lacking = rows.mapInArrow(run, "tree string, block bigint, level int, at bigint")
        return lacking.join(self.all_nodes(), ["tree", "level", "at"]).select("tree", "block", "level", "at", "digest")


def _siblings(known: dict[tuple[int, int], bytes], n: int, level: int, at: int) -> tuple[str, str]:
    """Hex digests left and right of a node in its run."""
    first = at - at % ARITY
    run = range(first, min(first + ARITY, width(n, level)))
    return "".join([known[level, i].hex() for i in run if i < at]), "".join([known[level, i].hex() for i in run if i > at])


def _complete(known: dict[tuple[int, int], bytes], at: Sequence[int], n: int) -> None:
    """Add every node that follows from the leaves ``at`` and the fetched ones."""
    nodes = sorted(set(at))
    for level in range(height(n)):
        size, parents = width(n, level), sorted({i // ARITY for i in nodes})
        for p in parents:
            known[level + 1, p] = _parent([known[level, i] for i in range(p * ARITY, min(p * ARITY + ARITY, size))])
        nodes = parents


def fold(leaf: str, proof: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings, by level, give."""
    for left, right in proof:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _expanded(trees: Trees, wanted: DataFrame, above: DataFrame | None, keep: str, proofs: bool) -> DataFrame:
    """For each wanted leaf its key, digest, root of its tree, proof, digest of the proof and what ``candidate`` folds to.

    ``above`` has (tree, proof, top): the way from the root of a tree to the top root.
    """
    spark = wanted.sparkSession
    side = "array<struct<left: string, right: string>>"
    null = lambda kind: F.lit(None).cast(kind)
    leaves = wanted.select("tree", F.expr(f"at div {SPAN}").alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "at", "digest",
                           "candidate", F.col(keep).alias("key"), "n", null(side).alias("above"), null("string").alias("top"))
    rows = leaves.unionByName(trees.fetched(wanted).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    if above is not None:
        blocks = leaves.select("tree", "block").distinct()
        rows = rows.unionByName(blocks.join(above, "tree").select("tree", "block", F.lit(0).alias("kind"), F.col("proof").alias("above"), "top"),
                                allowMissingColumns=True)
    rows = _in_blocks(rows, "kind", "at")
    key = spark.createDataFrame([], wanted.select(F.col(keep).alias("key")).schema).schema["key"].dataType.simpleString()
    schema = f"tree string, key {key}, leaf string, subroot string, root string, proof {side}, proof_sha256 string, folded_root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for table, edges in whole_runs(batches, ("tree", "block")):
            kind, level, at = (table[c].to_pylist() for c in ("kind", "level", "at"))
            digest, candidate, size = (table[c].to_pylist() for c in ("digest", "candidate", "n"))
            names = table["tree"].to_pylist()
            out = [], [], [], [], [], [], []
            picked = []
            for low, high in zip(edges, edges[1:]):
                up, top = [], None
                known = {}
                mine = []
                for i in range(low, high):
                    if kind[i] == 0:
                        up = [(p["left"], p["right"]) for p in table["above"][i].as_py()]
                        top = table["top"][i].as_py()
                    else:
                        known[level[i], at[i]] = digest[i]
                        if kind[i] == 2:
                            mine.append(i)
                n = size[mine[0]]
                tall = height(n)
                _complete(known, [at[i] for i in mine], n)
                subroot = known[tall, 0].hex()
                inside = min(LEVELS, tall)
                block = at[mine[0]] // ARITY ** inside
                shared = [_siblings(known, n, k, block // ARITY ** (k - inside)) for k in range(inside, tall)] + up
                near: dict[tuple[int, int], tuple[str, str]] = {}
                for i in mine:
                    proof, j = [], at[i]
                    for k in range(inside):
                        if (k, j) not in near:
                            near[k, j] = _siblings(known, n, k, j)
                        proof.append(near[k, j])
                        j //= ARITY
                    proof += shared
                    leaf = digest[i].hex()
                    out[0].append(leaf)
                    out[1].append(subroot)
                    out[2].append(top if top is not None else subroot)
                    out[3].append([{"left": a, "right": b} for a, b in proof] if proofs else None)
                    out[4].append(sha256("".join([a + b for a, b in proof]).encode()).hexdigest())
                    out[5].append(fold(leaf if candidate[i] is None else candidate[i].hex(), proof))
                    out[6].append(names[i])
                picked += mine
            kinds = [pa.string()] * 3 + [sides] + [pa.string()] * 3
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(
                [columns[6], table["key"].combine_chunks().take(pa.array(picked, pa.int64())), *columns[:6]],
                ["tree", "key", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root"])

    return rows.mapInArrow(run, schema)


@dataclass
class Manifest:
    """``groups`` has a tree for each group, ``top`` the tree over their roots."""

    groups: Trees
    top: Trees

    def root(self) -> DataFrame:
        """One row with the root, none for an empty dataset."""
        return self.top.roots().select(F.lower(F.hex("digest")).alias("root"))

    def prove(self, which: Column | None = None, proofs: bool = True) -> DataFrame:
        """A row for each leaf (of those that ``which``, a condition on ``key`` and ``tree``, selects): key, tree, leaf, subroot, root,
        proof (digests left and right of the path, level by level, unless ``proofs`` is false), proof_sha256, folded_root,
        verified. ``folded_root`` is what the altered leaf, else the leaf, and the proof give."""
        above = _expanded(self.top, self.top.leaves.withColumn("candidate", F.lit(None).cast("binary")), None, "group", True)
        above = cut_lineage(above.select(F.col("key").alias("tree"), "proof", F.col("root").alias("top")))
        wanted = self.groups.leaves if which is None else self.groups.leaves.filter(which)
        out = _expanded(self.groups, wanted, above, "key", proofs)
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def build_manifest(docs: DataFrame, columns: Sequence[str], group: str, key: str, altered: Mapping[str, Column] | None = None) -> Manifest:
    """Trees over ``columns`` of ``docs``: a leaf for each row, a tree for each ``group``, leaves ascending by ``key``.

    Groups are ordered by their UTF-8 bytes, null first; a null key comes first, and repeated keys are ordered by their leaf
    digests, so equal rows have interchangeable leaves. ``altered`` replaces columns for the leaf that is checked against the proof.
    An empty table has no rows and no root. Other columns are not read.
    """
    values = [F.col(c) for c in columns]
    changed = [(altered or {}).get(c, F.col(c)) for c in columns]
    # An empty name is the null group's, which keeps it first.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf_digest(values).alias("_leaf"), leaf_digest(changed).alias("_other"))
    rows = rows.select("tree", "key", F.unhex("_leaf").alias("digest"),
                       F.when(F.col("_leaf") != F.col("_other"), F.unhex("_other")).alias("candidate"))
    groups = Trees.grow(rows, ["key", "digest"])
    roots = cut_lineage(groups.roots())
    top = Trees.grow(roots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("group"), "digest"), ["group"])
    return Manifest(groups, top)
