"""Deep feature synthesis: automatic features of a root table from its children, grandchildren and so on.

Child tables are rolled up bottom-up, one aggregate per edge, and left-joined to their parent. Keys, foreign keys
and excluded columns (the target) never become inputs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler

from featforge.functions.aggregates import FUNCTIONS, NUMERIC, aggregate_sql
from featforge.functions.numeric import col, literal, quote, ratio
from featforge.operators.joins import attach
from featforge.operators.ordered import add_row_index, cumulative, percentile_ranks
from featforge.operators.rollup import group_mode, group_nunique, grouped, normalized_mode_count
from featforge.operators.rows import coerce_numeric, split_columns
from featforge.operators.states import StatePrimitive, aggregate_states
from featforge.session import cut_lineage

AGGREGATES = ("sum", "mean", "count", "max", "min", "std")
TRANSFORMS = ("DIFF", "CUM_SUM", "CUM_MEAN", "PERCENTILE")
#: Values that the sketch of a column keeps when interesting ones are looked for.
TRACKED = 1_000
#: Aggregates of text and true/false columns, counted by (key, value) first.
DISCRETE = {"mode": group_mode, "nunique": group_nunique, "normalized_mode_count": normalized_mode_count}


@dataclass(frozen=True)
class Entity:
    df: DataFrame
    key: str
    order_by: str | None = None
    time: str | None = None
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    parent: str
    parent_key: str
    child: str
    child_key: str


@dataclass(frozen=True)
class Feature:
    """A feature definition; ``base`` is the stacked input, ``where`` the (column, value) it is restricted to."""

    name: str
    fn: str
    entity: str
    column: str | None = None
    base: str | None = None
    where: tuple[str, object] | None = None
    depth: int = 1


@dataclass
class EntitySet:
    root: str
    entities: dict[str, Entity] = field(default_factory=dict)
    edges: list[Relationship] = field(default_factory=list)

    def add(self, name: str, df: DataFrame, key: str | None = None, order_by: Sequence[str] | None = None,
            time: str | None = None, exclude: Sequence[str] = ()) -> EntitySet:
        """Register a table. Without a key it gets a row number over ``order_by`` (all columns by default)."""
        if key is None:
            key = f"{name}_index"
            df = add_row_index(df, order_by or df.columns, key)
        self.entities[name] = Entity(df, key, None, time, tuple(exclude))
        return self

    def relate(self, parent: str, parent_key: str, child: str, child_key: str) -> EntitySet:
        """Add an edge; a child whose parent is not in the set is left out, as is an edge without its child."""
        if parent in self.entities and child in self.entities:
            self.edges.append(Relationship(parent, parent_key, child, child_key))
        return self

    def children(self, name: str) -> list[Relationship]:
        return [e for e in self.edges if e.parent == name]

    def skipped_columns(self, name: str) -> set[str]:
        """Keys and foreign keys, by the names that any edge or entity uses, and the entity's exclusions."""
        out = {e.key for e in self.entities.values()} | set(self.entities[name].exclude)
        for e in self.edges:
            out |= {e.parent_key, e.child_key}
        return out

    def check(self) -> DataFrame:
        """Children rows and rows without a parent, per edge."""
        if self.root not in self.entities:
            raise ValueError(f"root {self.root!r} is not in the entity set")
        parts = []
        for e in self.edges:
            parent = self.entities[e.parent].df.select(col(e.parent_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
            child = self.entities[e.child].df.groupBy(col(e.child_key).alias("_k")).count()
            parts.append(child.join(parent, "_k", "left").agg(
                F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("count"))), F.lit(0)).cast("long").alias("orphans"))
                .select(F.lit(e.parent).alias("parent"), F.lit(e.child).alias("child"), "n_rows", "orphans"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out




def _discrete(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def _edge_features(es: EntitySet, edge: Relationship, agg: Sequence[str], depth: int, max_depth: int,
                   where: Mapping[str, Mapping[str, Sequence]] | None, custom: Mapping) -> list[Feature]:
    """Definitions for one edge: own columns first, then the features stacked on the child."""
    child = es.entities[edge.child]
    skip = es.skipped_columns(edge.child)
    out = []
    numeric = [f.name for f in child.df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip]
    stacked: list[Feature] = []
    if depth < max_depth:
        for sub in es.children(edge.child):
            stacked += _edge_features(es, sub, agg, depth + 1, max_depth, where, custom)
    if "count" in agg:
        out.append(Feature(f"COUNT({edge.child})", "size", edge.child, depth=1))
    for fn in agg:
        if fn == "count":
            continue
        if fn in DISCRETE and fn not in custom:
            out += [Feature(f"{fn.upper()}({edge.child}.{c})", fn, edge.child, c) for c in _discrete(child.df) if c not in skip]
        types = getattr(custom.get(fn), "in_types", None)
        if types:  # a registered primitive names the types that it takes, and is not stacked
            out += [Feature(f"{fn.upper()}({edge.child}.{f.name})", fn, edge.child, f.name) for f in child.df.schema.fields
                    if isinstance(f.dataType, types) and f.name not in skip]
        elif fn in FUNCTIONS or fn in custom:
            out += [Feature(f"{fn.upper()}({edge.child}.{c})", fn, edge.child, c) for c in numeric]
            out += [Feature(f"{fn.upper()}({edge.child}.{s.name})", fn, edge.child, None, s.name, depth=s.depth + 1)
                    for s in stacked]
        elif fn == "trend" and child.time:
            out += [Feature(f"TREND({edge.child}.{c}, {child.time})", fn, edge.child, c) for c in numeric]
        elif fn == "percent_true":
            flags = [f.name for f in child.df.schema.fields if isinstance(f.dataType, T.BooleanType)]
            out += [Feature(f"PERCENT_TRUE({edge.child}.{c})", fn, edge.child, c) for c in flags if c not in skip]
    for c, values in ((where or {}).get(edge.child) or {}).items():
        for v in values:
            tag = f"WHERE {c} = {v}"
            if "count" in agg:
                out.append(Feature(f"COUNT({edge.child} {tag})", "size", edge.child, None, None, (c, v)))
            for fn in agg:
                if fn in ("mean", "sum"):
                    out += [Feature(f"{fn.upper()}({edge.child}.{n} {tag})", fn, edge.child, n, None, (c, v))
                            for n in numeric if n != c]
    return out


def define(es: EntitySet, agg: Sequence[str] = AGGREGATES, max_depth: int = 2,
           where: Mapping[str, Mapping[str, Sequence]] | None = None, custom: Mapping | None = None) -> list[Feature]:
    """All feature definitions of the root, without computing any.

    ``custom`` maps names to functions of a Column, or holds a registry's ``primitives()``. Unknown names raise.
    """
    known = {"count", "trend", "percent_true", *FUNCTIONS, *DISCRETE, *(custom or {})}
    if unknown := [fn for fn in agg if fn not in known]:
        raise ValueError(f"unknown primitives {unknown}; known are {sorted(known)}")
    out = []
    for edge in es.children(es.root):
        out += _edge_features(es, edge, agg, 1, max_depth, where, custom or {})
    return out


def interesting_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, min_share: float = 0.01,
                       tracked: int = TRACKED) -> DataFrame:
    """``(column, value, rows, rank)``: the k most common non-null values of each text column that ``min_share`` of the rows hold.

    One pass keeps a mergeable sketch of heavy hitters a column, of at most ``tracked`` values: every value of more than
    ``rows / (0.75 * tracked)`` rows is in it, which must be no more than the share asked for. A second pass counts the k * 4 largest exactly,
    so that errors of the sketch don't decide; ties go to the smaller value.
    """
    if min_share < 1 / (0.75 * tracked):
        raise ValueError(f"a share of {min_share} needs more than {tracked} tracked values")
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if columns is None else list(columns)
    empty = "column string, value string, rows bigint, rank int"
    if not names:
        return df.sparkSession.createDataFrame([], empty)
    sketches = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.expr(f"approx_top_k(cast({quote(c)} as string), {min(4 * k, tracked)}, {tracked})").alias(f"_{i}") for i, c in enumerate(names)]).first()
    found = {c: sorted({r["item"] for r in sketches[f"_{i}"] or [] if r["item"] is not None}) for i, c in enumerate(names)}
    pairs = [(c, v) for c, values in found.items() for v in values]
    if not pairs:
        return df.sparkSession.createDataFrame([], empty)
    counts = [F.expr(f"count_if(cast({quote(c)} as string) = {literal(v)})") for c, v in pairs]
    exact = df.agg(F.array(*counts).alias("n")).first()["n"]  # at most 4 * k for each column
    rows, least = [], min_share * sketches["_rows"]
    for c in names:
        own = sorted((-n, v) for (col_, v), n in zip(pairs, exact) if col_ == c and n >= least)
        rows += [(c, v, -n, i + 1) for i, (n, v) in enumerate(own[:k])]
    return df.sparkSession.createDataFrame(rows, empty)


def where_values(es: EntitySet, k: int = 5, min_share: float = 0.01) -> dict[str, dict[str, list[str]]]:
    """What ``dfs`` takes as ``where``, found by ``interesting_values`` in the text columns of every child table."""
    out: dict[str, dict[str, list[str]]] = {}
    for name, entity in es.entities.items():
        text = [f.name for f in entity.df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in es.skipped_columns(name)]
        if name == es.root or not text:
            continue
        for r in interesting_values(entity.df, text, k, min_share).orderBy("column", "rank").collect():
            out.setdefault(name, {}).setdefault(r["column"], []).append(r["value"])
    return out


def definitions_table(es: EntitySet, defs: Sequence[Feature]) -> DataFrame:
    spark = es.entities[es.root].df.sparkSession
    rows = [(f.name, f.fn, f.entity, f.column, f.base, f"{f.where[0]} = {f.where[1]}" if f.where else None, f.depth)
            for f in defs]
    return spark.createDataFrame(
        rows, "name string, fn string, entity string, input string, base string, condition string, depth int")


def _text(f: Feature, es: EntitySet) -> str:
    if f.fn == "trend":
        v, t = f"cast({quote(f.column)} as double)", f"cast({quote(es.entities[f.entity].time)} as double) / 86400"
        x, y = f"case when {v} is not null then {t} end", f"case when {t} is not null then {v} end"
        return f"case when min({x}) < max({x}) then try_divide(covar_pop({y}, {x}), var_pop({x})) end"
    if f.fn == "percent_true":
        return f"avg(cast(coalesce({quote(f.column)}, false) as double))"
    where = None if f.where is None else f"{quote(f.where[0])} = {literal(f.where[1])}"
    return aggregate_sql(f.fn, f.base or f.column, where)


def _rolled_up(es: EntitySet, edge: Relationship, agg, depth, max_depth, where, custom) -> DataFrame:
    """One row per parent key with this edge's features."""
    child = es.entities[edge.child]
    df = child.df
    if depth < max_depth:
        for sub in es.children(edge.child):
            part = _rolled_up(es, sub, agg, depth + 1, max_depth, where, custom)
            df = _left_on(df, sub.parent_key, part, sub.child_key, sub.child)
    features = _edge_features(es, edge, agg, depth, max_depth, where, custom)
    text = set(_discrete(child.df))
    counted = [f for f in features if f.fn in DISCRETE and f.fn not in custom and f.column in text]
    plain = grouped(df, edge.child_key, {f.name: _text(f, es) for f in features if f.fn not in custom and f not in counted})
    states = {f.name: (f.base or f.column, custom[f.fn]) for f in features if isinstance(custom.get(f.fn), StatePrimitive)}
    if states:
        plain = attach(plain, aggregate_states(df, edge.child_key, states), edge.child_key)
    own = [custom[f.fn](col(f.base or f.column)).alias(f.name) for f in features if f.fn in custom and f.name not in states]
    if own:
        plain = attach(plain, df.groupBy(col(edge.child_key)).agg(*own), edge.child_key)
    for f in counted:
        plain = attach(plain, DISCRETE[f.fn](df, edge.child_key, f.column, f.name), edge.child_key)
    return plain


def _left_on(df: DataFrame, parent_key: str, part: DataFrame, child_key: str, child: str) -> DataFrame:
    """Left join of rolled-up children; a parent without children has counted 0 rows, not null."""
    joined = df.join(part.withColumnRenamed(child_key, "_fk"), col(parent_key) == F.col("_fk"), "left")
    fresh = [c for c in part.columns if c != child_key]
    return joined.selectExpr(*[quote(c) for c in df.columns], *[
        f"coalesce({quote(c)}, 0) as {quote(c)}" if c.startswith(f"COUNT({child}") else quote(c) for c in fresh])


def dfs(es: EntitySet, agg: Sequence[str] = AGGREGATES, trans: Sequence[str] = (), max_depth: int = 2,
        where: Mapping[str, Mapping[str, Sequence]] | None = None, custom: Mapping | None = None,
        order_by: Sequence[str] | None = None, features_only: bool = False, exclude: Sequence[str] = ()):
    """Feature matrix of the root (or only its definitions). ``exclude`` keeps e.g. the target out of ``trans``."""
    defs = define(es, agg, max_depth, where, custom)
    if features_only:
        return defs
    root = es.entities[es.root]
    out = root.df
    for edge in es.children(es.root):
        part = _rolled_up(es, edge, agg, 1, max_depth, where, custom or {})
        out = _left_on(out, edge.parent_key, part, edge.child_key, edge.child)
    if trans:
        skip = es.skipped_columns(es.root) | set(exclude)
        out = add_transforms(out, [c for c in split_columns(out)[0] if c not in skip], order_by or [root.key], trans)
    return out


def add_transforms(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                   trans: Sequence[str] = TRANSFORMS) -> DataFrame:
    """Whole-table transform features of the given columns: one scan for the running ones and one for all ranks."""
    running = [t for t in trans if t != "PERCENTILE"]
    if running:
        df = cumulative(df, columns, order_by, (), running)
    if "PERCENTILE" in trans:
        df = percentile_ranks(df, columns)
    return df


def combine_features(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two feature tables by key; a name in both comes from the first; counts are whole numbers, 0 when absent."""
    fresh = b.select(col(key), *[col(c) for c in b.columns if c not in set(a.columns)])
    out = attach(a, fresh, key)
    return coerce_numeric(out, [c for c in out.columns if c.startswith("COUNT(")], fill=0, dtype="long")


def expand_nonlinear(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse, logarithm, root, square, absolute value of each column, and products of pairs of columns."""
    out = []
    for c in columns:
        v = col(c).cast("double")
        out += [ratio(F.lit(1.0), v).alias(f"1/{c}"), F.when(v > 0, F.ln(v)).alias(f"log({c})"),
                F.when(v >= 0, F.sqrt(v)).alias(f"sqrt({c})"), (v * v).alias(f"{c}**2"), F.abs(v).alias(f"abs({c})")]
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            out.append((col(a).cast("double") * col(b).cast("double")).alias(f"{a}*{b}"))
    return df.select(*[col(c) for c in df.columns], *out)


def l1_select(df: DataFrame, features: Sequence[str], label: str, strength: float = 0.01,
              max_iter: int = 50) -> list[str]:
    """Features with a non-zero weight in an L1-penalised logistic regression on standardised inputs."""
    filled = df.select(col(label).cast("double").alias("label"),
                       *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    raw = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="raw").transform(filled)
    raw = cut_lineage(raw.select("label", "raw"), spread=True)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    model = LogisticRegression(elasticNetParam=1.0, regParam=strength, standardization=False, maxIter=max_iter,
                               tol=1e-4).fit(scaled.select("label", "features"))
    weights = model.coefficients.toArray()
    return [c for c, w in zip(features, weights) if abs(w) > 0]
