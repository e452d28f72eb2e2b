"""Seeded sampling, splitting, folds and label permutation.

Every operator orders rows by a hash of their key, which does not depend on the partitioning. The hash values at
the wanted ranks are found by counting hash prefixes, so rows are chosen by a filter: exact sizes, no sort and no
shuffle of the table. The cuts of up to ``_FEW_CLASSES`` classes are literals of that filter; those of more stand in a table
that is refined round by round in Spark and joined to the rows, with the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featforge.functions.numeric import col
from featforge.operators.ordered import OrderedTable, add_row_index
from featforge.session import cut_lineage

_BITS = 12          # hash bits resolved per counting pass
_SMALL = 20_000     # hashes of an undecided prefix that may be listed on the driver
_FEW_CLASSES = 16


class PortableSeed(int):
    """A seed whose row order other engines can compute: by the first 15 hexadecimal digits of md5(key:...:seed)."""


def hash_order(key: str | Sequence[str], seed: int) -> Column:
    names = [key] if isinstance(key, str) else list(key)
    if isinstance(seed, PortableSeed):
        text = F.concat_ws(":", *[col(k).cast("string") for k in names], F.lit(str(int(seed))))
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.xxhash64(*[col(k) for k in names], F.lit(int(seed)))


def class_counts(df: DataFrame, label: str | None) -> dict | None:
    """Rows per class; None if there are more than ``_FEW_CLASSES`` classes."""
    if label is None:
        return {None: df.count()}
    rows = df.groupBy(col(label)).count().limit(_FEW_CLASSES + 1).collect()
    return {r[0]: r["count"] for r in rows} if len(rows) <= _FEW_CLASSES else None


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    """(_c, _size) of any number of classes."""
    return cut_lineage(df.groupBy(col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_size")))


def cut_table(df: DataFrame, key, seed: int, wanted: DataFrame, label: str) -> DataFrame:
    """(_c, _cut): for each row (_c, _rank) of ``wanted`` the hash of the row of that 1-based rank in its class.

    Every round counts the rows of the undecided (class, hash prefix) cells by their next 12 bits, until the cells are
    small enough to be ranked inside. No class is gathered and nothing but two counts reaches the driver.
    """
    base = df.select(col(label).alias("_c"), hash_order(key, seed).alias("_h"))
    live = wanted.select("_c", "_rank", F.lit(0).cast("bigint").alias("_below"), F.lit(0).cast("bigint").alias("_prefix"))
    shift = 64
    while True:
        previous, shift = shift, max(shift - _BITS, 0)
        parent = lambda h, at=previous: F.lit(0).cast("bigint") if at == 64 else F.shiftright(h, at)
        cells = live.select(F.col("_c").alias("_lc"), F.col("_prefix").alias("_lp")).distinct()
        scope = base.withColumn("_parent", parent("_h"))
        scope = scope.join(cells, F.col("_c").eqNullSafe(F.col("_lc")) & (F.col("_parent") == F.col("_lp")), "left_semi")
        parts = scope.groupBy("_c", "_parent", F.shiftright("_h", shift).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        inside = Window.partitionBy("_c", "_parent").orderBy("_part")  # 4096 rows at most
        parts = parts.withColumn("_upto", F.sum("_n").over(inside)).withColumnRenamed("_c", "_pc")
        hit = F.col("_c").eqNullSafe(F.col("_pc")) & (F.col("_prefix") == F.col("_parent"))
        need = F.col("_rank") - F.col("_below")
        live = live.join(parts, hit & (F.col("_upto") >= need) & (F.col("_upto") - F.col("_n") < need)).select(
            "_c", "_rank", (F.col("_below") + F.col("_upto") - F.col("_n")).alias("_below"), F.col("_part").alias("_prefix"), "_n")
        live = cut_lineage(live)
        if shift == 0:
            return live.select("_c", F.col("_prefix").alias("_cut"))
        if (live.agg(F.max("_n")).first()[0] or 0) <= _SMALL:
            break
    cells = live.select(F.col("_c").alias("_lc"), F.col("_prefix").alias("_lp")).distinct()
    rows = base.withColumn("_part", F.shiftright("_h", shift))
    rows = rows.join(cells, F.col("_c").eqNullSafe(F.col("_lc")) & (F.col("_part") == F.col("_lp")), "left_semi")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_c", "_part").orderBy("_h"))).withColumnRenamed("_c", "_rc")
    same = F.col("_c").eqNullSafe(F.col("_rc")) & (F.col("_prefix") == F.col("_part")) & (F.col("_rank") - F.col("_below") == F.col("_at"))
    return live.join(rows, same).select("_c", F.col("_h").alias("_cut"))


def _with_bands(df: DataFrame, key, seed: int, bounds: DataFrame, label: str, name: str) -> DataFrame:
    """``df`` with the index of each row's rank band in its class; ``bounds`` has rows (_c, _size, _rank), as in ``_rank_band``."""
    cuts = cut_table(df, key, seed, bounds.filter("_rank > 0 and _rank < _size").select("_c", "_rank").distinct(), label)
    below = bounds.groupBy("_c").agg(F.count_if(F.col("_rank") <= 0).cast("int").alias("_zero"))
    ends = cuts.groupBy("_c").agg(F.collect_list("_cut").alias("_cuts")).withColumnRenamed("_c", "_ec")  # a few bounds a class
    known = below.join(ends, F.col("_c").eqNullSafe(F.col("_ec")), "left").drop("_ec").withColumnRenamed("_c", "_kc")
    h = hash_order(key, seed)
    marked = df.withColumn("_h", h).join(known, col(label).eqNullSafe(F.col("_kc")))
    passed = F.coalesce(F.size(F.filter("_cuts", lambda c: F.col("_h") > c)), F.lit(0))
    passed = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(passed)
    return marked.withColumn(name, (F.col("_zero") + passed).cast("int")).drop("_h", "_kc", "_zero", "_cuts")


def _quota_table(sizes: DataFrame, n: int) -> DataFrame:
    """(_c, _size, _rank) with the quota of each class, as ``_quotas`` gives."""
    total = sizes.agg(F.sum("_size")).first()[0] or 1
    exact = F.col("_size") * F.lit(n) / F.lit(total)
    shared = sizes.select("_c", "_size", F.floor(exact).alias("_q"), (exact - F.floor(exact)).alias("_left"))
    left = n - (shared.agg(F.sum("_q")).first()[0] or 0)
    text = F.coalesce(F.col("_c").cast("string"), F.lit("None"))
    ranked = add_row_index(shared, [(-F.col("_left")).alias("_order"), text], "_at")
    return ranked.select("_c", "_size", (F.col("_q") + (F.col("_at") <= left).cast("int")).alias("_rank"))


def rank_cuts(df: DataFrame, key, seed: int, ranks: Mapping[object, Sequence[int]], label: str | None = None) -> dict:
    """Per class, the hash value held by the row of each 1-based rank in hash order.

    Pass after pass counts the rows under each 12-bit extension of the prefixes that are still undecided, until
    few enough hashes are left to list. Driver state is at most 4096 counts per undecided rank.
    """
    wanted = {(c, r): (0, r) for c, rs in ranks.items() for r in rs}   # -> (rows below the prefix, rank)
    h = hash_order(key, seed)
    label_col = col(label) if label else F.lit(None).cast("string")
    base = df.select(label_col.alias("_c"), h.alias("_h"))
    prefix = {w: None for w in wanted}
    found: dict = {}
    shift = 64
    while wanted:
        previous, shift = shift, max(shift - _BITS, 0)
        scope = base
        if previous < 64:
            live = F.lit(False)
            for c in {w[0] for w in wanted}:
                chosen = sorted({prefix[w] for w in wanted if w[0] == c})
                live = live | (F.col("_c").eqNullSafe(F.lit(c)) & F.shiftright("_h", previous).isin(chosen))
            scope = base.where(live)
        counts = scope.groupBy("_c", F.shiftright("_h", shift).alias("_p")).count().collect()
        by_class: dict = {}
        for r in counts:
            by_class.setdefault(r["_c"], []).append((r["_p"], r["count"]))
        for parts in by_class.values():
            parts.sort()
        small: dict = {}
        for w in list(wanted):
            below, rank = wanted[w]
            for p, n in by_class[w[0]]:
                if prefix[w] is not None and (p >> (previous - shift)) != prefix[w]:
                    continue
                if below + n >= rank:
                    break
                below += n
            wanted[w], prefix[w] = (below, rank), p
            if shift == 0:
                found[w] = p
                del wanted[w]
            elif n <= _SMALL:
                small.setdefault((w[0], p), []).append(w)
        if small and len(small) * _SMALL <= 4_000_000:
            listed = F.lit(False)
            for c in {k[0] for k in small}:
                listed = listed | (F.col("_c").eqNullSafe(F.lit(c))
                                   & F.shiftright("_h", shift).isin(sorted(k[1] for k in small if k[0] == c)))
            hashes: dict = {}
            for r in base.where(listed).select("_c", "_h").collect():
                hashes.setdefault((r["_c"], r["_h"] >> shift), []).append(r["_h"])
            for group, members in small.items():
                ordered = sorted(hashes[group])
                for w in members:
                    below, rank = wanted.pop(w)
                    found[w] = ordered[rank - below - 1]
    return {c: [found[(c, r)] for r in rs] for c, rs in ranks.items()}


def _rank_band(df: DataFrame, key, seed: int, bounds: Mapping[object, Sequence[int]], label: str | None) -> Column:
    """Index of the rank band of each row: 0 up to the first bound, then 1, and so on. Bounds are rank numbers."""
    sizes = class_counts(df, label)
    cuts = rank_cuts(df, key, seed, {c: sorted({b for b in bs if 0 < b < sizes[c]}) for c, bs in bounds.items()}, label)
    h = hash_order(key, seed)
    out = None
    for c, bs in bounds.items():
        at = dict(zip(sorted({b for b in bs if 0 < b < sizes[c]}), cuts[c]))
        band = F.lit(0)
        for b in bs:
            if b <= 0:
                band = band + 1
            elif b < sizes[c]:
                band = band + (h > F.lit(at[b])).cast("int")
        mine = F.lit(True) if label is None else col(label).eqNullSafe(F.lit(c))
        out = F.when(mine, band) if out is None else out.when(mine, band)
    return out if out is not None else F.lit(0)


def _quotas(sizes: Mapping, n: int) -> dict:
    """Split n over the classes by share, largest remainders first; ties go to the smaller class value."""
    total = sum(sizes.values())
    exact = {c: n * s / total for c, s in sizes.items()}
    quota = {c: int(e) for c, e in exact.items()}
    left = n - sum(quota.values())
    for c in sorted(sizes, key=lambda c: (-(exact[c] - quota[c]), str(c)))[:left]:
        quota[c] += 1
    return quota


def sample_n(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """Exactly n rows (all of them when there are fewer); ``key`` identifies a row."""
    return df.where(_rank_band(df, key, seed, {None: [n]}, None) == 0)


def sample_stratified(df: DataFrame, n: int, label: str, key, seed: int = 42) -> DataFrame:
    """n rows with the class shares of the table."""
    sizes = class_counts(df, label)
    if sizes is None:
        if n >= df.count():
            return df
        bounds = _quota_table(_class_sizes(df, label), n)
        return _with_bands(df, key, seed, bounds, label, "_band").where("_band = 0").drop("_band")
    if n >= sum(sizes.values()):
        return df
    return df.where(_rank_band(df, key, seed, {c: [q] for c, q in _quotas(sizes, n).items()}, label) == 0)


#: The named sampling profiles as (rows, stratified).
PROFILES = {
    "Quick Exploration": (5_000, False),
    "Balanced Development": (20_000, True),
    "Production Preparation": (50_000, True),
    "Full Dataset": (None, False),
}


def apply_profile(datasets: Mapping[str, DataFrame], profile: str, keys: Mapping[str, object], root: str,
                  label: str, n: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Sample each dataset by a named profile; only the labelled root is stratified. Unknown names mean balanced."""
    size, stratified = PROFILES.get(profile, PROFILES["Balanced Development"])
    if profile == "Full Dataset":
        return dict(datasets)
    size = n if n is not None else size
    out = {}
    for name, df in datasets.items():
        if stratified and name == root and label in df.columns:
            out[name] = sample_stratified(df, size, label, keys[name], seed)
        else:
            out[name] = sample_n(df, size, keys[name], seed)
    return out


def add_split(df: DataFrame, test_fraction: float, key, seed: int = 42, stratify: str | None = None,
              name: str = "split") -> DataFrame:
    """Mark each row ``train`` or ``test``. The test part has ceil(n * fraction) rows, shared out by class."""
    sizes = class_counts(df, stratify)
    total = df.count() if sizes is None else sum(sizes.values())
    n_test = -int(-(total * test_fraction) // 1)
    if sizes is None:
        marked = _with_bands(df, key, seed, _quota_table(_class_sizes(df, stratify), n_test), stratify, "_band")
        return marked.withColumn(name, F.when(F.col("_band") == 0, "test").otherwise("train")).drop("_band")
    bounds = {c: [q] for c, q in _quotas(sizes, n_test).items()} if total else {}
    band = _rank_band(df, key, seed, bounds, stratify)
    return df.withColumn(name, F.when(band == 0, "test").otherwise("train"))


def train_test_split(df: DataFrame, test_fraction: float, key, seed: int = 42, stratify: str | None = None):
    marked = add_split(df, test_fraction, key, seed, stratify, "_split")
    return (marked.where(F.col("_split") == "train").drop("_split"),
            marked.where(F.col("_split") == "test").drop("_split"))


def assign_folds(df: DataFrame, k: int, key, seed: int = 42, stratify: str | None = None,
                 name: str = "fold") -> DataFrame:
    """Fold 0..k-1 per row; sizes within a class differ by at most one row."""
    sizes = class_counts(df, stratify)
    if sizes is None:
        ranks = F.expr(f"transform(sequence(1, {k - 1}), i -> (_size * i + {k - 1}) div {k})")
        bounds = _class_sizes(df, stratify).select("_c", "_size", (F.explode(ranks) if k > 1 else F.lit(None).cast("bigint")).alias("_rank"))
        return _with_bands(df, key, seed, bounds, stratify, name)
    bounds = {c: [(s * i + k - 1) // k for i in range(1, k)] for c, s in sizes.items()}
    return df.withColumn(name, _rank_band(df, key, seed, bounds, stratify))


def permute_label(df: DataFrame, key, label: str, seed: int = 42, name: str | None = None) -> DataFrame:
    """Shuffle the labels over the rows, keeping each class count: in hash order, the first class gets the first
    rows, the next class the next rows, and so on."""
    sizes = class_counts(df, label)
    if sizes is None:  # the rows in hash order and the labels in class order, side by side
        names = [key] if isinstance(key, str) else list(key)
        rows = OrderedTable(df, [hash_order(key, seed), *names]).running(row_number="_at")
        labels = OrderedTable(df.select(col(label).isNull().alias("_none"), col(label).alias("_label")), ["_none", "_label"]).running(row_number="_at")
        mixed = rows.join(labels, "_at").withColumn(name or label, F.col("_label"))
        return mixed.select(*[col(c) for c in dict.fromkeys([*df.columns, name or label])])
    classes = sorted(sizes, key=lambda c: (c is None, c))
    bounds, reached = [], 0
    for c in classes[:-1]:
        reached += sizes[c]
        bounds.append(reached)
    band = _rank_band(df, key, seed, {None: bounds}, None)
    dtype = df.schema[label].dataType
    out = F.lit(classes[-1]).cast(dtype)
    for i, c in reversed(list(enumerate(classes[:-1]))):
        out = F.when(band == i, F.lit(c).cast(dtype)).otherwise(out)
    return df.withColumn(name or label, out)
