"""Training and scoring of binary classifiers with Spark ML.

The fitted preprocessing is part of the model: which columns, their fill values and their order. Features are
assembled once per training table and kept on reliable storage, since boosting reads them again for every tree.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featforge.functions.numeric import col
from featforge.operators.encode import OneHot, add_vectors, categories, category_sizes, category_table
from featforge.operators.impute import Imputer
from featforge.operators.metrics import class_metrics, fold_summary, roc_auc
from featforge.operators.rows import clean_infinite, split_columns, string_columns
from featforge.operators.sampling import add_split, assign_folds, class_counts, permute_label
from featforge.session import cut_lineage, scratch_path

#: Model families by name; Spark boosted trees take the place of other gradient boosting libraries.
FAMILIES: dict[str, Callable[..., object]] = {
    "gbt": GBTClassifier,
    "random_forest": RandomForestClassifier,
    "tree_gini": lambda **p: DecisionTreeClassifier(impurity="gini", **p),
    "tree_entropy": lambda **p: DecisionTreeClassifier(impurity="entropy", **p),
    "logistic": LogisticRegression,
}


#: Sparse slots for all string columns that share slots by a hash on request.
HASHED = 1 << 12


@dataclass
class Preprocessor:
    """Numeric columns with values, one-hot string columns, fills; ``transform`` gives a ``features`` vector.

    String columns with too many values for columns of their own have sparse slots by a category table, as many as values; with
    ``wide="hash"`` they share ``HASHED`` slots by the hash of column and value instead.
    """

    numeric: list[str] = field(default_factory=list)
    categories: dict[str, list[str]] = field(default_factory=dict)
    fills: dict[str, float] = field(default_factory=dict)
    hashed: list[str] = field(default_factory=list)
    slots: dict[str, int] = field(default_factory=dict)
    table: DataFrame | None = None

    def fit(self, df: DataFrame, features: Sequence[str], strategy: str = "mean", wide: str = "table") -> Preprocessor:
        if wide not in ("table", "hash"):
            raise ValueError(f"wide columns can be kept by a table or by hash, not {wide!r}")
        chosen = clean_infinite(df.select(*[col(c) for c in features]))
        counts = chosen.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(features)]).first()
        present = [c for i, c in enumerate(features) if counts[i] > 0]
        chosen = chosen.select(*[col(c) for c in present])
        self.numeric = split_columns(chosen)[0]
        text = string_columns(chosen)
        self.categories = categories(chosen, text, wide="skip")
        rest = [c for c in text if c not in self.categories]
        self.hashed = rest if wide == "hash" else []
        self.table = category_table(chosen, rest) if rest and wide == "table" else None
        self.slots = category_sizes(self.table, rest) if self.table is not None else {}
        fitted = Imputer(strategy).fit(chosen.select(*[col(c) for c in self.numeric])) if self.numeric else Imputer()
        self.fills = {c: float(v) for c, v in fitted.values.items()}
        return self

    @property
    def names(self) -> list[str]:
        """Names of the vector slots; one-hot slots are ``<column>_<value>``."""
        slots = list(OneHot(self.categories, null_category=False).new_columns())
        wide: list[str] = []
        if self.slots:  # as many as the weights of a model, which the driver holds too
            order = {c: i for i, c in enumerate(self.slots)}
            rows = sorted(self.table.collect(), key=lambda r: (order[r["column"]], r["slot"]))
            wide = [f"{r['column']}_{r['value']}" for r in rows]
        return self.numeric + slots + [f"hashed_{i}" for i in range(HASHED if self.hashed else 0)] + wide

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Columns the table lacks count as missing: numbers take their fill, categories match no value."""
        columns = []
        for i, c in enumerate(self.numeric):
            value = F.coalesce(col(c).cast("double"), F.lit(self.fills[c])) if c in df.columns else F.lit(self.fills[c])
            finite = F.when(F.abs(value) == float("inf"), F.lit(self.fills[c])).otherwise(value)
            columns.append(finite.alias(f"_x{i}"))
        known = {c: v for c, v in self.categories.items() if c in df.columns}
        hot = OneHot(known, null_category=False).new_columns()
        slots = OneHot(self.categories, null_category=False).new_columns()
        for i, name in enumerate(slots, len(self.numeric)):
            columns.append((F.expr(hot[name]).cast("double") if name in hot else F.lit(0.0)).alias(f"_x{i}"))
        inputs = [f"_x{i}" for i in range(len(columns))]
        wide = {f"_h{i}": c for i, c in enumerate(self.hashed)}
        columns += [(col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(h) for h, c in wide.items()]
        tabled = {c: f"_t{i}" for i, c in enumerate(self.slots)}
        columns += [(col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(f"_s{i}") for i, c in enumerate(self.slots)]
        narrow = df.select(*[col(k) for k in keep], *columns)
        if wide:
            narrow = FeatureHasher(inputCols=list(wide), outputCol="_hashed", numFeatures=HASHED).transform(narrow)
            inputs.append("_hashed")
        if tabled:
            sources = {c: f"_s{i}" for i, c in enumerate(self.slots)}
            of = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
            renamed = self.table.withColumn("column", of[F.col("column")])
            narrow = add_vectors(narrow, renamed, {sources[c]: n for c, n in self.slots.items()}, {sources[c]: t for c, t in tabled.items()})
            narrow = narrow.drop(*sources.values())
            inputs += list(tabled.values())
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(narrow).drop(*inputs, *wide)


@dataclass
class FittedModel:
    """A Spark ML model with its preprocessing."""

    preprocessor: Preprocessor
    model: object
    label: str
    params: dict

    def score(self, df: DataFrame, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
        """``keep`` columns with ``probability`` and ``prediction`` (1 at or above the threshold)."""
        return _probability(self.model.transform(self.preprocessor.transform(df, keep)), keep, threshold)

    def importances(self) -> DataFrame:
        """``(feature, importance)`` of every vector slot."""
        spark = SparkSession.active()
        scores = getattr(self.model, "featureImportances", None)
        weights = scores.toArray() if scores is not None else abs(self.model.coefficients.toArray())
        return spark.createDataFrame([(n, float(w)) for n, w in zip(self.preprocessor.names, weights)],
                                     "feature string, importance double")

    def top_features(self, k: int = 10) -> DataFrame:
        return self.importances().orderBy(F.desc("importance"), "feature").limit(k)

    def save(self, spark: SparkSession, path: str) -> None:
        PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
        p = self.preprocessor
        state = json.dumps({"numeric": p.numeric, "categories": p.categories, "fills": p.fills, "hashed": p.hashed, "slots": p.slots,
                            "label": self.label, "params": self.params})
        if p.slots:
            p.table.write.mode("overwrite").parquet(f"{path}/categories")
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        stage = PipelineModel.load(f"{path}/model").stages[0]
        slots = state.get("slots") or {}
        table = spark.read.parquet(f"{path}/categories") if slots else None
        prep = Preprocessor(state["numeric"], state["categories"], state["fills"], state["hashed"], slots, table)
        return FittedModel(prep, stage, state["label"], state["params"])


def _probability(scored: DataFrame, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    p = vector_to_array("probability")[1]
    return scored.select(*[col(k) for k in keep], p.alias("probability"),
                         (p >= threshold).cast("int").alias("prediction"))


def _estimator(family: str, params: Mapping, label: str, seed: int, validation: str | None = None):
    if family not in FAMILIES:
        raise ValueError(f"unknown model family {family!r}; known: {sorted(FAMILIES)}")
    options = dict(params, featuresCol="features", labelCol=label)
    if family != "logistic":
        options.setdefault("seed", int(seed))
    if family == "gbt" and validation:
        options["validationIndicatorCol"] = validation
    return FAMILIES[family](**options)


def check_labels(df: DataFrame, label: str) -> dict:
    """Class sizes; raises unless both classes are there."""
    counted = class_counts(df, label)
    sizes = {c: n for c, n in (counted or {}).items() if c is not None}
    if set(sizes) != {0, 1}:
        raise ValueError(f"{label!r} must have the classes 0 and 1, found {'more' if counted is None else sorted(sizes)}")
    return sizes


def majority_baseline(df: DataFrame, label: str) -> dict[str, float]:
    """What a target with a single class allows: AUC 0.5 and the share of the most common class."""
    sizes = df.where(col(label).isNotNull()).groupBy(col(label)).count()
    found = sizes.agg(F.sum("count").alias("total"), F.max("count").alias("most"), F.count(F.lit(1)).alias("classes")).first()
    return {"auc": 0.5, "accuracy": found["most"] / found["total"] if found["total"] else 0.0, "n_classes": float(found["classes"])}


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = (),
             preprocessor: Preprocessor | None = None) -> tuple[DataFrame, Preprocessor]:
    """Labelled rows with ``features``, materialised for repeated passes."""
    known = df.where(col(label).isNotNull())
    prep = preprocessor or Preprocessor().fit(known, features)
    return cut_lineage(prep.transform(known, [*keep, label]), spread=True), prep


def fit(df: DataFrame, features: Sequence[str], label: str, key, params: Mapping | None = None, family: str = "gbt",
        validation_fraction: float | None = None, seed: int = 42) -> FittedModel:
    """Fit preprocessing and model. With a validation fraction, boosting stops when the held-out part (stratified)
    no longer improves."""
    known = df.where(col(label).isNotNull())
    check_labels(known, label)
    keys = [key] if isinstance(key, str) else list(key)
    data, prep = assemble(known, features, label, keys)
    indicator = None
    if validation_fraction:
        indicator = "_validation"
        marked = add_split(data, validation_fraction, keys, seed, label, "_split")
        data = marked.withColumn(indicator, F.col("_split") == "test").drop("_split")
    model = _estimator(family, params or {}, label, seed, indicator).fit(data)
    return FittedModel(prep, model, label, {"family": family, **(params or {})})


def compare_models(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key,
                   families: Mapping[str, tuple[str, Mapping]] | None = None, seed: int = 42) -> DataFrame:
    """One row of metrics on the test rows per model family. All families share one assembled training table."""
    families = families or {f: (f, {}) for f in FAMILIES}
    keys = [key] if isinstance(key, str) else list(key)
    data, prep = assemble(train, features, label, keys)
    held, _ = assemble(test, features, label, keys, prep)
    out = None
    for name, (family, params) in families.items():
        model = _estimator(family, params, label, seed).fit(data)
        scored = _probability(model.transform(held), [*keys, label])
        auc = roc_auc(scored, label, "probability").first()["auc"]
        row = class_metrics(scored, label, "probability").select(F.lit(name).alias("model"), F.lit(auc).alias("auc"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def cross_val_predict(df: DataFrame, features: Sequence[str], label: str, key, k: int = 5, params: Mapping | None = None,
                      family: str = "gbt", test: DataFrame | None = None, stratified: bool = True, seed: int = 42,
                      threads: int = 2):
    """Out-of-fold predictions ``(key, label, fold, probability, prediction)``, importances ``(feature, importance,
    fold)`` and, with ``test``, its probabilities averaged over the fold models.

    Folds whose training rows, or whose own rows, have one class are skipped. Fills and categories are learned from all
    folds together. Fold models fit side by side on a small thread pool.
    """
    keys = [key] if isinstance(key, str) else list(key)
    known = df.where(col(label).isNotNull())
    folds = assign_folds(known, k, keys, seed, label if stratified else None)
    data, prep = assemble(folds, features, label, [*keys, "fold"])
    held = cut_lineage(prep.transform(test, keys)) if test is not None else None
    sizes = {(r["fold"], r["y"]): r["count"] for r in data.groupBy("fold", col(label).alias("y")).count().collect()}
    usable = [f for f in range(k) if len({y for (g, y) in sizes if g != f}) == 2 == len({y for (g, y) in sizes if g == f})]
    if not usable:
        raise ValueError(f"no fold of {label!r} has both classes among its training rows and among its own")

    def run(fold):
        model = _estimator(family, params or {}, label, seed).fit(data.where(F.col("fold") != fold))
        oof = _probability(model.transform(data.where(F.col("fold") == fold)), [*keys, label, "fold"])
        importances = FittedModel(prep, model, label, {}).importances().withColumn("fold", F.lit(fold))
        scored = _probability(model.transform(held), keys) if held is not None else None
        return oof, importances, scored

    with ThreadPool(min(threads, len(usable))) as pool:
        done = pool.map(run, usable)
    oof, importances, scored = done[0]
    for o, i, s in done[1:]:
        oof, importances = oof.unionByName(o), importances.unionByName(i)
        scored = scored.unionByName(s) if scored is not None else None
    if scored is not None:
        scored = scored.groupBy(*[col(c) for c in keys]).agg(F.avg("probability").alias("probability"))
    return oof, importances, scored


def cross_val_auc(df: DataFrame, features: Sequence[str], label: str, key, k: int = 3, **options) -> DataFrame:
    oof, _, _ = cross_val_predict(df, features, label, key, k, **options)
    return fold_summary(cut_lineage(oof), label, "probability", "fold")


# Importance against permuted labels --------------------------------------------------------------------------------

def _tree_table(model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Split count and mean gain per feature, from the node table that a saved tree model consists of."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    splits = nodes.where("nodeData.split.featureIndex >= 0 and nodeData.leftChild >= 0").groupBy(
        F.col("nodeData.split.featureIndex").alias("_i")).agg(
        F.count(F.lit(1)).cast("double").alias("importance_split"), F.avg("nodeData.gain").alias("importance_gain"))
    slots = spark.createDataFrame(list(enumerate(names)), "_i int, feature string")
    return slots.join(splits, "_i", "left").select(
        "feature", F.coalesce("importance_split", F.lit(0.0)).alias("importance_split"),
        F.coalesce("importance_gain", F.lit(0.0)).alias("importance_gain"))


def _to_sources(slots: DataFrame, prep: Preprocessor) -> DataFrame:
    """Sum one-hot slots back onto their column."""
    mapping = {}
    for c, values in prep.categories.items():
        mapping.update({f"{c}_{v}": c for v in values})
    from featforge.operators.encode import rollup_encoded
    return rollup_encoded(slots, mapping, values=("importance_split", "importance_gain"))


def tree_importance(df: DataFrame, features: Sequence[str], label: str, key, params: Mapping | None = None,
                    seed: int = 42) -> DataFrame:
    """``(feature, importance_split, importance_gain)`` of a boosted-tree model (100 trees by default)."""
    keys = [key] if isinstance(key, str) else list(key)
    data, prep = assemble(df, features, label, keys)
    model = _estimator("gbt", {"maxIter": 100, **(params or {})}, label, seed).fit(data)
    return _to_sources(_tree_table(model, prep.names, df.sparkSession), prep)


def null_importance(df: DataFrame, features: Sequence[str], label: str, key, n_runs: int = 100,
                    params: Mapping | None = None, seed: int = 42, threads: int = 2) -> DataFrame:
    """Importances of models fitted to permuted labels, with a ``run`` column; run i permutes with seed + i.

    The vectors are assembled once; a run only rewrites the label column.
    """
    keys = [key] if isinstance(key, str) else list(key)
    data, prep = assemble(df, features, label, keys)

    def one(run):
        shuffled = permute_label(data, keys, label, seed + run)
        model = _estimator("gbt", {"maxIter": 100, **(params or {})}, label, seed).fit(shuffled)
        table = _to_sources(_tree_table(model, prep.names, df.sparkSession), prep)
        return table.withColumn("run", F.lit(run))

    with ThreadPool(threads) as pool:
        done = pool.map(one, range(n_runs))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def forward_select(df: DataFrame, features: Sequence[str], label: str, key, start: str | None = None,
                   family: str = "gbt", params: Mapping | None = None, seed: int = 42) -> list[tuple[str, float]]:
    """Greedy selection: features in alphabetical order stay when they raise the AUC on a 30 % holdout.

    Returns the kept features with the AUC reached when each joined.
    """
    keys = [key] if isinstance(key, str) else list(key)
    known = df.where(col(label).isNotNull()).select(*[col(c) for c in [*keys, label, *features]])
    marked = cut_lineage(add_split(known, 0.3, keys, seed, None, "_split"))
    train, held = marked.where("_split = 'train'"), marked.where("_split = 'test'")

    def auc(names):
        prep = Preprocessor().fit(train, names)
        model = _estimator(family, params or {}, label, seed).fit(prep.transform(train, [label]))
        scored = _probability(model.transform(prep.transform(held, [label])), [label])
        return roc_auc(scored, label, "probability").first()["auc"]

    start = start or features[0]
    kept, best = [(start, auc([start]))], None
    best = kept[0][1]
    for f in sorted(c for c in features if c != start):
        reached = auc([n for n, _ in kept] + [f])
        if reached > best:
            kept.append((f, reached))
            best = reached
    return kept


# Search and blending -----------------------------------------------------------------------------------------------

def draw(space: Mapping[str, tuple], rng: random.Random) -> dict:
    """One point of a space of ``(kind, low, high)`` ranges (int, float, log) and ``("choice", values)``."""
    out = {}
    for name, spec in sorted(space.items()):
        kind = spec[0]
        if kind == "int":
            out[name] = rng.randint(spec[1], spec[2])
        elif kind == "float":
            out[name] = rng.uniform(spec[1], spec[2])
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
        elif kind == "choice":
            out[name] = rng.choice(list(spec[1]))
        else:
            raise ValueError(f"unknown range kind {kind!r}")
    return out


def should_stop(losses: Sequence[float], minimum: int = 10, patience: int = 5, good: float = 0.4) -> bool:
    """Stop after at least ``minimum`` trials when the best loss is good and the last ``patience`` did not improve."""
    if len(losses) < minimum or min(losses) >= good:
        return False
    return min(losses[-patience:]) >= min(losses[:-patience])


def search(df: DataFrame, features: Sequence[str], label: str, key, space: Mapping[str, tuple], n_trials: int = 30,
           k: int = 3, family: str = "gbt", fixed: Mapping | None = None, seed: int = 42) -> DataFrame:
    """Seeded random search by k-fold AUC: ``(trial, params, auc, loss, best_loss)``. Folds are assembled once."""
    keys = [key] if isinstance(key, str) else list(key)
    known = df.where(col(label).isNotNull())
    check_labels(known, label)
    data, _ = assemble(assign_folds(known, k, keys, seed, label), features, label, [*keys, "fold"])
    rng, rows, losses = random.Random(seed), [], []
    for trial in range(n_trials):
        params = draw(space, rng)

        def fold_scores(fold, params=params):
            model = _estimator(family, {**(fixed or {}), **params}, label, seed).fit(data.where(F.col("fold") != fold))
            return _probability(model.transform(data.where(F.col("fold") == fold)), [label, "fold"])

        with ThreadPool(min(k, 3)) as pool:
            parts = pool.map(fold_scores, range(k))
        oof = parts[0]
        for p in parts[1:]:
            oof = oof.unionByName(p)
        auc = roc_auc(oof, label, "probability", ["fold"]).agg(F.avg("auc")).first()[0]
        losses.append(1 - auc)
        rows.append((trial, json.dumps(params, sort_keys=True), auc, 1 - auc, min(losses)))
        if should_stop(losses):
            break
    return df.sparkSession.createDataFrame(rows, "trial int, params string, auc double, loss double, best_loss double")


def feature_subset(names: Sequence[str], fraction: float = 0.5, seed: int = 42) -> list[str]:
    """A seeded random part of the feature names, in their order; at least one."""
    chosen = set(random.Random(seed).sample(list(names), max(1, int(len(names) * fraction))))
    return [n for n in names if n in chosen]


def blend(predictions: Sequence[DataFrame], key: str, probability: str = "probability") -> DataFrame:
    """``(key, probability_0.., probability)``: one column per model and their mean."""
    from featforge.functions.numeric import row_mean
    out = predictions[0].select(col(key), col(probability).alias("probability_0"))
    for i, p in enumerate(predictions[1:], 1):
        out = out.join(p.select(col(key), col(probability).alias(f"probability_{i}")), key, "full")
    return out.withColumn("probability", row_mean([f"probability_{i}" for i in range(len(predictions))]))


def fit_blend(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, n_models: int = 3,
              params: Mapping | None = None, family: str = "gbt", seed: int = 42) -> DataFrame:
    """Blend of models that each see a random half of the features."""
    parts = []
    for i in range(n_models):
        model = fit(train, feature_subset(features, 0.5, seed + i), label, key, params, family, seed=seed + i)
        parts.append(model.score(test, [key]))
    return blend(parts, key)


# Saved models ------------------------------------------------------------------------------------------------------

class ModelStore:
    """Models under a root folder, each with a row of metadata in an append-only catalog."""

    _SCHEMA = "name string, saved_at string, path string, family string, features array<string>, metadata string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model: FittedModel, name: str, metadata: Mapping | None = None) -> str:
        from datetime import datetime, timezone
        saved_at = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        path = f"{self.root}/{name}/{saved_at}"
        model.save(self.spark, path)
        row = (name, saved_at, path, str(model.params.get("family")), model.preprocessor.names, json.dumps(dict(metadata or {})))
        self.spark.createDataFrame([row], self._SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/_models")
        return path

    def list(self) -> DataFrame:
        return self.spark.read.schema(self._SCHEMA).parquet(f"{self.root}/_models").orderBy(F.desc("saved_at"))

    def load(self, name: str) -> FittedModel:
        found = self.list().where(F.col("name") == name).first()
        if found is None:
            raise FileNotFoundError(f"no model {name!r}")
        return FittedModel.load(self.spark, found.path)
