import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featforge.functions.aggregates import safe_corr, trend
from featforge.functions.numeric import positive_part, ratio, row_max, row_mean
from featforge.operators import encode as E
from featforge.operators import impute as I
from featforge.operators import rows as R
from featforge.operators.joins import merge
from featforge.operators.profile import histogram, outlier_counts, validate
from featforge.operators.quantiles import exact_quantiles


def test_row_expressions(spark):
    df = spark.createDataFrame([(0.5, None, 0.3), (None, None, None)], "a double, b double, c double")
    out = df.select(row_mean(["a", "b", "c"]), row_max(["a", "b", "c"])).collect()
    assert tuple(out[0]) == (0.4, 0.5) and tuple(out[1]) == (None, None)
    values = spark.createDataFrame([(-2,), (0,), (3,), (None,)], "x int").select(positive_part("x").alias("p"))
    assert [r["p"] for r in values.collect()] == [0, 0, 3, 0]
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0] is None


def test_downcast_bounds_are_exclusive(spark):
    df = spark.createDataFrame([(126, 127, 1.1), (0, 1, 2.2)], "a long, b long, c double")
    out, report = R.downcast(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["tinyint", "smallint", "double"]
    assert out.collect() == df.collect() and report["percent_saved"] > 0


def test_names(spark):
    assert R.strict_names(["a b", "a_b", "a-b", "a_b_1", "1x", "", "é{}"]) == {
        "a b": "a_b_2", "a_b": "a_b", "a-b": "a_b_3", "a_b_1": "a_b_1", "1x": "f1x", "": "feature", "é{}": "é_"}
    assert R.clean_name('a{b}:c,"d"') == "a_b__c_d"
    df = spark.createDataFrame([(1, 2, 3)], "`A:B` int, A_B int, `A,B` int")
    assert R.sanitize_names(df)[0].columns == ["A_B_1", "A_B", "A_B_2"] == R.sanitize_names(df, "strict")[0].columns


def test_quantiles_of_tied_and_wide_values(spark, monkeypatch):
    from decimal import Decimal

    from featforge.operators import quantiles as Q
    big = 9007199254740992
    for listed in (1, 50, Q._LISTED):
        monkeypatch.setattr(Q, "_LISTED", listed)
        df = spark.range(0, 60_000, 1, 4).selectExpr(
            "cast(id % 2 as double) as half", "cast(id % 4 as int) as four", f"{big} + id as wide", "cast(id as decimal(30,10)) / 3 as money",
            "if(id < 59990, 7D, cast(id as double)) as tied")
        got = Q.values_at(df, {c: [0, 1, 14_999, 15_000, 29_999, 30_000, 59_989, 59_990, 59_999, 60_000] for c in df.columns})
        rows = df.toPandas()
        for c in df.columns:
            want = sorted(rows[c])
            for r in (0, 1, 14_999, 15_000, 29_999, 30_000, 59_989, 59_990, 59_999):
                assert got[(c, r)] == want[r], (listed, c, r)
            assert (c, 60_000) not in got
        assert isinstance(got[("wide", 1)], int) and isinstance(got[("money", 1)], Decimal)
    halves = spark.range(0, 1_000_000, 1, 8).selectExpr("cast(id % 2 as int) as x", "cast(id % 4 as double) as y")
    monkeypatch.setattr(Q, "_LISTED", 20_000)
    got = Q.exact_quantiles(halves, ["x", "y"], [0.25, 0.5, 0.75])
    assert got == {("x", 0.25): 0.0, ("x", 0.5): 0.5, ("x", 0.75): 1.0, ("y", 0.25): 0.75, ("y", 0.5): 1.5, ("y", 0.75): 2.25}
    n = 10 ** 8
    assert all(Q._position(r / 100, n) == (n - 1) * r / 100 or Q._position(r / 100, n).denominator > 1 for r in range(101))
    assert Q.exact_quantiles(halves, ["x"], []) == {} and Q.value_at(halves, "x", 10 ** 7) is None


def test_distinct_long_values_are_not_rounded(spark):
    from featforge.operators.rollup import column_stats
    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,), (None,)], "a bigint")
    row = column_stats(df).first()
    assert row["nunique"] == 2 and row["mode"] == 9007199254740992.0


def test_align_and_drop(spark):
    df = spark.createDataFrame([(1, "x")], "a int, extra string")
    fitted = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.LongType()), T.StructField("s", T.StringType())])
    assert tuple(R.align_to(df, fitted).first()) == (0.0, 1, "MISSING")
    with pytest.raises(KeyError):
        R.drop_columns(df, ["nope"])
    assert R.drop_columns(df, ["nope"], strict=False).columns == ["a", "extra"]


def test_factorize_and_apply(spark):
    train = spark.createDataFrame([(1, "M"), (2, "F"), (3, None), (4, "M")], "id int, g string")
    test = spark.createDataFrame([(1, "F"), (2, "X"), (3, None)], "id int, g string")
    coded, codes = E.factorize(train, "g", ["id"])
    assert [r["g"] for r in coded.orderBy("id").collect()] == [0, 1, -1, 0]
    assert [r["g"] for r in E.apply_codes(test, "g", codes).orderBy("id").collect()] == [1, -1, -1]


def test_codes_beyond_the_listed_size(spark, monkeypatch):
    df = spark.range(300).select("id", F.concat(F.lit("v"), F.format_string("%03d", (F.col("id") * 7) % 100)).alias("s"))
    want = sorted(map(tuple, E.ordinal_map(df, "s").collect()))
    monkeypatch.setattr(E, "MAX_CATEGORIES", 10)
    assert sorted(map(tuple, E.ordinal_map(df, "s").collect())) == want == [(f"v{i:03d}", i) for i in range(100)]
    with pytest.raises(ValueError):
        E.categories(df, ["s"], limit=10)


def test_one_hot_null_column(spark):
    df = spark.createDataFrame([("M",), ("F",), (None,)], "g string")
    out, names = E.one_hot(df)
    assert names == ["g_F", "g_M", "g_nan"] and [tuple(r) for r in out.collect()] == [(0, 1, 0), (1, 0, 0), (0, 0, 1)]


def test_infinity_then_median(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (3.0,), (None,)], "x double")
    clean = R.clean_infinite(df)
    out = I.Imputer("median").fit(clean).transform(clean)
    assert [r["x"] for r in out.collect()] == [1.0, 2.0, 3.0, 2.0]


def test_clean_dataset(spark):
    rows = [(i, float(i % 9) if i % 5 else None, ["a", "b", None, "d"][i % 4], f"c{i % 12}", i % 2 if i % 11 else None)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id int, f double, occupation string, city string, target int")
    out = I.clean_dataset(df, "target", ["id"])
    assert not R.string_columns(out) and "occupation" not in out.columns and "occupation_Unknown" in out.columns
    validate(out, [c for c in out.columns if c != "target"], "target")
    with pytest.raises(ValueError):
        validate(df, ["f"], "target")


def test_quantiles_match_brute_force(spark, monkeypatch):
    import numpy as np
    from featforge.operators import quantiles as Q
    rng = np.random.default_rng(0)
    a, b = rng.lognormal(size=3000), np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = {(c, p): float(np.quantile(v, p)) for c, v in (("a", a), ("b", b)) for p in probs}
    for accuracy, listed in ((10_000, 50_000), (20, 5)):   # the second needs many rounds and survives missed sketches
        monkeypatch.setattr(Q, "_ACCURACY", accuracy)
        monkeypatch.setattr(Q, "_LISTED", listed)
        got = exact_quantiles(df, ["a", "b"], probs)
        assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_outliers_and_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 9), 1000]], "x double")
    r = outlier_counts(df).first()
    assert (r["low"], r["high"], r["outliers"]) == (-9.0, 19.0, 1)
    assert [r["n"] for r in histogram(df, "x", 3).orderBy("bin").collect()] == [8, 0, 1]


def test_degenerate_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, 1.0, None)], "k int, a double, b double")
    out = {r["k"]: tuple(r)[1:] for r in df.groupBy("k").agg(safe_corr("a", "b"), trend("b", "a", 1.0)).collect()}
    assert out == {1: (None, None), 2: (None, None)}


def test_merge_rejects_other_types(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        merge(df, df, "cross", on="id")


def test_category_limit_counts_each_column(spark, tmp_path):
    from featforge.operators.models import HASHED, FittedModel, Preprocessor, fit
    df = spark.range(1200).selectExpr("id", "cast(id % 600 as string) as a", "cast(id % 500 as string) as b", "cast(id as string) as wide",
                                      "cast(id % 2 as int) as y", "cast(id % 2 as double) as x")
    assert {c: len(v) for c, v in E.categories(df, ["a", "b"], limit=600).items()} == {"a": 600, "b": 500}
    with pytest.raises(ValueError, match="wide"):
        E.categories(df, ["a", "wide"], limit=600)
    assert list(E.categories(df, ["a", "wide", "b"], limit=600, wide="skip")) == ["a", "b"]
    prep = Preprocessor(["x"], {"a": ["0", "1"]}, {"x": 0.0}, ["wide"])
    row = prep.transform(df).first()["features"]
    assert row.size == len(prep.names) == 3 + HASHED and row.numNonzeros() <= 4
    assert prep.transform(df.drop("wide")).first()["features"].size == 3 + HASHED
    model = fit(df, ["x", "b"], "y", "id", {"maxDepth": 1}, "tree_gini")
    model.save(spark, str(tmp_path / "m"))
    assert FittedModel.load(spark, str(tmp_path / "m")).score(df, ["id"]).count() == 1200


def test_fifty_thousand_categories_have_exact_slots(spark, tmp_path, monkeypatch):
    from featforge.operators.models import FittedModel, Preprocessor, fit
    n = 50_000
    df = spark.range(n + 2).selectExpr(
        "id", f"case when id < {n} then concat('v', lpad(id, 6, '0')) end as wide", "cast(id % 3 as string) as few",
        "cast(id % 2 as int) as y", "cast(id % 5 as double) as x").repartition(6)
    out, table = E.one_hot_vector(df, ["wide", "few"])
    assert table.filter("column = 'wide'").count() == n and out.columns == [*df.columns, "one_hot"]
    for r in out.filter("id % 9973 = 0 or wide is null").select("id", "wide", "few", "one_hot").collect():
        assert r.one_hot.size == n + 3
        assert sorted(int(i) for i in r.one_hot.indices) == ([r.id] if r.wide else []) + [n + int(r.few)]
    again, _ = E.one_hot_vector(spark.createDataFrame([("v000007", "9"), ("new", None)], "wide string, few string"), ["wide", "few"], table)
    assert [[int(i) for i in r.one_hot.indices] for r in again.orderBy("wide").collect()] == [[], [7]]
    prep = Preprocessor().fit(df, ["x", "few", "wide"])
    assert prep.slots == {"wide": n} and prep.hashed == [] and len(prep.names) == 1 + 3 + n
    row = prep.transform(df.filter("id = 41"), ["id"]).first()
    hot = dict(zip(row.features.indices.tolist(), row.features.values.tolist()))
    assert row.features.size == 4 + n and hot == {0: 1.0, 1 + 2: 1.0, 4 + 41: 1.0} and prep.names[4 + 41] == "wide_v000041"
    assert prep.transform(df.drop("wide")).first()["features"].size == 4 + n
    assert Preprocessor().fit(df, ["x", "wide"], wide="hash").hashed == ["wide"]
    few = df.filter("id % 500 = 0 or wide is null").cache()
    monkeypatch.setattr(E, "MAX_CATEGORIES", 10)
    monkeypatch.setattr(E.categories, "__defaults__", (10, "raise"))
    model = fit(few, ["x", "wide"], "y", "id", {"maxIter": 3}, "logistic")
    assert model.preprocessor.slots["wide"] == few.filter("wide is not null").select("wide").distinct().count()
    want = sorted(tuple(r) for r in model.score(few, ["id"]).collect())
    model.save(spark, str(tmp_path / "wide"))
    assert sorted(tuple(r) for r in FittedModel.load(spark, str(tmp_path / "wide")).score(few, ["id"]).collect()) == want


def test_distinct_counts_are_not_expanded_with_other_aggregates(spark):
    """Beside other aggregates a distinct count is its own narrow one; keys may be null and columns keep their order."""
    from featforge.operators.rollup import group_agg
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 2.0, 6.0), (None, 3.0, None), (2, None, 1.0)], "k int, a double, b double")
    out = group_agg(df, "k", {"a": ["nunique", "sum"], "b": ["max", "nunique"]})
    assert out.columns == ["k", "a_NUNIQUE", "a_SUM", "b_MAX", "b_NUNIQUE"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 2, 5.0, 6.0, 2), (None, 1, 3.0, None, 0), (2, 0, 0.0, 1.0, 1)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("distinct" in line and "sum(" in line for line in plan.splitlines())
