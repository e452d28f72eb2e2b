import numpy as np

from featforge.operators import sketches as S


def test_merged_parts_keep_their_bounds(spark, tmp_path):
    n = 40_000
    df = spark.range(n).selectExpr("id", "cast(id * 7919 % 30011 as double) / 7 as x", "cast(id % 997 as int) as k",
                                   "case when id % 5 = 0 then null else concat('v', id % 12345) end as t", "id % 3 as part").repartition(6)
    whole = S.sketch_profile(df, ["x", "k", "t"])
    parts = [S.sketch_profile(df.filter(f"part = {p}"), ["x", "k", "t"]) for p in range(3)]
    parts[0].write.parquet(str(tmp_path / "stored"))
    parts[0] = spark.read.parquet(str(tmp_path / "stored"))
    rows = df.toPandas()
    for table in (whole, S.merge_profiles(parts), S.merge_profiles(S.sketch_profile(df, ["x", "k", "t"], ["part"]))):
        got = {r["column"]: r for r in S.read_profiles(table).collect()}
        assert set(got) == {"x", "k", "t"}
        for c, r in got.items():
            known = rows[c].dropna()
            assert (r["rows"], r["missing"]) == (n, n - len(known))
            assert abs(r["n_distinct"] / known.nunique() - 1) <= S.distinct_error()
            if c == "t":
                assert r["median"] is None and r["low"] is None and r["mean"] is None
                continue
            assert r["low"] == known.min() and r["high"] == known.max() and abs(r["mean"] - known.mean()) < 1e-9 * abs(known.mean())
            for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
                below, upto = (known < r[name]).mean(), (known <= r[name]).mean()
                assert below - S.rank_error() <= q <= upto + S.rank_error()


def test_odd_tables(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, None, None), (float("inf"), None, "a"), (1.0, None, "a"), (None, None, "")], "x double, y int, `a b` string")
    got = {r["column"]: r for r in S.read_profiles(S.sketch_profile(df)).collect()}
    assert (got["x"]["missing"], got["x"]["median"], got["x"]["n_distinct"]) == (3, 1.0, 1)
    assert (got["y"]["missing"], got["y"]["median"], got["y"]["n_distinct"]) == (4, None, 0)
    assert (got["a b"]["missing"], got["a b"]["n_distinct"]) == (1, 2)
    empty = S.sketch_profile(df.limit(0))
    merged = {r["column"]: r for r in S.read_profiles(S.merge_profiles([empty, S.sketch_profile(df)])).collect()}
    assert merged["x"]["median"] == 1.0 and merged["a b"]["rows"] == 4
    assert {r["rows"] for r in S.read_profiles(empty).collect()} == {0}
    assert S.sketch_profile(df.limit(0), ["x"], ["a b"]).count() == 0
    assert np.isclose(S.distinct_error(), 0.0345, atol=1e-3) and S.rank_error() < 0.011
