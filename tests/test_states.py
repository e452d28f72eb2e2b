import random

import pytest
from pyspark.sql import types as T

from featforge.operators import states as S
from featforge.operators.rollup import PrimitiveRegistry, normalized_mode_count


def counts():
    def update(state, values):
        for v in values:
            state[v] = state.get(v, 0) + 1
        return state

    def merge(a, b):
        for v, n in b.items():
            a[v] = a.get(v, 0) + n
        return a

    def finish(state):
        known = [n for v, n in state.items() if v is not None]
        return max(known) / sum(state.values()) if known else None

    return S.StatePrimitive((T.StringType,), T.DoubleType(), dict, update, merge, finish)


@pytest.mark.parametrize("held", [20_000, 3])
def test_equals_the_built_in_on_a_hot_key(spark, monkeypatch, held):
    monkeypatch.setattr(S, "MAX_KEYS", held)
    rng = random.Random(held)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c", "d"]), rng.choice(["x", "y", "z", None])) for _ in range(3000)]
    rows += [("nulls", None), ("one", "x")]
    df = spark.createDataFrame(rows, "k string, v string").repartition(9)
    got = {r.k: r.s for r in S.aggregate_states(df, "k", {"s": ("v", counts())}).collect()}
    want = {r.k: r.s for r in normalized_mode_count(df, "k", "v", "s").collect()}
    assert got == want and len(got) == 8
    partial = S.aggregate_states(df.filter("k = 'hot'"), "k", {"s": ("v", counts())})
    assert partial.count() == 1


def test_keys_of_several_types_and_order_of_values(spark):
    """Nulls, NaN and both zeros are keys as in groupBy; a state may keep the values of one task in their order."""
    nan = float("nan")
    rows = [(1.0, None, 5), (nan, "a", 1), (nan, "a", 2), (0.0, "b", 3), (-0.0, "b", 4), (None, None, None), (None, None, 7)]
    df = spark.createDataFrame(rows, "x double, y string, v int")
    total = S.StatePrimitive((T.IntegerType,), T.LongType(), lambda: 0, lambda s, vs: s + sum(v for v in vs if v is not None), lambda a, b: a + b, lambda s: s)
    size = S.StatePrimitive((T.IntegerType,), T.StringType(), int, lambda s, vs: s + len(vs), lambda a, b: a + b, str)
    for parts in (1, 7):
        got = S.aggregate_states(df.repartition(parts), ["x", "y"], {"t": ("v", total), "n": ("v", size)}).collect()
        assert sorted((str(r.x), str(r.y), r.t, r.n) for r in got) == [
            ("0.0", "b", 7, "2"), ("1.0", "None", 5, "1"), ("None", "None", 7, "2"), ("nan", "a", 3, "2")]
    assert S.aggregate_states(df.limit(0), "x", {"t": ("v", total)}).count() == 0
    with pytest.raises(ValueError, match="name of a key"):
        S.aggregate_states(df, "x", {"x": ("v", total)})


def test_registry(spark):
    registry = PrimitiveRegistry()
    registry.register_state("share", [T.StringType], T.DoubleType(), dict, counts().update, counts().merge, counts().finish)
    with pytest.raises(ValueError, match="exists already"):
        registry.register_state("share", [T.StringType], T.DoubleType(), dict, None, None, None)
    df = spark.createDataFrame([(1, "a", "b", 2.0), (1, "a", None, 3.0)], "k int, p string, q string, r double")
    row = registry.apply(df, "k", "share").first().asDict()
    assert row == {"k": 1, "SHARE(p)": 1.0, "SHARE(q)": 0.5}
