import numpy as np
import pytest

from featforge.operators import correlation as C


@pytest.mark.parametrize("tile", [256, 7, 1])
def test_tiles_give_the_pairwise_correlations(spark, monkeypatch, tile):
    monkeypatch.setattr(C, "TILE", tile)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 20)) + rng.normal(size=(300, 1))
    x[:, 3] = 2.0  # constant
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(20)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r["a"], r["b"]): r["corr"] for r in C.corr_pairs(df, names).collect()}
    assert len(got) == 190
    for i in range(20):
        for j in range(i + 1, 20):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 3 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                assert abs(got[names[i], names[j]] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9


def test_memory_of_a_task_grows_with_the_columns(spark):
    """One tile of 2,000 columns has 256 x 2,000 sums of each kind at most."""
    import pandas as pd
    data = pd.DataFrame(np.random.default_rng(1).normal(size=(50, 2000)))
    rows = [next(C._moments(low, min(low + C.TILE, 2000))(iter([data]))) for low in range(0, 2000, C.TILE)]
    sizes = [len(r["i"][0]) for r in rows]
    assert max(sizes) <= C.TILE * 2000 and sum(sizes) == 2000 * 1999 // 2
    merged = list(C._merged(iter([rows[0], rows[1], rows[0]])))
    assert len(merged) == 2 and np.allclose(merged[0]["n"][0], 100) and np.allclose(merged[1]["n"][0], 50)
