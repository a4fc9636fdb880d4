import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _duck(pdf, cols, probs):
    con = duckdb.connect()
    con.register("t", pdf)
    out = {}
    for c in cols:
        for q in probs:
            out[(c, q)] = con.execute(f"SELECT quantile_cont({c}, {q}) FROM t").fetchone()[0]
    return out


def _spark(spark, pdf, cols, probs, **kw):
    df = spark.createDataFrame(pdf)
    return {(r["column"], r["q"]): r["value"] for r in exact_quantiles(df, cols, probs, **kw).collect()}


@pytest.mark.parametrize("max_exact,buckets", [(0, 4), (100, 16), (2_000_000, 256)])
def test_matches_duckdb_with_nulls_and_skew(spark, max_exact, buckets):
    rng = np.random.default_rng(7)
    n = 3000
    skewed = np.where(rng.random(n) < 0.34, 5.0, rng.normal(0, 10, n))  # one value holds a third of the rows
    with_nulls = np.where(rng.random(n) < 0.1, np.nan, rng.exponential(3, n))
    ints = rng.integers(0, 5, n).astype(float)
    pdf = pd.DataFrame({"a": skewed, "b": with_nulls, "c": ints})
    got = _spark(spark, pdf, ["a", "b", "c"], PROBS, max_exact=max_exact, buckets=buckets)
    want = _duck(pdf, ["a", "b", "c"], PROBS)
    for k, v in want.items():
        # DuckDB's interpolation can differ from lo + (hi - lo) d in the last bit
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-12), k


def test_empty_column_gives_null(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0], "b": [np.nan, np.nan]})
    got = _spark(spark, pdf, ["a", "b"], [0.5])
    assert got[("a", 0.5)] == 1.5
    assert got[("b", 0.5)] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40))
def test_bucket_path_property(spark, values):
    pdf = pd.DataFrame({"x": values})
    got = _spark(spark, pdf, ["x"], [0.25, 0.5, 0.75], max_exact=0, buckets=4)
    want = np.quantile(np.array(values), [0.25, 0.5, 0.75])
    for q, w in zip([0.25, 0.5, 0.75], want):
        assert got[("x", q)] == pytest.approx(w, rel=1e-9, abs=1e-9)
