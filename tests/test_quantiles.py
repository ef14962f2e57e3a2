"""Exact quantiles by refinement against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import quantiles

KIND = "k string, v double"
Q = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def groups():
    r = np.random.default_rng(1)
    yield "normal", r.normal(0, 1, 3000)
    yield None, r.lognormal(0, 9, 2500)
    yield "ties", np.repeat([1.0, 2.0, 7.5], [900, 1200, 2])
    yield "one", np.array([4.25])
    yield "wide", np.concatenate([r.normal(0, 1e-300, 700), r.normal(0, 1e300, 700), [-1.7e308, 1.7e308]])
    yield "odd", np.concatenate([[np.nan] * 40, [np.inf] * 30, [-np.inf] * 20, r.normal(5, 1, 600)])
    yield "only nan", np.array([np.nan] * 10)
    yield "few", r.normal(0, 1, 2)


@pytest.mark.parametrize(("small", "cells"), [(100_000, 1024), (50, 1024), (10, 4), (1, 16)])
@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles(spark, monkeypatch, small, cells, discrete):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "CELLS", cells)
    made = dict(groups())
    rows = [(k, float(v)) for k, vs in made.items() for v in vs] + [("normal", None), ("nothing", None)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = {r.k: r for r in quantiles.summary(df, ["k"], "v", Q, [F.count("*").alias("rows")], discrete).collect()}
    assert set(got) == {*made, "nothing"} and got["normal"]["rows"] == 3001
    assert [got["nothing"][c] for c in Q] == [None] * len(Q)
    for k, vs in made.items():
        vs = np.sort(vs)
        for name, q in Q.items():
            if discrete:
                want = vs[max(int(np.ceil(len(vs) * q)) - 1, 0)]
            else:
                at = (len(vs) - 1) * q
                a, b = vs[int(np.floor(at))], vs[int(np.ceil(at))]
                want = a if a == b or at == int(at) else (np.ceil(at) - at) * a + (at - np.floor(at)) * b
            assert np.array_equal(got[k][name], want, equal_nan=True) or np.isclose(got[k][name], want, rtol=1e-15), (k, name)


def test_no_keys_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 5)
    df = spark.range(101).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert quantiles.summary(df, [], "v", {"m": 0.5}).first()["m"] == 50.0
    assert quantiles.summary(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
