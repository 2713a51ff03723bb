import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.operators import scan
from segspark.operators.model import Model

MODEL, TRUE = Model(["b"], ["c"], unit=2.0), [-0.3, -1.0, 0.8]


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = random.Random(4), []
    for k in range(600):
        b, c, nu = -rng.random(), rng.random() * 3, 0.1 + rng.random() / 5
        theta = nu / TRUE[2]
        pi = theta / (math.exp(-b * 10 ** TRUE[0] / 2.0) + c * 10 ** TRUE[1] + theta)
        pairs = rng.randint(500, 5000)
        het = sum(rng.random() < pi for _ in range(pairs))
        rows.append((k % 4, b, c, nu, pairs - het, het))
    return spark.createDataFrame(rows, "block int, b double, c double, nu double, hom long, het long").cache()


def test_derivatives_agree_with_differences(data):
    rows = {c: np.array([r[c] for r in data.collect()], float) for c in ("b", "c", "nu", "hom", "het")}
    p, n, h = np.array([-0.1, -0.7, 0.9]), 3, 1e-5
    found = MODEL._sums(rows, p)
    curve = np.zeros((n, n))
    curve[np.tril_indices(n)] = found[2 + n :]
    for k in range(n):
        up, down = (MODEL._sums(rows, p + s * h * np.eye(n)[k]) for s in (1, -1))
        assert found[2 + k] == pytest.approx((up[0] - down[0]) / (2 * h), rel=1e-5)
        for j in range(k + 1):
            assert curve[k, j] == pytest.approx((up[2 + j] - down[2 + j]) / (2 * h), rel=1e-4, abs=1)


def test_fit_finds_the_truth_and_agrees_with_the_simplex(data):
    fit, simplex = MODEL.fit(data, [0.5, 0.0, 2.0]), MODEL.fit_simplex(data, [-0.5, -0.8, 1.0])
    assert fit.converged and simplex.converged
    assert fit.parameters == pytest.approx(simplex.parameters, abs=2e-3) and fit.value <= simplex.value + 1e-6
    assert fit.parameters == pytest.approx(TRUE, abs=0.1)
    assert max(abs(r.derivative) for r in MODEL.gradient(data, fit.parameters.tolist()).collect()) < 1e-2


def test_bounds_hold(data):
    fit = MODEL.fit(data, [0.0, 0.0, 1.0], bounds=[(-0.1, 6), (-12, 6), (0.01, 10)])
    assert fit.converged and fit.parameters[0] == -0.1
    inside = Model(["b"], ["c"], unit=2.0).fit(data, [0.0, 0.0, 1.0])
    assert fit.value > inside.value


def test_leave_one_out_equals_single_fits(data):
    fits = MODEL.leave_one_out(data, [0.0, 0.0, 1.0], "block", [0, 1, 2, 3, 99])
    assert all(f.converged for f in fits.values())
    for k in (0, 3, 99):
        alone = MODEL.fit(data.where(F.col("block") != k), [0.0, 0.0, 1.0])
        assert fits[k].parameters == pytest.approx(alone.parameters, abs=1e-5) and fits[k].value == pytest.approx(alone.value, rel=1e-12)
    stitched = MODEL.predict_left_out(data, {k: fits[k] for k in range(4)}, "block")
    assert stitched.count() == 600
    for k in (0, 3):
        one = MODEL.predict(data.where(F.col("block") == k), fits[k].parameters.tolist()).agg(F.sum("pred")).first()[0]
        assert stitched.where(F.col("block") == k).agg(F.sum("pred")).first()[0] == pytest.approx(one)
    assert MODEL.fits(data.limit(0), {None: [0.0, 0.0, 1.0]}) == {}


def test_many_ranges_stay_within_generated_code(spark):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("x"), F.lit(1).alias("w"))
    parts = scan.range_parts(rows, "x", rows=50)
    bounds = parts.groupBy("__part").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("__part").collect()
    assert len(bounds) == 1024 and max(b.n for b in bounds) < 200
    assert all(a.high < b.low for a, b in zip(bounds, bounds[1:]))
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(parts._jdf.queryExecution().executedPlan())
    assert len(code) < 400_000
    sums = scan.ordered_prefix_sum(rows, "x", [], {"s": "w"})
    assert sums.where("s != x + 1").count() == 0


def test_left_out_blocks_are_fitted_on_rows_read_once(data, monkeypatch):
    held, fits = [], Model.fits
    monkeypatch.setattr(Model, "fits", lambda self, segments, *a, **k: (held.append(segments.storageLevel.useMemory), fits(self, segments, *a, **k))[1])
    MODEL.leave_one_out(data.where("true").withColumn("more", F.lit(1)), [0.0, 0.0, 1.0], "block", [0])
    assert held == [True, True]


def flat_lines(path, seed, spread):
    """Order lines by which a weight and tau are hard to tell apart: rates hardly vary, as they do over the means of many lines."""
    import duckdb

    rng, rows = random.Random(seed), []
    for k in range(400):
        alt, b, nu = rng.randint(12, 32), rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((k % 5, k // 5, alt, round(0.05 + spread * b, 6), round(0.04 + spread * nu, 6)))
    con = duckdb.connect()
    con.execute("create table t (s bigint, d integer, q double, b double, n double)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", rows)
    con.execute(
        "copy (select s as l_suppkey, timestamp '1995-01-01' + d * interval 1 day as l_shipdate, q as l_quantity, b as l_discount, n as l_tax, "
        f"'A' as l_returnflag, 'F' as l_linestatus from t) to '{path}/lineitem.parquet' (format parquet)"
    )
    return str(path)


@pytest.mark.parametrize(("seed", "spread"), [(37, 0.0005), (31, 0.0003), (2, 0.004)])
def test_flat_likelihoods_end_where_sql_does(spark, tmp_path, seed, spread):
    """A fit that found no end in 60 steps, on a round of points and at one point, and one with another end."""
    from compare import connect, differences
    from segspark.plans import windows

    path = flat_lines(tmp_path, seed, spread)
    assert differences(spark, connect(path), windows.optimise_params, windows.ORACLE_SQL["optimise_params"], path) is None


def test_left_out_fits_end_where_sql_does(spark, tmp_path):
    from compare import connect, differences
    from segspark.plans import windows

    path = flat_lines(tmp_path, 2, 0.004)
    for name in ("leave_one_out_rsquared", "leave_one_out_pred", "leave_one_out_parameters"):
        assert differences(spark, connect(path), windows.QUERIES[name], windows.ORACLE_SQL[name], path) is None, name


def test_scoring_agrees_with_the_fit(data):
    found, fit = MODEL.scored(data, {None: [0.0, 0.0, 1.0]})[None], MODEL.fit(data, [0.0, 0.0, 1.0])
    assert found.converged and found.parameters == pytest.approx(fit.parameters, abs=1e-4) and found.value == pytest.approx(fit.value, rel=1e-9)
    assert MODEL.scored(data, {None: [0.0, 0.0, 1.0]}, steps=0)[None].parameters.tolist() == [0.0, 0.0, 1.0]
    left = MODEL.scored(data, {0: [0.0, 0.0, 1.0], 99: [0.0, 0.0, 1.0]}, "block")
    alone = MODEL.scored(data.where("block != 0"), {None: [0.0, 0.0, 1.0]})[None]
    assert left[0].parameters == pytest.approx(alone.parameters, abs=1e-8) and left[99].parameters == pytest.approx(found.parameters, abs=1e-8)
    assert MODEL.scored(data.limit(0), {None: [0.0, 0.0, 1.0]}) == {}
