import math
import random

import pytest
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators.kernels import exponential_sum, nodes_for, smooth_sum


def tables(spark, rng, n, span, whole):
    place = (lambda: rng.randrange(-span // 3, span)) if whole else (lambda: rng.random() * span)
    grid, sources = [(k, place()) for k in "ab" for _ in range(n)], [("a", place(), rng.randint(1, 5)) for _ in range(n)] + [("b", 3 if whole else 3.0, 2)] * 40
    kind = "long" if whole else "double"
    odd = [(None, grid[0][1]), ("a", None), *grid[:5], ("c", grid[0][1])]
    return grid, sources, spark.createDataFrame(grid + odd, f"chrom string, pos {kind}"), spark.createDataFrame([*sources, ("a", None, 1), (None, sources[0][1], 1), ("a", sources[0][1], None)], f"chrom string, pos {kind}, w int")


def check(got, grid, sources, kernel, error):
    found = {(r.chrom, r.pos): r.total for r in got.collect() if r.chrom}
    assert set(found) == {*grid, ("c", grid[0][1])}
    for (k, x), total in found.items():
        assert total == pytest.approx(sum(w * kernel(abs(x - y)) for c, y, w in sources if c == k), abs=error)


@pytest.mark.parametrize("whole, span, width", [(True, 5000, 40), (False, 2.0, 0.01), (True, 60, 40)])
def test_smooth_sum_equals_all_pairs(spark, whole, span, width):
    grid, sources, a, b = tables(spark, random.Random(1), 300, span, whole)
    scale, s = (1e-4 if whole else 1.0), 0.01
    rho = (1 - s) / s

    def kernel(d):
        return 1 / (s * (1 + rho * (-math.expm1(-2 * d * scale) / 2)) ** 2)

    got = smooth_sum(a, b, lambda d: g.background_kernel(g.haldane(d * scale), s), width, 1e-9, "w")
    check(got, grid, sources, kernel, 1e-9 * 1000 / s)


def test_tolerance_sets_the_nodes(spark):
    assert nodes_for(1e-3) < nodes_for(1e-6) < nodes_for(1e-12) <= 18
    grid, sources, a, b = tables(spark, random.Random(2), 200, 3000, True)
    check(smooth_sum(a, b, lambda d: 1 / (1 + d), 25, 1e-4, "w"), grid, sources, lambda d: 1 / (1 + d), 1e-4 * 700)


@pytest.mark.parametrize("whole, span, rate", [(True, 5000, 0.01), (False, 2.0, 30.0), (True, 4000, 3.0)])
def test_exponential_sum_equals_all_pairs(spark, whole, span, rate):
    grid, sources, a, b = tables(spark, random.Random(3), 400, span, whole)
    check(exponential_sum(a, b, rate, "w"), grid, sources, lambda d: math.exp(-rate * d), 1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "chrom string, pos long")
    one = spark.createDataFrame([("a", 1)], "chrom string, pos long")
    for f in (lambda a, b: smooth_sum(a, b, lambda d: 1 / (1 + d), 10), lambda a, b: exponential_sum(a, b, 0.1)):
        assert f(none, one).count() == 0 and [r.total for r in f(one, none).collect()] == [0.0] and f(one, one).first().total == 1.0


@pytest.mark.parametrize("whole, span, width", [(True, 5000, 40), (False, 2.0, 0.01)])
def test_far_buckets_equal_all_pairs_at_the_width_asked_for(spark, whole, span, width):
    grid, sources, a, b = tables(spark, random.Random(5), 200, span, whole)
    scale = 1.0 if whole else 2500.0
    check(smooth_sum(a, b, lambda d: 1 / (20 + d * scale), width, 1e-9, "w", coarser=False), grid, sources, lambda d: 1 / (20 + d * scale), 1e-9 * 700)


def test_width_follows_the_density(spark):
    """Few points a key: their pairs, without nodes; many points a bucket: nodes. The plans stay small."""
    few = spark.range(4000).select((F.col("id") % 200).alias("chrom"), (F.col("id") * 7919 % 100_000).alias("pos"))
    many = spark.range(40_000).select(F.lit(0).alias("chrom"), (F.col("id") * 7919 % 100_000).alias("pos"))
    plans = {n: smooth_sum(t, t, lambda d: 1 / (1 + d), 100, 1e-11)._jdf.queryExecution().optimizedPlan().toString() for n, t in (("few", few), ("many", many))}
    assert "SIN(" not in plans["few"] and "SIN(" in plans["many"] and all(len(p) < 300_000 for p in plans.values())
    sums = smooth_sum(many, many, lambda d: 1 / (1 + d), 100, 1e-9)
    assert sums.where("pos = 0").first().total == pytest.approx(sum(1 / (1 + k * 7919 % 100_000) for k in range(40_000)), abs=1e-9 * 40_000)
