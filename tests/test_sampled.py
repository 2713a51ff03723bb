import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from segspark.operators import populations, ranges, resample, simulate


def test_range_sums_equal_brute_force(spark):
    rng = random.Random(1)
    points = [(k, rng.randrange(-500, 900), rng.choice([None, 1, 5, 100])) for k in "ab" for _ in range(600)]
    sites = [(k, rng.randrange(-600, 1000), rng.randrange(0, 300)) for k in "abc" for _ in range(150)]
    a, b = spark.createDataFrame(sites, "chrom string, pos long, r long"), spark.createDataFrame(points, "chrom string, pos long, v long")
    got = ranges.range_sums(a.unionByName(a), b, {"x": (F.col("pos") - 20, F.col("pos") + 20), "y": (F.col("pos"), F.when(F.col("r") < 250, F.col("pos") + F.col("r")))}, "v", width=64).collect()
    first = dict.fromkeys((k, p) for k, p, _ in sites)
    assert sorted((r.chrom, r.pos) for r in got) == sorted(first)
    radius = defaultdict(set)
    for k, p, r in sites:
        radius[k, p].add(r)
    for r in got:
        inside = [v for k, p, v in points if k == r.chrom and r.pos - 20 <= p < r.pos + 20 and v is not None]
        assert (r.n_x or 0, r.sum_x or 0) == (len(inside), sum(inside))
        wide = [None if w >= 250 else [v for k, p, v in points if k == r.chrom and r.pos <= p < r.pos + w and v is not None] for w in radius[r.chrom, r.pos]]
        assert (r.n_y, r.sum_y) in [(None, None) if x is None else (len(x), sum(x)) for x in wide]


def test_pair_matrix_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(s, s % 3, p, rng.randint(2, 9), rng.randint(0, 2)) for s in range(40) for p in range(5) if rng.random() < 0.7]
    odd = [(None, 1, 1, 3, 1), (1, 1, None, 3, 1), (2, 2, 3, None, 1), rows[0]]
    got = populations.pair_matrix(spark.createDataFrame(rows + odd, "s int, seg int, pop int, n int, alt int"), ["s", "seg"], ["seg"]).collect()
    counts = Counter(), Counter()
    for s, seg, p, n, alt in [*rows, rows[0]]:
        counts[0][s, seg, p] += n
        counts[1][s, seg, p] += alt
    want = defaultdict(lambda: [0, 0, 0])
    for s, seg, p in counts[0]:
        for q in range(p, 5):
            if (s, seg, q) in counts[0]:
                n, a, m, b = counts[0][s, seg, p], counts[1][s, seg, p], counts[0][s, seg, q], counts[1][s, seg, q]
                x = want[seg, p, q]
                x[0] += 1
                x[1] += a * (n - a) if p == q else a * (m - b) + b * (n - a)
                x[2] += n * (n - 1) // 2 if p == q else n * m
    assert {(r.seg, r.a, r.b): [r.sites, r["diff"], r.pairs] for r in got} == want


def test_simulated_moments(spark):
    rows = spark.range(40_000).select("id", simulate.uniform(F.lit(3), F.col("id")).alias("u"))
    got = rows.select(simulate.binomial(F.col("u"), 20, F.lit(0.3)).alias("x"), simulate.beta_binomial(F.col("u"), 12, F.lit(0.5), F.lit(1.5)).alias("y"))
    m = got.agg(F.avg("x"), F.var_pop("x"), F.avg("y"), F.var_pop("y"), F.min("y"), F.max("y")).first()
    assert m[0] == pytest.approx(6, rel=0.02) and m[1] == pytest.approx(4.2, rel=0.05)
    assert m[2] == pytest.approx(3, rel=0.02) and m[3] == pytest.approx(12 * 0.25 * 0.75 * (2 + 12) / (2 + 1), rel=0.05) and (m[4], m[5]) == (0, 12)
    segments = spark.createDataFrame([(1, 0.2, 3000), (2, 0.01, 0), (3, 0.9, 1000)], "seg int, pred double, sites long")
    for n in (2, 8):
        first, again = (sorted(map(tuple, simulate.neutral_counts(d, "pred", n, F.col("seg"), ["seg"]).collect())) for d in (segments, segments.repartition(5)))
        assert first == again and [(s, het + hom) for s, het, hom in first] == [(1, 3000 * n * (n - 1) // 2), (3, 1000 * n * (n - 1) // 2)]
    two = {s: het for s, het, _ in simulate.neutral_counts(segments, "pred", 2, F.col("seg"), ["seg"]).collect()}
    assert two[1] == pytest.approx(600, rel=0.1) and two[3] == pytest.approx(900, rel=0.05)


def test_placed(spark):
    places = spark.createDataFrame([(g, p) for g in range(3) for p in range(200)], "g int, pos int")
    wanted = spark.createDataFrame([(0, 0), (1, 37), (2, 500)], "g int, count long")
    got = Counter(r.g for r in simulate.placed(places, wanted, ["g"], F.col("g")).distinct().collect())
    assert got == {1: 37, 2: 200}


def test_bootstrap_of_r_squared(spark):
    rng = random.Random(7)
    rows = [(k, o, o + rng.gauss(0, 0.2), o + rng.gauss(0, 0.1)) for k in range(103) for o in [rng.gauss(1, 0.5)]]
    windows = spark.createDataFrame(rows, "k int, o double, p double, q double")
    groups = resample.grouped(windows, ["k"], 10, {"p": ("o", "p"), "q": ("o", "q")})
    assert groups.count() == 10
    found = {r.rep: r for r in resample.bootstrap_r2(groups, 50, ["p", "q"]).collect()}
    assert sorted(found) == list(range(-1, 50))

    def r2(chosen, j):
        o = [x[1] for x in chosen]
        return 1 - sum((x[1] - x[j]) ** 2 for x in chosen) / sum((y - sum(o) / len(o)) ** 2 for y in o)

    def drawn(rep, k):
        x = (rep * 7919 + k * 104729 + 17) % resample.MODULUS
        for _ in range(2):
            x = (x * resample.MULTIPLIER + resample.INCREMENT) % resample.MODULUS
        return (x >> 8) % 10

    for rep in (-1, 0, 49):
        chosen = [x for k in range(10) for x in rows[10 * (k if rep < 0 else drawn(rep, k)) :][:10]]
        assert found[rep].p == pytest.approx(r2(chosen, 2)) and found[rep].q == pytest.approx(r2(chosen, 3))
    one = resample.compared(resample.bootstrap_r2(groups, 50, ["p", "q"]), "p", "q").first()
    gains = sum(r.q - r.p >= found[-1].q - found[-1].p for k, r in found.items() if k >= 0)
    assert math.isclose(one[-1], (gains + 1) / 51)


def test_counts_of_large_segments_are_cut_and_drawn_from_one_distribution_a_segment(spark):
    segments = spark.createDataFrame([(s, 0.05 + s / 10, n) for s, n in ((0, 1), (1, 7), (2, 1000), (3, 1001), (4, 0))], "seg long, pred double, sites long")
    for n in (2, 3, 10):
        got = simulate.neutral_counts(segments, "pred", n, F.col("seg"), ["seg"], piece=7)
        u, p = simulate.uniform(F.col("seg"), F.col("k")), F.col("pred")
        each = segments.where("sites > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sites") - 1))).withColumn("a", simulate.binomial(u, 1, p) if n == 2 else simulate.beta_binomial(u, n, p, p))
        want = each.groupBy("seg").agg(F.sum(F.col("a") * (n - F.col("a")) if n > 2 else F.col("a")).alias("het"), F.count("*").alias("m")).collect()
        assert sorted(map(tuple, got.collect())) == sorted((r.seg, r.het, r.m * n * (n - 1) // 2 - r.het) for r in want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan[: plan.rindex("RepartitionByExpression")] and "RepartitionByExpression" in plan
