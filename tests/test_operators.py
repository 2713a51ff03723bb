"""Operators on small inputs with results worked out by hand or by plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators import bins, intervals as iv, lookup, maps, resample, scan, smooth, stats
from segspark.operators.model import Model, nelder_mead, simulated, starting_points


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def spans(spark, pairs, chrom="c"):
    return frame(spark, [(chrom, a, b) for a, b in pairs], "chrom string, start long, end long")


def listed(df):
    return sorted((r.start, r.end) for r in df.collect())


WIDTHS = [3, 1 << 20]  # many buckets, and one


@pytest.mark.parametrize("width", WIDTHS)
def test_merge_and_intersect(spark, width):
    a = spans(spark, [(1, 10), (7, 12), (15, 30), (25, 55), (45, 51)])
    assert listed(iv.merge(a, width=width)) == [(1, 12), (15, 55)]
    assert listed(iv.merge(spans(spark, [(1, 3), (3, 5), (6, 7)]), width=width)) == [(1, 5), (6, 7)]
    assert listed(iv.merge(spans(spark, [(1, 3), (5, 7), (9, 11), (20, 22)] * 40), width=width)) == [(1, 3), (5, 7), (9, 11), (20, 22)]
    x, y = spans(spark, [(1, 10), (25, 55)]), spans(spark, [(7, 12), (15, 30), (45, 51)])
    assert listed(iv.intersect(x, y, width=width)) == [(7, 10), (25, 30), (45, 51)]
    touch = spans(spark, [(10, 12)])
    assert listed(iv.intersect(x, touch, width=width)) == [] and listed(iv.intersect(x, touch, width=width, closed=True)) == [(10, 10)]


@pytest.mark.parametrize("width", WIDTHS)
def test_islands_and_sets_equal_masks(spark, width):
    points = frame(spark, [("c", p) for p in (1, 2, 4, 4)], "chrom string, pos long")
    assert listed(iv.islands(points, width=width)) == [(1, 3), (4, 5)]
    rng = random.Random(3)
    for _ in range(3):
        a, b = ([(s, s + rng.randint(0, 9)) for s in rng.choices(range(60), k=12)] for _ in range(2))
        count = lambda iv_, p: sum(s <= p < e for s, e in iv_)
        fa, fb = spans(spark, a), spans(spark, b)

        def runs(keep):
            days = [p for p in range(80) if keep(p)]
            starts = [p for p in days if p - 1 not in days]
            return [(s, next(p for p in range(s, 99) if p not in days)) for s in starts]

        assert listed(iv.subtract(fa, fb, width=width)) == runs(lambda p: count(a, p) and not count(b, p))
        assert listed(iv.covered_at_least(fa, 2, width=width)) == runs(lambda p: count(a, p) > 1)
        both = iv.overlap_bases(fa, fb, width=width).first()
        assert both.bases_both == sum(count(a, p) > 0 and count(b, p) > 0 for p in range(80))
        assert listed(iv.complement(fa, spans(spark, [(0, 70)]), width=width)) == runs(lambda p: p < 70 and not count(a, p))


@pytest.mark.parametrize("width", WIDTHS)
def test_overlay_and_rle(spark, width):
    step = lambda rows: frame(spark, [("c", s, x) for s, x in rows], "chrom string, start long, value double")
    over = iv.overlay({"m": step([(0, 1.0), (3, 2.0)]), "n": step([(0, 7.0), (1, 8.0)])}, width=width)
    assert sorted((r.start, r.end, r.m, r.n) for r in over.where("start < 3").collect()) == [(0, 1, 1.0, 7.0), (1, 3, 1.0, 8.0)]
    rows = frame(spark, [("c", 0, 2, 5.0), ("c", 2, 3, 5.0), ("c", 3, 9, 6.0), ("c", 9, 12, 5.0)], "chrom string, start long, end long, value double")
    assert sorted((r.start, r.end, r.value) for r in iv.rle(rows, width=width).collect()) == [(0, 3, 5.0), (3, 9, 6.0), (9, 12, 5.0)]
    assert sorted((r.start, r.end, r.value) for r in iv.capped(rows, 5.0, width=width).collect()) == [(0, 12, 5.0)]


def test_lengths_tile(spark):
    lens = [27917972, 5008261, 5825886, 4420954, 8131493]
    rows = frame(spark, [("c", k, x) for k, x in enumerate(lens)], "chrom string, seg_idx long, len long")
    placed = iv.from_lengths(rows, width=2).orderBy("seg_idx").collect()
    assert placed[-1].end == 51304566 and [r.start for r in placed][1:] == [r.end for r in placed][:-1]
    full = frame(spark, [("c", 51304568)], "chrom string, length long")
    assert iv.filled_tail(rows, full).agg(F.sum("len")).first()[0] == 51304568
    assert iv.not_tiling(rows, full).count() == 1 and iv.not_tiling(iv.filled_tail(rows, full), full).count() == 0
    assert iv.filled_tail(rows, frame(spark, [("c", 51304560)], "chrom string, length long")).agg(F.sum("len")).first()[0] == 51304566


def test_sequential_interval_folds(spark):
    rows = frame(spark, [("c", 0, 4, 10), ("c", 2, 6, 20), ("c", 9, 10, 3), ("c", 10, 12, 6)], "chrom string, start long, end long, value long")
    assert sorted((r.start, r.end, r.value) for r in iv.merge_weighted(rows).collect()) == [(0, 6, 15), (9, 12, 5)]
    done = iv.without_gaps(rows, frame(spark, [("c", 20)], "chrom string, length long"))
    assert sorted((r.start, r.end) for r in done.collect()) == [(0, 6), (6, 20)]
    genes = frame(spark, [("c", 0, 10, 5, "a"), ("c", 5, 12, 9, "b"), ("c", 11, 20, 2, "d"), ("c", 12, 30, 1, "e")], "chrom string, start long, end long, size long, name string")
    assert sorted(r.name for r in iv.nonredundant(genes).collect()) == ["b", "e"]
    parts = iv.split_long(spans(spark, [(0, 10), (20, 22)]), 4)
    assert listed(parts) == [(0, 3), (3, 6), (6, 10), (20, 22)]
    flank = iv.flanks(frame(spark, [("c", 100, 200, "+"), ("c", 300, 304, "-")], "chrom string, start long, end long, strand string"), 50, 10)
    assert listed(flank) == [(50, 100), (100, 110), (190, 200), (300, 304), (300, 304), (304, 354)]


def test_merged_weighted_query_takes_all_intervals(spark):
    from segspark.plans import views, windows

    data = "/root/testdata/sf0.001"
    runs = {}
    for r in sorted(views.intervals_b(spark, data).distinct().collect(), key=lambda r: (r.chrom, r.start, r.end)):
        own = runs.setdefault(r.chrom, [])
        if own and r.start <= own[-1][1]:
            own[-1][1] = max(own[-1][1], r.end)
        else:
            own.append([r.start, r.end])
    got = sorted((r.chrom, r.start, r.end) for r in windows.merged_weighted(spark, data).collect())
    assert got == sorted((c, a, b) for c, own in runs.items() for a, b in own)


@pytest.mark.parametrize("width", WIDTHS)
def test_lookups_equal_brute_force(spark, width):
    rng = random.Random(9)
    places, edges = [rng.randrange(60) for _ in range(30)], sorted(rng.sample(range(60), 9))
    probes = frame(spark, [("c", p, k) for k, p in enumerate(places)], "chrom string, pos long, k long")
    at = frame(spark, [("c", e, float(e)) for e in edges], "chrom string, pos long, value double")
    for forward in (False, True):
        for strict in (False, True):
            got = {r.k: r.value for r in lookup.asof(probes, at, ["value"], forward=forward, strict=strict, width=width).collect()}
            ok = lambda e, p: (e > p if strict else e >= p) if forward else (e < p if strict else e <= p)
            assert got == {k: (min if forward else max)([float(e) for e in edges if ok(e, p)], default=None) for k, p in enumerate(places)}
    near = {r.k: r.distance for r in lookup.nearest(probes, at, width=width).collect()}
    assert near == {k: min((e - p for e in edges), key=lambda d: (abs(d), -d)) for k, p in enumerate(places)}
    held = [(5, 9), (20, 31), (40, 41)]
    inside = {r.k: r.inside for r in lookup.in_interval(probes, spans(spark, held), width=width).collect()}
    assert inside == {k: any(a <= p < b for a, b in held) for k, p in enumerate(places)}
    outside = {r.k: r.distance for r in lookup.nearest_edge(probes, spans(spark, held), width=width).collect()}
    edges_of = [e for a, b in held for e in (a, b - 1)]
    assert set(outside) == {k for k in inside if not inside[k]} and all(abs(d) == min(abs(e - places[k]) for e in edges_of) for k, d in outside.items())
    xs, ys = edges, [float(k * k) for k in range(len(edges))]
    knots = frame(spark, [("c", x, y) for x, y in zip(xs, ys)], "chrom string, pos long, gpos double")
    got = {r.k: r.gpos for r in lookup.interpolate(probes, knots, width=width).collect()}
    assert all(math.isclose(got[k], np.interp(p, xs, ys), abs_tol=1e-9) for k, p in enumerate(places))


def test_scans_carry_across_buckets(spark):
    rows = frame(spark, [("c", p, 1 if p % 3 else None) for p in range(40)], "chrom string, pos long, v long")
    total = scan.prefix_sum(rows.fillna(0), ["chrom"], "pos", {"s": "v"}, 7).orderBy("pos").collect()
    assert [r.s for r in total] == list(np.cumsum([1 if p % 3 else 0 for p in range(40)]))
    after = scan.neighbour(rows, ["chrom"], "pos", "pos", "n", 7, after=True).orderBy("pos").collect()
    assert [r.n for r in after] == [*range(1, 40), None]
    ordered = scan.ordered_prefix_sum(rows.withColumn("x", F.col("pos") * 7 % 40), "x", ["pos"], {"s": "pos"}).orderBy("x").collect()
    assert [r.s for r in ordered] == list(np.cumsum([r.pos for r in ordered]))


def test_pair_counts_and_letters(spark):
    row = spark.range(1).select(g.het_pairs(F.lit(4), F.lit(1)).alias("het"), g.hom_pairs(F.lit(4), F.lit(1)).alias("hom"), g.pi(F.lit(4), F.lit(1)).alias("pi"), g.haldane(F.lit(0.5)).alias("r"), g.reverse_complement(F.lit("AACG")).alias("rc"), g.amino_acid(F.lit("ATG")).alias("m"), g.amino_acid(F.lit("TAA")).alias("stop"), g.amino_acid(F.lit("ANG")).alias("none"), g.variant_effect(F.lit("TTT"), F.lit("TTC")).alias("s"), g.variant_effect(F.lit("TTT"), F.lit("TTA")).alias("ns"), g.mutation_class(F.lit("G"), F.lit("A")).alias("cls"), g.substitution_code(F.lit("a"), F.lit("-")).alias("c0")).first()
    assert (row.het, row.hom, row.pi, row.rc, row.m, row.stop, row.none, row.s, row.ns, row.cls, row.c0) == (3, 3, 0.5, "CGTT", "M", "*", None, "S", "NS", "CT", 0)
    assert math.isclose(row.r, (1 - math.exp(-1)) / 2)


def test_equal_weight_bins_drop_the_tail(spark):
    rows = frame(spark, [(k, 1) for k in range(10)], "x long, w long")
    got = {r.x: r.bin for r in bins.equal_weight(rows, "x", [], "w", 5).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3}
    count = {r.x: r.bin for r in bins.equal_count(rows, "x", [], 3).collect()}
    assert count == {k: k // 3 for k in range(10)}
    sparse = frame(spark, [("c", k, n) for k, n in enumerate([1, 5, 2, 2, 9, 1])], "chrom string, bin long, n long")
    assert sorted((r.first, r.last, r.n) for r in bins.combine_sparse(sparse, 4, ["chrom"]).collect()) == [(0, 1, 6), (2, 3, 4), (4, 5, 10)]


def segments(spark, p, n=200):
    rng = np.random.default_rng(1)
    rows = [(float(-rng.random()), float(-rng.random()), float(0.01 + 0.01 * rng.random())) for _ in range(n)]
    df = frame(spark, rows, "b1 double, b2 double, nu double")
    het, hom = simulated(F.col("pi"), F.lit(10_000_000))
    return Model(["b1", "b2"]).predict(df, p, "pi").select("b1", "b2", "nu", het.alias("het"), hom.alias("hom"))


def test_gradient_equals_differences_and_fit_finds_the_truth(spark):
    truth = [-0.5, -0.3, 1.2]
    data, model = segments(spark, truth).cache(), Model(["b1", "b2"])
    p, got = [-0.4, -0.5, 1.0], {r.parameter: r.derivative for r in model.gradient(data, [-0.4, -0.5, 1.0]).collect()}
    for k, name in enumerate(("b1", "b2", "tau")):
        up, down = ([*p[:k], p[k] + d, *p[k + 1 :]] for d in (1e-5, -1e-5))
        numeric = (model.log_likelihood(data, up).first().cllh - model.log_likelihood(data, down).first().cllh) / 2e-5
        assert math.isclose(got[name], numeric, rel_tol=1e-4, abs_tol=1e-3)
    fit = model.fit(data, [-0.6, -0.2, 1.0])
    assert np.allclose(fit.parameters, truth, atol=0.05)


def test_optimiser_and_starts():
    fit = nelder_mead(lambda x: float((x[0] - 3) ** 2 + 2 * (x[1] + 1) ** 2), np.array([0.0, 0.0]), 300)
    assert np.allclose(fit.parameters, [3, -1], atol=1e-3)
    assert fit.converged and not nelder_mead(lambda x: float((x[0] - 3) ** 2), np.array([0.0]), 5).converged
    starts = starting_points(4, [0.1, 1.0, 10.0], 5, 2.0)
    assert len(starts) == 15 and all(len(s) == 5 for s in starts) and math.isclose(sum(10**x for x in starts[5][:-1]), 1.0, rel_tol=1e-6)


def test_resampling(spark):
    blocks = resample.numbered(frame(spark, [(k, k + 1, 10) for k in range(8)], "b long, x long, y long"), ["b"], ["x", "y"])
    est = resample.leave_one_out(blocks, "x", "y", "idx")
    values = [(36 - x) / 70 for x in range(1, 9)]
    var = resample.jackknife_variance(est).first()
    assert math.isclose(var.variance, 7 / 8 * sum((x - np.mean(values)) ** 2 for x in values), rel_tol=1e-9)
    reps = [r.estimate for r in resample.bootstrap(blocks, 300, "x", "y").collect()]
    assert len(reps) == 300 and abs(np.mean(reps) - 0.45) < 0.03
    p = resample.permutation(blocks.withColumn("z", F.lit(0)), 200, "x", "z").first()
    assert p.observed == 36 and p.p < 0.05


def test_kernel_sum_equals_brute_force(spark):
    rng = random.Random(5)
    grid, src = [rng.randrange(300) for _ in range(25)], [rng.randrange(300) for _ in range(40)]
    got = maps.kernel_sum(frame(spark, [("c", x) for x in grid], "chrom string, pos long"), frame(spark, [("c", x) for x in src], "chrom string, pos long"), 20, F.exp(-F.col("dist") / 5.0))
    for r in got.collect():
        near = [abs(r.pos - s) for s in src if abs(r.pos - s) <= 20]
        assert r.sources == len(near) and math.isclose(r.total, sum(math.exp(-d / 5) for d in near), abs_tol=1e-12)


def test_smoothing(spark):
    rows = frame(spark, [("c", k, float(2 * k * k - k)) for k in range(12)], "chrom string, win long, y double")
    poly = {r.win: r.smooth for r in smooth.polynomial(rows, 5, 2, ["chrom"], "win", "y").collect()}
    assert all(math.isclose(poly[k], 2 * k * k - k, abs_tol=1e-8) for k in range(2, 10))
    local = {r.win: r.smooth for r in smooth.local_regression(rows, 0.5, ["chrom"], "win", "y").collect()}
    assert all(math.isclose(local[k], 2 * k * k - k, abs_tol=1e-6) for k in range(12))
    assert np.allclose(smooth.polynomial_weights(5, 2), np.array([-3, 12, 17, 12, -3]) / 35)


def test_filled_windows_and_signed_rank(spark):
    sites = frame(spark, [("c", 1, 1), ("c", 2, 0), ("c", 25, 1)], "chrom string, pos long, hit long")
    grid = frame(spark, [("c", 0, 3)], "chrom string, first long, last long")
    got = {r.window: (r.bases, r.subs, r.rate) for r in stats.windows_filled(sites, grid, 10, ["chrom"], "pos", F.col("hit") > 0).collect()}
    assert got == {0: (2, 1, 0.5), 1: (0, 0, 0.75), 2: (1, 1, 1.0), 3: (0, 0, 1.0)}
    pairs = frame(spark, [(1, 5, 1), (2, 1, 2), (3, 4, 4), (4, 0, 3)], "k long, a long, b long")
    r = stats.signed_rank(pairs, "a", "b", ["k"]).first()
    assert (r.w, r.n) == (-1 - 2 + 3, 3)


def scans(df):
    """How often the executed plan reads a table, and how long planning took."""
    import time

    start = time.perf_counter()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Scan" in line for line in plan.splitlines()), time.perf_counter() - start


def test_sets_read_each_input_once_and_overlays_plan_linearly(spark, tmp_path):
    path = str(tmp_path / "iv")
    spans(spark, [(k, k + 5) for k in range(0, 300, 7)]).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    assert scans(iv.subtract(read(), read(), width=64))[0] == 2
    step = lambda k: read().select("chrom", "start", (F.col("end") * float(k)).alias("value"))
    few, many = (scans(iv.overlay({f"m{k}": step(k) for k in range(n)}, width=64)) for n in (6, 12))
    assert many[0] <= 2 * few[0] and many[1] < 2
    assert scans(lookup.nearest(read().withColumnRenamed("start", "pos"), read().withColumnRenamed("start", "pos")))[0] <= 6


def test_hot_values_are_cut_by_ties(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).cast("long").alias("x"), F.col("id").alias("t"))
    parts = scan.range_parts(rows, "x", ["t"])
    assert parts.groupBy("__part").count().agg(F.max("count")).first()[0] < 2_000
    got = scan.ordered_prefix_sum(rows.withColumn("one", F.lit(1)), "x", ["t"], {"k": "one"}).orderBy("x", "t").collect()
    assert [r.k for r in got] == list(range(1, 20_001))


def test_rle_joins_across_buckets_and_not_across_gaps_of_runs(spark):
    rng = random.Random(8)
    values = [float(rng.randint(0, 1)) for _ in range(60)]
    rows = frame(spark, [("c", k, k + 1, x) for k, x in enumerate(values)], "chrom string, start long, end long, value double")
    want = [k for k in range(60) if not k or values[k] != values[k - 1]]
    for width in (1, 2, 3, 7, 100):
        got = sorted((r.start, r.end, r.value) for r in iv.rle(rows, width=width).collect())
        assert got == [(a, b, values[a]) for a, b in zip(want, [*want[1:], 60])]
