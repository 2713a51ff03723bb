"""Folds against row-by-row passes, with buckets so narrow that many are crossed."""

import random

import pytest

from segspark.operators import folds


def kept_by_rows(features):
    out = []
    for s, e, x in sorted(set(features)):
        if not out or s >= out[-1][1]:
            out.append((s, e, x))
        elif e - s > out[-1][1] - out[-1][0]:
            out[-1] = (max(s, out[-2][1] + 1) if len(out) > 1 else s, e, x)
    return out


@pytest.mark.parametrize("reach,count,longest", [(400, 300, 12), (400, 300, 90), (60, 200, 9), (2000, 40, 5)])
def test_longer_features(spark, reach, count, longest):
    draw, rows = random.Random(reach + longest), []
    for chrom in ("a", "b", None):
        for _ in range(count):
            start = draw.randrange(reach)
            rows.append((chrom, start, start + draw.randrange(longest), float(draw.randrange(3))))
    rows += [("a", 5, 4, 1.0), ("a", None, 4, 1.0), ("a", 5, 9, None)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, score double")
    for width in (7, 50, 1 << 20):
        got = [tuple(r) for r in folds.longer_kept(df, width=width).collect()]
        for chrom in "ab":
            own = [(s, e, x) for c, s, e, x in rows if c == chrom and None not in (s, e, x) and s <= e]
            assert sorted(g[1:] for g in got if g[0] == chrom) == kept_by_rows(own)
        assert {g[0] for g in got} == {"a", "b"}
    assert folds.longer_kept(df.limit(0)).count() == 0


def test_features_that_share_a_place(spark):
    rows = [(1, 10, 1.0), (10, 12, 2.0), (10, 14, 3.0), (10, 15, 4.0), (14, 15, 5.0), (30, 31, 6.0)]
    df = spark.createDataFrame([("a", *r) for r in rows], "chrom string, start long, end long, score double")
    want = [(1, 10, 1.0), (11, 15, 4.0), (30, 31, 6.0)]
    assert kept_by_rows(rows) == want
    for width in (1, 3, 10, 100):
        assert sorted(tuple(r)[1:] for r in folds.longer_kept(df, width=width).collect()) == want


def test_blocks_tile_a_key(spark):
    kept = spark.createDataFrame([("a", 3, 4, 2.0), ("a", 5, 6, 4.0), ("a", 9, 9, 8.0)], "chrom string, start long, end long, score double")
    lengths = spark.createDataFrame([("a", 11), ("b", 4)], "chrom string, length long")
    got = sorted(tuple(r)[1:] for r in folds.rate_blocks(kept, lengths, 0.5, width=4).collect())
    assert got == [(1, 2, 1.0, 0.0, 1.0), (3, 4, 1.0, 2.0, 3.0), (5, 6, 2.0, 4.0, 6.0), (7, 8, 3.0, 8.0, 11.0), (9, 9, 4.0, 14.0, 14.0), (10, 11, 4.0, 18.0, 22.0)]


def test_changed_against_the_last_kept(spark):
    draw, rows = random.Random(3), []
    for chrom, step in (("walk", 0.1), ("zeros", 0.0), ("up", None)):
        x = 1.0
        for pos in range(500):
            x = x * 1.01 if step is None else x + draw.choice((-step, 0, step)) if step else float(draw.choice((0, 0, 1, -2)))
            rows.append((chrom, pos, x))
    df = spark.createDataFrame([*rows, ("walk", 1000, None), ("walk", None, 1.0), ("up", 1001, float("nan"))], "chrom string, pos long, x double")
    want, held = [], {}
    for c, p, x in rows:
        last = held.get(c)
        if last is None or x != last and (last == 0 or abs(x - last) > 0.3 * abs(last)):
            want.append((c, p))
            held[c] = x
    for width in (9, 64, 1 << 20):
        assert sorted((r.chrom, r.pos) for r in folds.changed(df, 0.3, "x", width=width).collect()) == sorted(want)


def test_spaced_over_many_buckets(spark):
    draw, step = random.Random(5), 2048
    places = sorted(draw.randrange(40 << 20) for _ in range(3000)) + [41 << 20, (41 << 20) + step - 1, (41 << 20) + step]
    want, last = [], None
    for p in places:
        if last is None or p - last >= step:
            want.append(p)
            last = p
    df = spark.createDataFrame([(k, p, float(i)) for k in ("a", "b") for i, p in enumerate([*places, places[0]])] + [("a", None, 1.0), (None, 3, 1.0)], "chrom string, pos long, gpos double")
    got = folds.spaced(df, step).collect()
    assert sorted(r.pos for r in got if r.chrom == "a") == want == sorted(r.pos for r in got if r.chrom == "b")
