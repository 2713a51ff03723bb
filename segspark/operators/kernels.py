"""Sums of a kernel from all weighted places to all grid points, without a fixed reach and without making all pairs.

``smooth_sum`` takes any kernel that is smooth away from zero. The axis is cut into buckets, and these into halves upon halves: level l has
buckets of ``width`` 2^l. A bucket's sources are replaced by weights at a few Chebyshev nodes. Buckets that don't touch, but whose
parents do, meet once at their level: sources' nodes to targets' nodes. A grid point gets the values at its own bucket's nodes,
interpolated, and the sources in its own bucket and the two beside it one by one. So there are three joins of small tables, whatever the
number of levels: a level halves the buckets, each meets three others. Two buckets that meet lie at least one width apart, so
interpolation at P nodes errs by about (3 + sqrt 8)^-P of the kernel's largest value, which is how ``tolerance`` sets P.
Nodes pay only where buckets hold more points than nodes, so the finest buckets are doubled for as long as that makes fewer rows.

``exponential_sum`` is exact for exp(-rate distance): two running sums, carried over the buckets that still count.

Rows with a null key, place or weight are left out; grid points are distinct; a grid without sources gets zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RATIO = 3 + math.sqrt(8)


def _bucket(pos: Column, width: float) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")


def _weighed(sources: DataFrame, by: list[str], pos: str, weight: str | None) -> DataFrame:
    """Distinct places with the sum of their weights, so that a hot place is one row."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return sources.where(F.col(pos).isNotNull() & w.isNotNull()).groupBy(*by, F.col(pos).cast("double").alias("__y")).agg(F.sum(w).alias("__w"))


def _angles(nodes: int) -> Column:
    return F.array(*[F.lit(math.pi * (k + 0.5) / nodes) for k in range(nodes)])


def _place(bucket: Column, level: Column, width: float, angle: Column) -> Column:
    """Where the node at ``angle`` of a bucket lies."""
    return (bucket + 0.5 + 0.5 * F.cos(angle)) * F.lit(width) * F.pow(F.lit(2.0), level)


def _share(place: Column, bucket: Column, level: Column, width: float, angle: Column, nodes: int) -> Column:
    """The value at ``place`` of the interpolating polynomial that is 1 at the bucket's node at ``angle`` and 0 at its others: 2 / nodes times
    1/2 + sum of cos(k x) cos(k angle) for k below ``nodes``, whose cosines sum up in closed form, so that the expression stays small."""
    x = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * (place / (F.lit(width) * F.pow(F.lit(2.0), level)) - bucket) - 1.0)))

    def summed(turn: Column) -> Column:
        return F.when(F.abs(turn) < 1e-12, F.lit(nodes - 0.5)).otherwise(F.sin((nodes - 0.5) * turn) / (2.0 * F.sin(0.5 * turn)))

    return (summed(x - angle) + summed(x + angle)) / float(nodes)


def nodes_for(tolerance: float) -> int:
    """Nodes a bucket for an error of about ``tolerance`` of the kernel's largest value times the sources' weight."""
    return max(4, math.ceil(math.log(8 / tolerance) / math.log(_RATIO)))


def smooth_sum(grid: DataFrame, sources: DataFrame, kernel: Callable[[Column], Column], width: float, tolerance: float = 1e-9, weight: str | None = None, by: list[str] = ["chrom"], pos: str = "pos", coarser: bool = True) -> DataFrame:
    """(key, pos, total): for each distinct grid point the sum over all sources of its key of weight times ``kernel`` of the distance.

    ``width``: the finest bucket; pairs are made within three of them. It is doubled while that makes fewer rows of pairs and nodes, unless
    ``coarser`` is False. Two aggregates find the ends of the axis and the rows of each level.
    """
    nodes = nodes_for(tolerance)
    points = _weighed(sources, by, pos, weight).withColumn("__b", _bucket(F.col("__y"), width))
    grid = grid.where(F.col(pos).isNotNull()).select(*by, pos).distinct().withColumns({"__x": F.col(pos).cast("double"), "__b": _bucket(F.col(pos), width)})
    ends = points.agg(F.min("__b").alias("low"), F.max("__b").alias("high")).union(grid.agg(F.min("__b"), F.max("__b"))).agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    low, high = ends.low or 0, ends.high or 0
    levels = next(k for k in range(64) if (high >> k) - (low >> k) <= 1)  # from here on all buckets touch
    if coarser and levels:
        finest = _finest(grid, points, by, nodes, levels)
        width, levels = width * 2.0**finest, levels - finest
        points, grid = points.withColumn("__b", _bucket(F.col("__y"), width)), grid.withColumn("__b", _bucket(F.col("__x"), width))
    near = _near(grid, points, kernel, by, pos)
    if levels:
        far = _far(grid, points, kernel, width, nodes, levels, by)
        at = F.array_sort(F.collect_list(F.struct("__a", "__v")))  # the nodes of one bucket
        values = far.groupBy(*by, "__b").agg(at.alias("__values"))
        total = F.aggregate("__values", F.lit(0.0), lambda t, v: t + v["__v"] * _share(F.col("__x"), F.col("__b"), F.lit(0), width, v["__a"], nodes))
        near = near.unionByName(grid.join(values, [*by, "__b"]).select(*by, pos, total.alias("__t")))
    return near.groupBy(*by, pos).agg(F.sum("__t").alias("total"))


def _finest(grid: DataFrame, points: DataFrame, by: list[str], nodes: int, levels: int) -> int:
    """The level whose buckets, taken as the finest, make fewest rows: pairs of grid points and sources in three buckets, and pairs of nodes,
    those of a bucket with sources at each level above, those of a bucket with grid points from three others and down again."""
    none = F.lit(0).cast("long")
    both = grid.select(*by, "__b", F.lit(1).cast("long").alias("g"), none.alias("p")).unionByName(points.select(*by, "__b", none.alias("g"), F.lit(1).cast("long").alias("p")))
    held = both.groupBy(*by, "__b").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("l")
    held = held.select(*by, "__b", "g", "p", level).groupBy(*by, "l", F.floor(F.col("__b") / F.pow(F.lit(2.0), "l")).alias("__b")).agg(F.sum("g").cast("double").alias("g"), F.sum("p").cast("double").alias("p"))
    found = held.groupBy("l").agg(F.sum(F.col("g") * F.col("p")).alias("pairs"), F.sum((F.col("p") > 0).cast("long")).alias("from"), F.sum((F.col("g") > 0).cast("long")).alias("to"), F.sum("p").alias("points")).collect()  # a row a level
    at = {r.l: r for r in found}

    def rows(k: int) -> float:
        if k not in at:
            return 0.0
        above = range(k, levels)
        far = at[k].points * nodes + nodes**2 * (levels - k) * (at[k]["from"] + at[k].to) + 3 * nodes**2 * sum(at[j].to for j in above)
        return 3 * at[k].pairs + (far if k < levels else 0.0)

    return min(range(levels + 1), key=rows)


def _near(grid: DataFrame, points: DataFrame, kernel: Callable[[Column], Column], by: list[str], pos: str) -> DataFrame:
    beside = grid.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
    sums = beside.join(points, [*by, "__b"]).groupBy(*by, pos).agg(F.sum(F.col("__w") * kernel(F.abs(F.col("__x") - F.col("__y")))).alias("__t"))
    return sums.unionByName(grid.select(*by, pos, F.lit(0.0).alias("__t")))


def _far(grid: DataFrame, points: DataFrame, kernel: Callable[[Column], Column], width: float, nodes: int, levels: int, by: list[str]) -> DataFrame:
    """(key, __b, __a, __v): what far sources give at the nodes of each finest bucket that holds grid points."""
    b, level, angle, fine = F.col("__b"), F.col("__l"), F.col("__a"), F.lit(0)
    ranks = F.sequence(F.lit(0), F.lit(levels - 1))
    up = F.floor(b / F.pow(F.lit(2.0), level)).cast("long")
    # the finest buckets' nodes stand for their sources at all levels
    first = points.withColumn("__a", F.explode(_angles(nodes))).groupBy(*by, "__b", "__a").agg(F.sum(F.col("__w") * _share(F.col("__y"), b, fine, width, angle, nodes)).alias("__w"))
    first = first.select(*by, _place(b, fine, width, angle).alias("__y"), "__w", "__b")
    upper = first.withColumn("__l", F.explode(ranks)).select(*by, "__l", up.alias("__b"), "__y", "__w").withColumn("__a", F.explode(_angles(nodes)))
    held = upper.groupBy(*by, "__l", "__b", "__a").agg(F.sum(F.col("__w") * _share(F.col("__y"), b, level, width, angle, nodes)).alias("__w"))
    held = held.select(*by, "__l", F.col("__b").alias("__s"), _place(b, level, width, angle).alias("__y"), "__w")
    # buckets with grid points meet those that don't touch them but whose parents touch theirs
    mine = grid.select(*by, "__b").distinct().withColumn("__l", F.explode(ranks))
    targets = mine.select(*by, "__l", up.alias("__b")).distinct()
    parents = F.floor(b / 2.0).cast("long")
    others = F.filter(F.sequence(2 * parents - 2, 2 * parents + 3), lambda s: F.abs(s - b) >= 2)
    met = targets.withColumn("__s", F.explode(others)).join(held, [*by, "__l", "__s"]).withColumn("__a", F.explode(_angles(nodes)))
    given = met.groupBy(*by, "__l", "__b", "__a").agg(F.sum(F.col("__w") * kernel(F.abs(_place(b, level, width, angle) - F.col("__y")))).alias("__v"))
    given = given.withColumnsRenamed({"__b": "__up", "__a": "__from"})
    # down to the finest buckets in one step
    asked = mine.withColumn("__up", up)
    below = asked.join(given, [*by, "__l", "__up"]).withColumn("__a", F.explode(_angles(nodes)))
    share = _share(_place(b, fine, width, angle), F.col("__up"), level, width, F.col("__from"), nodes)
    return below.groupBy(*by, "__b", "__a").agg(F.sum(F.col("__v") * share).alias("__v"))


def exponential_sum(grid: DataFrame, sources: DataFrame, rate: float, weight: str | None = None, by: list[str] = ["chrom"], pos: str = "pos", width: float | None = None) -> DataFrame:
    """(key, pos, total): for each distinct grid point the sum over all sources of its key of weight times exp(-rate distance), to double
    precision. Buckets of ``width`` (4 / rate) are summed up; sums count as far as exp(-rate distance) is above 1e-17."""
    width = width or 4.0 / rate
    reach = math.ceil(math.log(1e17) / (rate * width)) + 1
    points = _weighed(sources, by, pos, weight).withColumn("__b", _bucket(F.col("__y"), width))
    within = (F.col("__y") - F.col("__b") * width) * rate  # from the bucket's start
    points = points.withColumns({"__up": F.col("__w") * F.exp(within), "__down": F.col("__w") * F.exp(-within)})
    held = points.groupBy(*by, "__b").agg(F.sum("__up").alias("__up"), F.sum("__down").alias("__down"))
    steps = F.sequence(F.lit(1), F.lit(reach))
    moved = held.withColumn("__k", F.explode(F.concat(steps, F.transform(steps, lambda k: -k)))).withColumn("__f", F.exp(-rate * width * F.abs("__k")))
    carried = moved.groupBy(*by, (F.col("__b") + F.col("__k")).alias("__b")).agg(
        F.sum(F.when(F.col("__k") > 0, F.col("__up") * F.col("__f")).otherwise(0.0)).alias("__before"), F.sum(F.when(F.col("__k") < 0, F.col("__down") * F.col("__f")).otherwise(0.0)).alias("__after")
    )
    grid = grid.where(F.col(pos).isNotNull()).select(*by, pos).distinct().withColumns({"__y": F.col(pos).cast("double"), "__b": _bucket(F.col(pos), width)})
    rows = points.select(*by, "__b", "__y", "__up", "__down", F.lit(None).cast(grid.schema[pos].dataType).alias(pos)).unionByName(grid.withColumns({"__up": F.lit(0.0), "__down": F.lit(0.0)}))
    order = Window.partitionBy(*by, "__b").orderBy("__y")
    upto = F.sum("__up").over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.sum("__down").over(Window.partitionBy(*by, "__b").orderBy(F.desc("__y")).rangeBetween(Window.unboundedPreceding, 0)) - F.sum("__down").over(Window.partitionBy(*by, "__b", "__y"))
    rows = rows.withColumns({"__upto": upto, "__past": after}).where(F.col(pos).isNotNull())
    rows = rows.join(carried, [*by, "__b"], "left")
    before, later = F.col("__upto") + F.coalesce("__before", F.lit(0.0)), F.col("__past") + F.coalesce("__after", F.lit(0.0))
    return rows.select(*by, pos, (before * F.exp(-within) + later * F.exp(within)).alias("total"))
