"""Kernel sums from selected places to grid points, and maps built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators import intervals, kernels, scan


def kernel_sum(grid: DataFrame, sources: DataFrame, reach: int, kernel: Column, by: list[str] = ["chrom"], pos: str = "pos", width: int | None = None) -> DataFrame:
    """For each grid point the sum of ``kernel`` (of the column dist) over sources at most ``reach`` away, and how many there are.

    Grid points become intervals of 2 reach + 1 and meet sources in a bucketed equi-join; each point reaches two or three buckets.
    Repeated sources are summed once with a weight, so a hot place is one row.
    """
    width = width or 2 * reach + 1
    weighed = sources.groupBy(*by, pos).agg(F.count("*").alias("__w"))
    points = weighed.withColumn("__b", F.floor(F.col(pos) / width)).withColumnRenamed(pos, "__src")
    grid = grid.select(*by, pos).distinct()
    near = grid.withColumn("__b", F.explode(F.sequence(F.floor((F.col(pos) - reach) / width), F.floor((F.col(pos) + reach) / width))))
    pairs = near.join(points, [*by, "__b"]).where(F.abs(F.col(pos) - F.col("__src")) <= reach).withColumn("dist", F.abs(F.col(pos) - F.col("__src")))
    sums = pairs.groupBy(*by, pos).agg(F.sum("__w").alias("sources"), F.sum(kernel * F.col("__w")).alias("total"))
    return grid.join(sums, [*by, pos], "left").fillna(0, ["sources", "total"])


def thinned_grid(sites: DataFrame, delta: float, by: list[str] = ["chrom"], gpos: str = "gpos", width: float | None = None) -> DataFrame:
    """Of sites along a map, those next to a multiple of ``delta`` (counted from the first site), on either side, with the first and the last:
    between two of them that follow each other lies no third that is further than ``delta`` from both. Sites at equal distances are one,
    that of least place ``pos``. Neighbours are found in buckets, so a key needs no task of its own."""
    width = width or 4096 * delta
    rows = sites.where(F.col(gpos).isNotNull()).groupBy(*by, gpos).agg(F.min("pos").alias("pos"))
    first = rows.groupBy(*by).agg(F.min(gpos).alias("__first"))
    rows = rows.join(F.broadcast(first), by).withColumn("__cell", F.floor((F.col(gpos) - F.col("__first")) / delta).cast("long")).drop("__first")  # a row a key
    rows = scan.neighbour(rows, by, gpos, "__cell", "__next", width, after=True)
    rows = scan.neighbour(rows, by, gpos, "__cell", "__prev", width)
    kept = F.col("__next").isNull() | F.col("__prev").isNull() | (F.col("__next") != F.col("__cell")) | (F.col("__prev") != F.col("__cell"))
    return rows.where(kept).drop("__cell", "__next", "__prev")


def sweep_map(sites: DataFrame, substitutions: DataFrame, s: float, population: float, delta: float | None = None, by: list[str] = ["chrom"]) -> DataFrame:
    """(key, pos, gpos, rate): the rate at which sweeps of strength ``s`` at substitutions (key, gpos) make lines coalesce, on a thinned grid of
    the sites (key, pos, gpos): exp(-distance * time of a sweep), summed over all substitutions. Default ``delta``: s / 100, 3e-8 at least."""
    grid = thinned_grid(sites, delta or max(s * 0.01, 3e-8), by)
    sums = kernels.exponential_sum(grid, substitutions, g.sweep_time(s, population), by=by, pos="gpos")
    return grid.join(sums.withColumnRenamed("total", "rate"), [*by, "gpos"]).select(*by, "pos", "gpos", "rate")


def composite(segments: DataFrame, log_b: Column, scale: int = 1000, by: list[str] = ["chrom"]) -> DataFrame:
    """Run-length map of B as integers from 0 to ``scale``: floor(B scale + 0.5), equal neighbours joined."""
    value = F.floor(F.exp(log_b) * scale + 0.5).cast("long")
    return intervals.rle(segments.select(*by, "start", "end", value.alias("value")), by)


def conserved_per_bin(steps: dict[str, DataFrame], width: float, by: list[str] = ["chrom"], pos: str = "gpos") -> DataFrame:
    """Counts of several point sets in bins of map distance, side by side; bins without any are left out."""
    union = None
    for name in steps:
        part = steps[name].select(*by, F.floor(F.col(pos) / width).cast("long").alias("bin"), *[F.lit(int(n == name)).alias(n) for n in steps])
        union = part if union is None else union.unionByName(part)
    return union.groupBy(*by, "bin").agg(*[F.sum(n).alias(n) for n in steps])
