"""Smaller operators composed of the others: blocks by bins, coalescence times, arms, thinning, corrections, synthetic intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators import folds, scan


def coalescence_time(b: Column, starts: list[float], sizes: list[float], ploidy: float = 2.0) -> Column:
    """Expected time to the common ancestor of a pair where effective size is ``sizes[k] * b`` from ``starts[k]`` generations on; the last
    epoch has no end. A sum of one term an epoch, so it stays in generated code."""
    total, survived = F.lit(0.0), F.lit(1.0)
    for k, (start, size) in enumerate(zip(starts, sizes)):
        scale = F.lit(ploidy * size) * b
        if k + 1 < len(starts):
            lasts = F.exp(-F.lit(float(starts[k + 1] - start)) / scale)
            total = total + survived * (scale + start - lasts * (scale + starts[k + 1]))
            survived = survived * lasts
        else:
            total = total + survived * (scale + start)
    return total


def blocks_by_bins(sites: DataFrame, block: Column, bin_: Column, sums: list[str], by: list[str] = []) -> DataFrame:
    """Counts and sums of sites in each block and bin: what bootstraps over blocks start from."""
    return sites.groupBy(*by, block.cast("long").alias("block"), bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums])


def arm_position(points: DataFrame, centromeres: DataFrame, by: list[str] = ["chrom"], pos: str = "pos") -> DataFrame:
    """Add telomere: the distance to the nearer end, and arm: the share of the arm that lies between the centromere's middle and the point.
    ``centromeres``: one row a key with start, end and the key's length."""
    rows = points.join(F.broadcast(centromeres.select(*by, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("length").alias("__l"))), by)  # one row a key
    middle = (F.col("__s") + F.col("__e")) / 2.0
    arm = F.when(F.col(pos) < middle, (middle - F.col(pos)) / middle).otherwise((F.col(pos) - middle) / (F.col("__l") - middle))
    return rows.withColumn("telomere", F.least(F.col(pos), F.col("__l") - F.col(pos))).withColumn("arm", arm).drop("__s", "__e", "__l")


def changed_from_previous(rows: DataFrame, share: float, value: str, by: list[str] = ["chrom"], pos: str = "pos", width: int = 1 << 20) -> DataFrame:
    """Rows whose value differs from the row before by more than ``share`` of that; the first row of each key, and any change from or to
    zero, count as changed."""
    rows = scan.neighbour(rows, by, pos, value, "__prev", width)
    before, now = F.col("__prev"), F.col(value)
    changed = before.isNull() | ((before != now) & ((before == 0) | (F.abs(now - before) > share * F.abs(before))))
    return rows.where(changed).drop("__prev")


def changed_from_kept(rows: DataFrame, share: float, value: str, by: list[str] = ["chrom"], pos: str = "pos", width: int = 1 << 20) -> DataFrame:
    """The same against the last row kept."""
    return folds.changed(rows, share, value, by, pos, width)


def jukes_cantor(share: Column) -> Column:
    """Substitutions a site from the share of sites that differ; null where the share is 3/4 or more."""
    return F.when(share < 0.75, -0.75 * F.log(1.0 - 4.0 * share / 3.0))


def rates_by_class(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per class of change (from, to, count) its share of the counts from that base and its partner, strands folded, one column a class."""
    from segspark.functions.genetics import mutation_class

    changes = ["AC", "AG", "AT", "CA", "CG", "CT"]
    folded = counts.withColumn("cls", mutation_class(F.col("from"), F.col("to"))).withColumn("base", F.substring("cls", 1, 1))
    sums = folded.groupBy(*by).agg(*[F.sum(F.when(F.col("base") == b, F.col("count")).otherwise(0)).alias(f"__{b}") for b in "AC"], *[F.sum(F.when(F.col("cls") == c, F.col("count")).otherwise(0)).alias(c) for c in changes])
    return sums.select(*by, *[(F.col(c).cast("double") / F.col(f"__{c[0]}").cast("double")).alias(c) for c in changes])


def without_smallest(intervals: DataFrame, share: float) -> DataFrame:
    """Intervals not shorter than the ``share`` quantile of the lengths."""
    length = F.col("end") - F.col("start")
    cut = intervals.agg(F.percentile(length, share).alias("__cut"))
    return intervals.crossJoin(F.broadcast(cut)).where(length >= F.col("__cut")).drop("__cut")  # one row


def synthetic_intervals(bounds: DataFrame, count: int, length: int, seed: int = 1) -> DataFrame:
    """``count`` intervals of ``length`` a key at hashed places within (key, start, end); the same for the same seed."""
    rows = bounds.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(count))))
    room = F.greatest(F.col("end") - F.col("start") - length, F.lit(1))
    at = F.col("start") + F.pmod(F.xxhash64(F.lit(seed), "chrom", "__k"), room)
    return rows.select("chrom", at.alias("start"), (at + length).alias("end"))


def adaptive_grid(points: DataFrame, slope: Column, tolerance: float, longest: int) -> DataFrame:
    """For each interval (key, start, end) the grid whose step keeps the change under ``tolerance`` at the given slope, at most ``longest``."""
    step = F.greatest(F.lit(1), F.least(F.lit(longest), F.floor(F.lit(tolerance) / F.greatest(F.abs(slope), F.lit(1e-300))).cast("long")))
    return points.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1, step)).alias("pos"))


def covering_sources(pairs: DataFrame, by: list[str], weight: str, share: float = 0.98) -> DataFrame:
    """Per grid point the share of its sources, heaviest first, that make up ``share`` of the sum."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc(weight), "source")
    rows = pairs.withColumn("__before", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)).withColumn("__all", F.sum(weight).over(Window.partitionBy(*by)))
    return rows.groupBy(*by).agg(F.avg((F.col("__before") < share * F.col("__all")).cast("double")).alias("share"))


def window_sizes(windows: DataFrame, by: list[str] = []) -> DataFrame:
    """Mean, standard deviation and mean relative error of the physical size of windows of constant count."""
    size = (F.col("end") - F.col("start")).cast("double")
    return windows.groupBy(*by).agg(F.avg(size).alias("mean"), F.stddev_pop(size).alias("sd"), (F.stddev_pop(size) / F.avg(size)).alias("relative"))


def rebinned(bins: DataFrame, size: int, order: str, count: str, by: list[str]) -> DataFrame:
    """Greedy: bins in order are gathered until their counts reach ``size``, then a new bin is begun. One group a key, of bins not data."""
    import pandas as pd

    kinds = ", ".join(f"{b} {bins.schema[b].dataType.simpleString()}" for b in by)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, first = [], 0, None
        pdf = pdf.sort_values(order)
        for b, n in zip(pdf[order].tolist(), pdf[count].tolist()):
            first = b if first is None else first
            held += n
            if held >= size:
                out.append((first, b, held))
                held, first = 0, None
        if first is not None:
            out.append((first, b, held))
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], *o] for o in out], columns=[*by, "first", "last", "n"])

    return bins.groupBy(*by).applyInPandas(fold, f"{kinds}, first long, last long, n long")
