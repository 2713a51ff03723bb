"""Windows and bins over segments: fixed, sliding, moving, equal weight, equal count, by value edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators import scan


def by_window(window: Column, rows: DataFrame, by: list[str], weight: str = "sites") -> DataFrame:
    """Observed diversity, weighted prediction and weight of each window."""
    w = F.col(weight).cast("double")
    return rows.groupBy(*by, window.cast("long").alias("win")).agg(
        (F.sum("het").cast("double") / F.sum(F.col("het") + F.col("hom")).cast("double")).alias("obs"),
        (F.sum(F.col("pred") * w) / F.sum(w)).alias("pred"),
        F.sum(weight).alias("n"),
    )


def fixed(segments: DataFrame, scale: int, by: list[str] = ["chrom"], upper: str = "pos") -> DataFrame:
    """Windows of ``scale``; a segment is in the window of its upper edge, an edge on a boundary in the next."""
    return by_window(F.floor(F.col(upper) / scale), segments, by)


def dense(windows: DataFrame, share: float = 0.2) -> DataFrame:
    """Windows with more than ``share`` of the mean weight."""
    mean = windows.agg(F.avg("n").alias("__m"))
    return windows.crossJoin(F.broadcast(mean)).where(F.col("n") > share * F.col("__m")).drop("__m")  # one row


def sliding(segments: DataFrame, step: int, by: list[str] = ["chrom"], upper: str = "pos") -> DataFrame:
    """Windows two steps wide, one a step: each segment is in two."""
    at = F.floor(F.col(upper) / step)
    return by_window(F.col("__w"), segments.withColumn("__w", F.explode(F.array(at - 1, at))).where("__w >= 0"), by)


def moving_average(points: DataFrame, value: str, width: int, step: int, share: float = 0.05, by: list[str] = ["chrom"], pos: str = "pos") -> DataFrame:
    """Mean of the values in [k step, k step + width) for each k that holds any; null below ``share`` of the mean count."""
    last = F.floor(F.col(pos) / step)
    first = F.greatest(F.floor((F.col(pos) - width) / step) + 1, F.lit(0))
    rows = points.withColumn("__k", F.explode(F.sequence(first, last))).groupBy(*by, F.col("__k").cast("long").alias("win"))
    rows = rows.agg(F.count("*").alias("n"), F.avg(value).alias("__v"))
    mean = rows.agg(F.avg("n").alias("__m"))
    return rows.crossJoin(F.broadcast(mean)).select(*by, "win", "n", F.when(F.col("n") >= share * F.col("__m"), F.col("__v")).alias("mean"))  # one row


def equal_weight(rows: DataFrame, order: str, ties: list[str], weight: str, bins: int) -> DataFrame:
    """Add bin: rows sorted by ``order`` and cut where the cumulated weight passes multiples of int(total / bins). A row whose cumulated
    weight reaches an edge opens the next bin; what lies from the last edge below the total on is dropped."""
    ordered = scan.ordered_prefix_sum(rows, order, ties, {"__upto": weight})
    total = rows.agg(F.sum(weight).alias("__total"))
    ordered = ordered.crossJoin(F.broadcast(total)).withColumn("__size", F.floor(F.col("__total") / bins))  # one row
    # Edges are the multiples of size below the total; an index range ends before the first row that reaches its edge.
    edges = F.floor((F.col("__total") - 1) / F.col("__size"))
    return ordered.withColumn("bin", F.floor(F.col("__upto") / F.col("__size")).cast("long")).where(F.col("bin") < edges).drop("__upto", "__total", "__size")


def equal_count(rows: DataFrame, order: str, ties: list[str], bins: int) -> DataFrame:
    """Add bin: int(rows / bins) rows each in sorted order; a remainder makes one bin more."""
    ordered = scan.ordered_prefix_sum(rows.withColumn("__one", F.lit(1)), order, ties, {"__upto": "__one"})
    total = rows.agg(F.floor(F.count("*") / bins).alias("__size"))
    return ordered.crossJoin(F.broadcast(total)).withColumn("bin", F.floor((F.col("__upto") - 1) / F.col("__size")).cast("long")).drop("__upto", "__one", "__size")  # one row


def by_edges(value: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are at or below the value: 0 before the first."""
    at = F.lit(0)
    for e in edges:
        at = at + (value >= F.lit(e)).cast("int")
    return at


def top_fraction(rows: DataFrame, order: str, ties: list[str], weight: str, share: float) -> DataFrame:
    """Rows whose cumulated weight, in ascending order, is above 1 - share of the total."""
    ordered = scan.ordered_prefix_sum(rows, order, ties, {"__upto": weight})
    total = rows.agg(F.sum(weight).alias("__total"))
    return ordered.crossJoin(F.broadcast(total)).where(F.col("__upto") > (1 - share) * F.col("__total")).drop("__upto", "__total")  # one row


def collated(distances: DataFrame, width: float, values: list[str], distance: str = "distance") -> DataFrame:
    """Sums of values and counts in bins of signed distance."""
    rows = distances.where(F.col(distance).isNotNull())
    return rows.groupBy(F.floor(F.col(distance) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])


def combine_sparse(bins: DataFrame, least: int, by: list[str], order: str = "bin", count: str = "n") -> DataFrame:
    """Greedy: bins in order are joined until they hold at least ``least``; a last rest goes to the bin before. One group a key, as each
    join depends on the one before; there are as many rows as bins, not as data."""
    import pandas as pd

    kinds = ", ".join(f"{b} {bins.schema[b].dataType.simpleString()}" for b in by)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        open_ = None
        for b, n in pdf.sort_values(order)[[order, count]].itertuples(index=False):
            open_ = [b, b, n] if open_ is None else [open_[0], b, open_[2] + n]
            if open_[2] >= least:
                out.append(open_)
                open_ = None
        if open_ is not None:
            if out:
                out[-1][1], out[-1][2] = open_[1], out[-1][2] + open_[2]
            else:
                out.append(open_)
        head = [pdf[b].iloc[0] for b in by]
        return pd.DataFrame([[*head, *o] for o in out], columns=[*by, "first", "last", "n"])

    return bins.groupBy(*by).applyInPandas(fold, f"{kinds}, first long, last long, n long")
