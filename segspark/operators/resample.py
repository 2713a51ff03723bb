"""Jackknife, bootstrap and permutation over blocks. Rows are summed to blocks first; only blocks are ever resampled.

Draws are integer arithmetic on (replicate, draw), so that results don't depend on partitions and SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A linear congruential step on 31 bits. Fixed values.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648


def draw(replicate: Column, index: Column, below: Column | int) -> Column:
    """A pseudo-random integer from 0 to below - 1: two congruential steps on the pair."""
    x = ((replicate * 7919 + index * 104729 + 17) % MODULUS).cast("long")
    for _ in range(2):
        x = (x * MULTIPLIER + INCREMENT) % MODULUS
    return F.floor(F.shiftright(x, 8) % below).cast("long")


def leave_one_out(blocks: DataFrame, num: str, den: str, block: str = "block") -> DataFrame:
    """For each block the ratio sum(num) / sum(den) without it."""
    total = blocks.agg(F.sum(num).alias("__n"), F.sum(den).alias("__d"))
    rows = blocks.groupBy(block).agg(F.sum(num).alias("__bn"), F.sum(den).alias("__bd")).crossJoin(F.broadcast(total))  # one row
    return rows.select(block, ((F.col("__n") - F.col("__bn")).cast("double") / (F.col("__d") - F.col("__bd")).cast("double")).alias("estimate"))


def jackknife_variance(estimates: DataFrame, estimate: str = "estimate") -> DataFrame:
    """(n - 1) / n * sum((x - mean)^2)."""
    n = F.count(estimate).cast("double")
    return estimates.agg(F.count(estimate).alias("blocks"), F.avg(estimate).alias("mean"), ((n - 1) / n * F.var_pop(estimate) * n).alias("variance"))


def numbered(blocks: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Blocks with idx from 0 in ``order``; there are few, as rows have been summed to them."""
    from pyspark.sql import Window

    return blocks.select(*order, *columns, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("idx"))


def bootstrap(blocks: DataFrame, replicates: int, num: str, den: str) -> DataFrame:
    """Per replicate the ratio of sums over as many blocks as there are, drawn with replacement. ``blocks`` must be ``numbered``."""
    n = blocks.count()
    draws = blocks.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("k"))
    drawn = draws.select("rep", draw(F.col("rep"), F.col("k"), max(n, 1)).alias("idx")).groupBy("rep", "idx").agg(F.count("*").alias("times"))
    return drawn.join(blocks, "idx").groupBy("rep").agg((F.sum(F.col(num) * F.col("times")).cast("double") / F.sum(F.col(den) * F.col("times")).cast("double")).alias("estimate"))


def permutation(blocks: DataFrame, replicates: int, a: str, b: str) -> DataFrame:
    """(observed, exceed, p) for the sum of a - b when each block swaps a and b with even odds: p = (exceed + 1) / (replicates + 1).
    ``blocks`` must be ``numbered``, and a and b whole numbers."""
    base = blocks.select("idx", (F.col(a) - F.col(b)).alias("__d"))
    reps = base.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    signed = F.when(draw(F.col("rep"), F.col("idx"), 2) == 0, F.col("__d")).otherwise(-F.col("__d"))
    sums = reps.groupBy("rep").agg(F.sum(signed).alias("s"))
    observed = base.agg(F.sum("__d").alias("observed"))
    rows = sums.crossJoin(F.broadcast(observed))  # one row
    exceed = F.sum((F.abs("s") >= F.abs("observed")).cast("long"))
    return rows.agg(F.first("observed").alias("observed"), exceed.alias("exceed"), ((exceed + 1).cast("double") / F.lit(replicates + 1.0)).alias("p"))


def grouped(windows: DataFrame, order: list[str], size: int, maps: dict[str, tuple[str, str]]) -> DataFrame:
    """(idx, n, and for each map four sums): moments of groups of ``size`` windows that follow each other in ``order``, the remainder
    dropped; ``maps``: name -> (observed, predicted). Windows are bins of the data behind them; their moments are all that is resampled."""
    from pyspark.sql import Window

    pairs = {m: (F.col(o).cast("double"), F.col(p).cast("double")) for m, (o, p) in maps.items()}
    rows = windows.select(*order, *[c for m, (o, p) in pairs.items() for c in (o.alias(f"{m}_o"), p.alias(f"{m}_p"))])
    rows = rows.withColumn("idx", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("long"))
    sums = [s for m in maps for o, p in [(F.col(f"{m}_o"), F.col(f"{m}_p"))] for s in (F.sum(o).alias(f"{m}_o"), F.sum(o * o).alias(f"{m}_oo"), F.sum((o - p) * (o - p)).alias(f"{m}_r"))]
    return rows.groupBy("idx").agg(F.count("*").alias("n"), *sums).where(F.col("n") == size)


def _r2(m: str) -> Column:
    """R^2 around y = x from summed moments."""
    o, oo, r, n = (F.sum(c).cast("double") for c in (f"{m}_o", f"{m}_oo", f"{m}_r", "n"))
    return 1.0 - r / (oo - o * o / n)


def bootstrap_r2(groups: DataFrame, replicates: int, maps: list[str]) -> DataFrame:
    """(rep, a column a map): R^2 of each replicate, which draws as many groups as there are, with replacement and the same for all maps;
    rep -1 has all groups once. Moments of groups are drawn, so a replicate costs a row a group, whatever the windows."""
    n = groups.count()
    draws = groups.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("k"))
    drawn = draws.select("rep", draw(F.col("rep"), F.col("k"), max(n, 1)).alias("idx")).join(groups, "idx")
    rows = drawn.unionByName(groups.withColumn("rep", F.lit(-1).cast("long")))
    return rows.groupBy("rep").agg(*[_r2(m).alias(m) for m in maps])


def compared(replicates: DataFrame, a: str, b: str) -> DataFrame:
    """One row: both values of all groups, the standard deviations of the replicates, and p = (replicates whose b - a is at least that of
    all groups, plus one) / (replicates + 1)."""
    whole = replicates.where("rep < 0").select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    rows = replicates.where("rep >= 0").crossJoin(F.broadcast(whole))  # one row
    exceed = F.sum((F.col(b) - F.col(a) >= F.col("__b") - F.col("__a")).cast("long"))
    return rows.agg(F.first("__a").alias(a), F.first("__b").alias(b), F.stddev_pop(a).alias(f"sd_{a}"), F.stddev_pop(b).alias(f"sd_{b}"), ((exceed + 1).cast("double") / (F.count("*") + 1).cast("double")).alias("p"))
