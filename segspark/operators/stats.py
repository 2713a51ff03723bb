"""Sufficient statistics of allele counts, and summaries of observed against predicted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import genetics as g


def sufficient(sites: DataFrame, by: list[str], maps: list[str] = []) -> DataFrame:
    """Per segment: pairs that differ (het) and that don't (hom), sites, polymorphic sites, mean maps and rates."""
    het, n = g.het_pairs(F.col("n"), F.col("alt")), F.col("n")
    return sites.groupBy(*by).agg(
        F.sum(het).alias("het"),
        (F.sum(g.all_pairs(n)) - F.sum(het)).alias("hom"),
        F.count("*").alias("sites"),
        F.sum(((F.col("alt") > 0) & (F.col("alt") < n)).cast("long")).alias("poly"),
        *[F.avg(m).alias(m) for m in maps],
    )


def genome_summary(segments: DataFrame) -> DataFrame:
    """Pairs, mean diversity, mean rate by sites, and the starting tau: mean rate * (1 - m) / m with m the mean diversity."""
    sums = segments.agg(F.sum(F.col("het") + F.col("hom")).alias("pairs"), F.sum("het").alias("het"), F.sum(F.col("nu") * F.col("sites")).alias("w"), F.sum("sites").alias("sites"))
    mean = F.col("het").cast("double") / F.col("pairs").cast("double")
    rate = F.col("w") / F.col("sites").cast("double")
    return sums.select("pairs", mean.alias("mean_pi"), rate.alias("mean_nu"), (rate * (1.0 - mean) / mean).alias("tau"))


def weighted(df: DataFrame, value: str, weight: str, by: list[str] = []) -> DataFrame:
    """Weighted mean and variance, from three sums in one pass around a shift that keeps them accurate."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    sums = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(v * w).alias("vw"), F.sum(v * v * w).alias("vvw"))
    mean = F.col("vw") / F.col("w")
    return sums.select(*by, mean.alias("mean"), (F.col("vvw") / F.col("w") - mean * mean).alias("variance"))


def harmonic_mean(value: Column) -> Column:
    return F.count(value).cast("double") / F.sum(1.0 / value)


def relative_error(hits: Column, total: Column) -> Column:
    """Relative standard error of a binomial share."""
    p = hits.cast("double") / total.cast("double")
    return F.sqrt(p * (1.0 - p) / total.cast("double")) / p


def ratio_variance(x: Column, y: Column, var_x: Column, var_y: Column) -> Column:
    """Variance of y / x for independent x and y with these means and variances, to first order."""
    return (var_x * (y / x) * (y / x) + var_y) / (x * x)


def r_squared(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """1 - SSres / SStot around y = x (not of a regression), the residual covariance term, and rows."""
    mean = df.agg(F.avg(observed).alias("__m"))
    rows = df.crossJoin(F.broadcast(mean))  # one row
    o, p, m = F.col(observed), F.col(predicted), F.col("__m")
    res, tot = F.sum((o - p) * (o - p)), F.sum((o - m) * (o - m))
    return rows.agg((1.0 - res / tot).alias("r2"), (2.0 * F.sum((o - p) * (p - m)) / tot).alias("residual_term"), F.count("*").alias("windows"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ranks, ties averaged. Ranks come from counts of distinct values, so only those are ordered."""
    from segspark.operators import scan

    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    ranked = scan.ordered_prefix_sum(counts, column, [], {"__upto": "__n"})
    return df.join(ranked.select(column, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name)), column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(a, b), a, "__ra"), b, "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("rho"))


def ols(df: DataFrame, y: str, x: str, t: float = 1.96) -> DataFrame:
    """Least squares y on x: slope, intercept, and the intercept's interval at ``t`` standard errors."""
    sums = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mx"))
    s2 = (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)
    error = F.sqrt(s2 * (1.0 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))
    return sums.select("slope", "intercept", (F.col("intercept") - t * error).alias("low"), (F.col("intercept") + t * error).alias("high"))


def error_bands(df: DataFrame, a: str, b: str, tolerance: float, bands: int = 5) -> DataFrame:
    """Share of rows whose absolute difference lies in each band (tolerance * 2^k, tolerance * 2^(k+1)], in percent."""
    d = F.abs(F.col(a) - F.col(b))
    shares = [F.struct(F.lit(k).alias("band"), (100.0 * F.avg(((d > tolerance * 2**k) & ((d <= tolerance * 2 ** (k + 1)) if k < bands - 1 else F.lit(True))).cast("double"))).alias("percent")) for k in range(bands)]
    return df.agg(F.array(*shares).alias("s")).select(F.inline("s"))


def percentile_cutoff(counts: DataFrame, share: float, score: str = "score", count: str = "n") -> DataFrame:
    """The least score whose cumulative share reaches ``share``; the greatest if none does. ``counts``: a histogram of scores."""
    from segspark.operators import scan

    rows = scan.ordered_prefix_sum(counts, score, [], {"__upto": count})
    total = counts.agg(F.sum(count).alias("__total"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    return rows.agg(F.coalesce(F.min(F.when(F.col("__upto") >= share * F.col("__total"), F.col(score))), F.max(score)).alias("cutoff"))


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int, weight: Column | None = None) -> DataFrame:
    """Counts (or summed weights) of equal bins from ``low``; the last bin holds its upper edge."""
    v = F.col(value)
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1))
    rows = df.where((v >= low) & (v <= low + width * bins)).groupBy(at.cast("long").alias("bin"))
    return rows.agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def populations(a: DataFrame, b: DataFrame, by: list[str], n: int) -> DataFrame:
    """Full outer join of two populations' sites (n, alt); a missing one is monomorphic with ``n`` chromosomes."""
    left = a.select(*by, F.col("n").alias("n1"), F.col("alt").alias("alt1"))
    right = b.select(*by, F.col("n").alias("n2"), F.col("alt").alias("alt2"))
    joined = left.join(right, by, "full_outer")
    return joined.select(*by, F.coalesce("n1", F.lit(n)).alias("n1"), F.coalesce("alt1", F.lit(0)).alias("alt1"), F.coalesce("n2", F.lit(n)).alias("n2"), F.coalesce("alt2", F.lit(0)).alias("alt2"))


def signed_rank(df: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """Sum of signed ranks of the differences, zeros left out; ties are ranked by ``key``, not averaged."""
    from segspark.operators import scan

    rows = df.select(*key, (F.col(a) - F.col(b)).alias("__d")).where("__d <> 0").withColumn("__one", F.lit(1)).withColumn("__abs", F.abs("__d"))
    ranked = scan.ordered_prefix_sum(rows, "__abs", key, {"__rank": "__one"})
    return ranked.agg(F.sum(F.signum("__d") * F.col("__rank")).alias("w"), F.count("*").alias("n"))


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order`` (which must decide), by a grouped minimum rather than a sort."""
    rest = [c for c in df.columns if c not in (*by, *order)]
    return df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("__r")).select(*by, "__r.*")


def windows_filled(sites: DataFrame, spans: DataFrame, width: int, by: list[str], pos: str, hit: Column) -> DataFrame:
    """Sites and hits in fixed windows over each key's (first, last) window; empty windows count 0, and their rate is the mean of the
    neighbouring windows' that have one."""
    counts = sites.groupBy(*by, F.floor(F.col(pos) / width).cast("long").alias("window")).agg(F.count("*").alias("bases"), F.sum(hit.cast("long")).alias("subs"))
    grid = spans.select(*by, F.explode(F.sequence("first", "last")).alias("window"))
    rows = grid.join(counts, [*by, "window"], "left").fillna(0, ["bases", "subs"])
    own = F.when(F.col("bases") > 0, F.col("subs").cast("double") / F.col("bases").cast("double"))
    order = Window.partitionBy(*by).orderBy("window")
    before = F.last(F.col("__r"), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.col("__r"), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("__r", own)
    filled = F.when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2.0)
    return rows.withColumn("rate", F.coalesce("__r", filled)).drop("__r")
