"""Diversity within and between all pairs of populations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions import genetics as g


def pair_matrix(counts: DataFrame, site: list[str], by: list[str] = [], pop: str = "pop") -> DataFrame:
    """(``by``, a, b, sites, diff, pairs), a <= b: over the sites that both populations have, pairs of chromosomes, one of each (of one
    population: two of it), and how many of them differ. ``counts``: a row a site and population, with n and alt.

    A site's populations come together in one array (a row a population), its pairs are made there and summed up before they are shuffled; so the
    whole matrix costs one shuffle of the counts. ``by``: columns of ``site`` to sum within (segments, chromosomes). Rows with a null site,
    population or count are left out; of repeated rows of one site and population the counts are added."""
    rows = counts.dropna(subset=[*site, pop, "n", "alt"]).groupBy(*site, pop).agg(F.sum("n").cast("long").alias("n"), F.sum("alt").cast("long").alias("alt"))
    sites = rows.groupBy(*site).agg(F.sort_array(F.collect_list(F.struct(F.col(pop).alias("p"), "n", "alt"))).alias("pops"))  # a struct a population
    pairs = F.flatten(F.transform("pops", lambda x, i: F.transform(F.slice("pops", i + 1, F.size("pops")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    each = sites.select(*by, F.explode(pairs).alias("q")).select(*by, F.col("q.x.p").alias("a"), F.col("q.y.p").alias("b"), *[F.col(f"q.{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("n", "alt")])
    xn, xa, yn, ya = (F.col(c) for c in ("x_n", "x_alt", "y_n", "y_alt"))
    own = F.col("a") == F.col("b")
    diff, all_ = F.when(own, g.het_pairs(xn, xa)).otherwise(xa * (yn - ya) + ya * (xn - xa)), F.when(own, g.all_pairs(xn)).otherwise(xn * yn)
    return each.groupBy(*by, "a", "b").agg(F.count("*").alias("sites"), F.sum(diff).alias("diff"), F.sum(all_).alias("pairs"))
