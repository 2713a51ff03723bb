"""Sums and means of points in several ranges around each site, without joining sites to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators import lookup, scan
from segspark.operators.intervals import BY, WIDTH


def range_sums(sites: DataFrame, points: DataFrame, ranges: dict[str, tuple[Column, Column]], value: str, by: list[str] = BY, pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """(key, pos, and for each range n_ and sum_): how many points, and the sum of their values, have a place from the range's start up to
    before its end. Ends are columns over ``sites``, whose places are taken once.

    A range's sum is the running sum at its end less that at its start, so all ends of all ranges go through the points' running sum as rows of
    no value: one scan, and one shuffle by site to subtract. Points with a null value don't count; a null end gives null.
    """
    sites = sites.dropDuplicates([*by, pos])
    kind = points.schema[pos].dataType
    ends = F.array(*[F.struct(F.lit(n).alias("r"), F.lit(sign).alias("sign"), end.cast(kind).alias("at")) for n, pair in ranges.items() for sign, end in zip((-1, 1), pair)])
    asked = sites.select(*by, F.col(pos).alias("__site"), F.explode(ends).alias("e")).select(*by, "__site", "e.r", "e.sign", F.col("e.at").alias(pos))
    asked = asked.withColumns({"__k": F.lit(0), "__v": F.lit(0).cast(points.schema[value].dataType), "__n": F.lit(0)})
    given = points.where(F.col(value).isNotNull()).select(*by, F.col(pos), F.lit(1).alias("__k"), F.col(value).alias("__v"), F.lit(1).alias("__n"))
    rows = scan.prefix_sum(given.unionByName(asked, allowMissingColumns=True), by, pos, {"__sv": "__v", "__sn": "__n"}, width, ["__k"])
    rows = rows.where("__k = 0").unionByName(asked.where(F.col(pos).isNull()).withColumns({"__sv": F.lit(None).cast("long"), "__sn": F.lit(None).cast("long")}), allowMissingColumns=True)

    def both(r: str, c: str) -> Column:
        low, high = (F.max(F.when((F.col("r") == r) & (F.col("sign") == s), F.col(c))) for s in (-1, 1))
        return high - low

    return rows.groupBy(*by, F.col("__site").alias(pos)).agg(*[c for r in ranges for c in (both(r, "__sn").alias(f"n_{r}"), both(r, "__sv").alias(f"sum_{r}"))])


def around(sites: DataFrame, points: DataFrame, knots: DataFrame, radius: int, map_radius: float, value: str, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """(key, pos, n_near, mean_near, n_map, mean_map): points within ``radius`` places of each site, and within ``map_radius`` of map distance,
    both from start to before the end, and the means of their values. Map ends are brought back to places by the map (key, pos, gpos)."""
    at = lookup.interpolate(sites.select(*by, "pos").distinct(), knots, "pos", "gpos", by, width)
    ends = F.explode(F.array(F.struct(F.lit("low").alias("side"), F.greatest(F.lit(0.0), F.col("gpos") - map_radius).alias("g")), F.struct(F.lit("high").alias("side"), (F.col("gpos") + map_radius).alias("g"))))
    ends = at.select(*by, F.col("pos").alias("__site"), ends.alias("e")).select(*by, "__site", "e.side", F.col("e.g").alias("gpos"))
    places = lookup.interpolate(ends, knots.select(*by, "pos", "gpos"), "gpos", "pos", by, width).withColumn("pos", F.floor("pos").cast("long"))
    wide = places.groupBy(*by, F.col("__site").alias("pos")).agg(*[F.max(F.when(F.col("side") == s, F.col("pos"))).alias(f"__{s}") for s in ("low", "high")])
    rows = range_sums(wide, points, {"near": (F.col("pos") - radius, F.col("pos") + radius), "map": (F.col("__low"), F.col("__high"))}, value, by, width=width)
    return rows.select(*by, "pos", *[c for r in ("near", "map") for c in (f"n_{r}", (F.col(f"sum_{r}").cast("double") / F.nullif(F.col(f"n_{r}"), F.lit(0))).alias(f"mean_{r}"))])
