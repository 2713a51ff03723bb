"""Lookups along an axis: as-of, nearest, point in interval, interpolation, assignment to segments.

An as-of lookup unions probes and edges and carries the last known edge in one two-level scan: one shuffle, no fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.operators import scan
from segspark.operators.intervals import BY, WIDTH


def asof(probes: DataFrame, edges: DataFrame, values: list[str], by: list[str] = BY, pos: str = "pos", forward: bool = False, strict: bool = False, width: int = WIDTH) -> DataFrame:
    """Probes with ``values`` of the last edge at or before them (``forward``: the first at or after; ``strict``: not at them).
    Edges are rows (key, pos, values), places distinct; null where there is none."""
    extra = [c for c in probes.columns if c not in (*by, pos)]
    # At equal places edges come first unless strict; sorting descends for forward lookups.
    first = (1 if forward else 0) if not strict else (0 if forward else 1)
    a = edges.select(*by, F.col(pos), F.lit(first).alias("__kind"), F.lit(False).alias("__probe"), F.struct(*values).alias("__found"), F.lit(None).alias("__row"))
    b = probes.select(*by, F.col(pos), F.lit(1 - first).alias("__kind"), F.lit(True).alias("__probe"), F.lit(None).alias("__found"), F.struct(F.lit(0).alias("__none"), *extra).alias("__row"))
    a = a.withColumn("__row", F.lit(None).cast(b.schema["__row"].dataType))
    b = b.withColumn("__found", F.lit(None).cast(a.schema["__found"].dataType))
    rows = scan.last_known(a.unionByName(b), by, pos, ["__found"], width, ["__kind"], forward)
    return rows.where("__probe").select(*by, pos, *[F.col(f"__row.{c}").alias(c) for c in extra], *[F.col(f"__found.{v}").alias(v) for v in values])


def step_value(probes: DataFrame, steps: DataFrame, by: list[str] = BY, pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Value of the first upper edge at or after each probe; beyond the last edge, the last edge's (a clamped step lookup)."""
    found = asof(probes, steps.select(*by, F.col("edge").alias(pos), "value"), ["value"], by, pos, True, width=width)
    last = steps.groupBy(*by).agg(F.max_by("value", "edge").alias("__last"))
    return found.join(F.broadcast(last), by, "left").withColumn("value", F.coalesce("value", "__last")).drop("__last")  # one row a key


def between(probes: DataFrame, edges: DataFrame, before: dict[str, str], after: dict[str, str], by: list[str] = BY, pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Probes with values of the last edge at or before them and of the first at or after them, in one scan. ``before`` and ``after``
    map new columns to columns of ``edges``, a row for each place."""
    extra = [c for c in probes.columns if c not in (*by, pos)]
    a = edges.select(*by, F.col(pos), F.lit(0).alias("__kind"), F.lit(1).alias("__back"), F.lit(False).alias("__probe"), F.struct(*[F.col(c).alias(n) for n, c in before.items()]).alias("__low"), F.struct(*[F.col(c).alias(n) for n, c in after.items()]).alias("__high"))
    b = probes.select(*by, F.col(pos), F.lit(1).alias("__kind"), F.lit(0).alias("__back"), F.lit(True).alias("__probe"), F.struct(F.lit(0).alias("__none"), *extra).alias("__row"))
    rows = a.unionByName(b, allowMissingColumns=True)
    rows = scan.fill(rows, by, pos, [scan.Fill(["__low"], ["__kind"]), scan.Fill(["__high"], ["__back"], forward=True)], width)
    return rows.where("__probe").select(*by, pos, *[F.col(f"__row.{c}").alias(c) for c in extra], *[F.col(f"__low.{n}").alias(n) for n in before], *[F.col(f"__high.{n}").alias(n) for n in after])


def nearest(probes: DataFrame, focal: DataFrame, by: list[str] = BY, pos: str = "pos", within: float | None = None, width: int = WIDTH) -> DataFrame:
    """Add distance: signed, from each probe to the nearest focal place (focal less probe); at equal distance the greater place wins.
    Null where there is none, or none ``within``."""
    rows = between(probes, focal.select(*by, pos).distinct(), {"__prev": pos}, {"__next": pos}, by, pos, width)
    up, down = F.col("__next") - F.col(pos), F.col("__prev") - F.col(pos)
    d = F.when(up.isNull(), down).when(down.isNull(), up).when(up <= -down, up).otherwise(down)
    rows = rows.withColumn("distance", d).drop("__prev", "__next")
    return rows if within is None else rows.withColumn("distance", F.when(F.abs("distance") <= within, F.col("distance")))


def nearest_edge(probes: DataFrame, intervals: DataFrame, by: list[str] = BY, pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Probes outside disjoint intervals, with the signed distance to the nearest edge; the 5' edge of the next wins ties."""
    rows = between(probes, intervals.select(*by, F.col("start").alias(pos), "end"), {"__end": "end"}, {"__start": pos}, by, pos, width)
    rows = rows.where(F.col("__end").isNull() | (F.col(pos) >= F.col("__end")))
    up, down = F.col("__start") - F.col(pos), F.col("__end") - 1 - F.col(pos)
    return rows.withColumn("distance", F.when(up.isNull(), down).when(down.isNull(), up).when(-down < up, down).otherwise(up)).drop("__end", "__start")


def in_interval(probes: DataFrame, intervals: DataFrame, by: list[str] = BY, pos: str = "pos", closed: bool = False, width: int = WIDTH) -> DataFrame:
    """Add inside: whether a probe lies in one of disjoint intervals (``closed``: ends included)."""
    rows = asof(probes, intervals.select(*by, F.col("start").alias(pos), F.col("end").alias("__end")), ["__end"], by, pos, width=width)
    hit = F.col(pos) <= F.col("__end") if closed else F.col(pos) < F.col("__end")
    return rows.withColumn("inside", F.coalesce(hit, F.lit(False))).drop("__end")


def interpolate(probes: DataFrame, knots: DataFrame, x: str = "pos", y: str = "gpos", by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Add y by linear interpolation between knots (key, x, y), clamped to the first and last."""
    rows = between(probes, knots.select(*by, x, y), {"__x0": x, "__y0": y}, {"__x1": x, "__y1": y}, by, x, width)
    x0, y0, x1, y1 = (F.col(f"__{c}").cast("double") for c in ("x0", "y0", "x1", "y1"))
    value = F.when(x0.isNull(), y1).when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (y1 - y0) * (F.col(x) - x0) / (x1 - x0))
    return rows.withColumn(y, value).drop("__x0", "__y0", "__x1", "__y1")


def assign(points: DataFrame, segments: DataFrame, by: list[str] = BY, pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Points with seg: the start of the tiling segment that holds them."""
    return asof(points, segments.select(*by, F.col("start").alias(pos), F.col("start").alias("seg")), ["seg"], by, pos, width=width)
