"""Two-level scans: ordered computations along an axis without putting a whole axis into one task.

The axis is cut into buckets of ``width``. Each bucket is summed up by a grouped aggregate (small), the sums are scanned in a
window over buckets, and the result is carried into a window within each bucket. Rows are shuffled once, by (key, bucket). The
input is used twice, for its sums and its rows; so everything that one operator needs is carried in one scan.
Rows with a null key or place have no order and are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

_BUCKET = "__bucket"


def bucketed(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.floor(F.col(pos) / F.lit(width)).cast("long"))


def _with_carry(df: DataFrame, by: list[str], aggregates: list[Column], carries: list[Column]) -> DataFrame:
    """Rows with what comes before (or after) their bucket; ``carries`` are window columns over the buckets' aggregates."""
    sums = df.groupBy(*by, _BUCKET).agg(*aggregates)
    return df.join(sums.select(*by, _BUCKET, *carries), [*by, _BUCKET])


def _buckets(by: list[str], descending: bool = False):
    return Window.partitionBy(*by).orderBy(F.desc(_BUCKET) if descending else F.col(_BUCKET))


def _rows(by: list[str], order: list[Column | str]):
    return Window.partitionBy(*by, _BUCKET).orderBy(*order)


def prefix_sum(df: DataFrame, by: list[str], pos: str, values: dict[str, str], width: int, ties: list[str] = []) -> DataFrame:
    """Add running sums, including the row itself: ``values`` maps new columns to the columns summed. Order: pos, then ties."""
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    df = _with_carry(bucketed(df, pos, width), by, [F.sum(v).alias(f"__carry_{n}") for n, v in values.items()], [F.sum(f"__carry_{n}").over(before).alias(f"__carry_{n}") for n in values])
    own = _rows(by, [pos, *ties]).rowsBetween(Window.unboundedPreceding, 0)
    for n, v in values.items():
        df = df.withColumn(n, F.sum(v).over(own) + F.coalesce(F.col(f"__carry_{n}"), F.lit(0)))
    return df.drop(_BUCKET, *[f"__carry_{n}" for n in values])


class Fill(NamedTuple):
    """What ``fill`` looks for: the columns, those that order rows of one place, and where: ``forward``: after the row, then places and
    ties are sorted descending; ``own``: the row itself counts."""

    values: list[str]
    ties: list[str] = []
    forward: bool = False
    own: bool = True


def fill(df: DataFrame, by: list[str], pos: str, fills: list[Fill], width: int) -> DataFrame:
    """Replace the values of each fill by the last (or next) ones known at each row: those of the nearest row in which the first
    of them isn't null. All fills share one scan."""
    df = bucketed(df, pos, width)
    aggregates, carries = [], []
    for k, f in enumerate(fills):
        known, place = F.struct(*f.values), F.struct(pos, *f.ties)
        there = F.col(f.values[0]).isNotNull()
        aggregates.append((F.min_by if f.forward else F.max_by)(F.when(there, known), F.when(there, place)).alias(f"__v{k}"))
        carries.append(F.last(f"__v{k}", ignorenulls=True).over(_buckets(by, f.forward).rowsBetween(Window.unboundedPreceding, -1)).alias(f"__v{k}"))
    df = _with_carry(df, by, aggregates, carries)
    found = {}
    for k, f in enumerate(fills):
        order = [F.desc(c) if f.forward else F.col(c) for c in (pos, *f.ties)]
        frame = _rows(by, order).rowsBetween(Window.unboundedPreceding, 0 if f.own else -1)
        found[f"__v{k}"] = F.coalesce(F.last(F.when(F.col(f.values[0]).isNotNull(), F.struct(*f.values)), ignorenulls=True).over(frame), F.col(f"__v{k}"))
    df = df.withColumns(found)
    gone = {_BUCKET, *found, *(v for f in fills for v in f.values)}
    return df.select(*[c for c in df.columns if c not in gone], *[F.col(f"__v{k}.{v}").alias(v) for k, f in enumerate(fills) for v in f.values])


def last_known(df: DataFrame, by: list[str], pos: str, values: list[str], width: int, ties: list[str] = [], forward: bool = False, own: bool = True) -> DataFrame:
    return fill(df, by, pos, [Fill(values, ties, forward, own)], width)


def running_max(df: DataFrame, by: list[str], pos: str, value: str, name: str, width: int, ties: list[str] = []) -> DataFrame:
    """Add ``name``: the greatest ``value`` of all rows before this one (null for the first)."""
    df = _with_carry(bucketed(df, pos, width), by, [F.max(value).alias("__m")], [F.max("__m").over(Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)).alias("__m")])
    within = F.max(value).over(_rows(by, [pos, *ties]).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.greatest(within, F.col("__m"))).drop("__m", _BUCKET)


def neighbour(df: DataFrame, by: list[str], pos: str, value: str, name: str, width: int, ties: list[str] = [], after: bool = False) -> DataFrame:
    """Add ``name``: ``value`` of the row before (or after) this one; null at the end."""
    place = F.struct(pos, *ties)
    pick = (F.min_by if after else F.max_by)(F.struct(value), place)
    df = _with_carry(bucketed(df, pos, width), by, [pick.alias("__v")], [F.lag("__v").over(_buckets(by, after)).alias("__v")])
    order = [F.desc(c) if after else F.col(c) for c in (pos, *ties)]
    within = F.lag(F.struct(value)).over(_rows(by, order))
    return df.withColumn(name, F.coalesce(within, F.col("__v"))[value]).drop("__v", _BUCKET)


def _place(value: Column, cuts: list, low: int = 0) -> Column:
    """How many of the ascending cuts are below the value, as a tree of comparisons; of many cuts, one in 32 makes the tree, and those in
    between are counted in arrays, so that the generated code stays small."""
    if len(cuts) > 64:
        heads = cuts[31::32]
        between = F.array(*[F.array(*map(F.lit, cuts[k : k + 31])) for k in range(0, len(heads) * 32 + 1, 32)])
        part = _place(value, heads)
        inner = F.element_at(between, part.cast("int") + 1)
        return part * 32 + F.size(F.filter(inner, lambda c: c < value)) + low
    if not cuts:
        return F.lit(low).cast("long")
    k = len(cuts) // 2
    return F.when(value > F.lit(cuts[k]), _place(value, cuts[k + 1 :], low + k + 1)).otherwise(_place(value, cuts[:k], low))


def range_parts(df: DataFrame, order: str, ties: list[str] = [], rows: int = 500_000, most: int = 1024) -> DataFrame:
    """Add ``__part``: a number that grows with ``order``, then the first of ``ties`` if numeric. Parts hold about ``rows`` rows each, and
    there are 64 to ``most``; a value that fills several parts alone is cut by the tie. One aggregate finds the cuts."""
    steps = [k / most for k in range(1, most)]
    found = df.agg(F.count(order).alias("n"), F.percentile_approx(order, steps, 10 * most).alias("q")).first()
    parts = min(most, max(64, -(-found.n // rows)))
    picked = [found.q[k * most // parts - 1] for k in range(1, parts)] if found.q else []
    cuts = sorted(set(picked))
    part = _place(F.col(order), cuts) * most
    hot = [c for c in cuts if picked.count(c) > 2]
    if hot and ties and isinstance(df.schema[ties[0]].dataType, NumericType):
        each = df.where(F.col(order).isin(hot)).groupBy(order).agg(F.percentile_approx(ties[0], [k / 64 for k in range(1, 64)], 640).alias("q"))
        for r in each.collect():  # fewer than `parts` rows
            part = F.when(F.col(order) == F.lit(r[order]), part + _place(F.col(ties[0]), sorted(set(r.q)))).otherwise(part)
    return df.withColumn("__part", part)


def ordered_prefix_sum(df: DataFrame, order: str, ties: list[str], values: dict[str, str]) -> DataFrame:
    """Running sums over all rows in the order of ``order`` and then ``ties``, in ranges of about equal size."""
    df = range_parts(df, order, ties)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sums = df.groupBy("__part").agg(*[F.sum(v).alias(f"__carry_{n}") for n, v in values.items()])
    df = df.join(F.broadcast(sums.select("__part", *[F.sum(f"__carry_{n}").over(before).alias(f"__carry_{n}") for n in values])), "__part")
    own = Window.partitionBy("__part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    for n, v in values.items():
        df = df.withColumn(n, F.sum(v).over(own) + F.coalesce(F.col(f"__carry_{n}"), F.lit(0)))
    return df.drop("__part", *[f"__carry_{n}" for n in values])
