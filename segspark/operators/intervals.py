"""Interval algebra over (key, start, end) rows, half-open, and over step functions.

Every operator works for all keys at once. Set operations are event sweeps within buckets: intervals are cut at bucket borders, so
each bucket's counts are complete in themselves; boundaries with +1 and -1 are summed per place and run through in one window a
bucket. Pieces that touch a border are joined with their neighbours in a second window over these pieces only. So any boolean
combination of masks reads each set once and needs no join. Intervals without length cover nothing and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.operators import scan

BY, WIDTH = ["chrom"], 1 << 20


def islands(points: DataFrame, by: list[str] = BY, pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Maximal runs of consecutive places, as [start, end). Repeated places count once."""
    return merge(points.select(*by, F.col(pos).alias("start"), (F.col(pos) + 1).alias("end")).distinct(), by, width)


def merge(intervals: DataFrame, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Join overlapping and touching intervals."""
    return where_covered({"n": intervals}, "n > 0", by, width)


def _joined(rows: DataFrame, by: list[str], same: Callable[[Column], Column], values: list[str] = []) -> DataFrame:
    """Join neighbouring rows (key, start, end, values), in order of start, where ``same`` holds for a struct of the row before. Rows
    have the bucket of their start in __b. Runs are made within buckets; then the first and last run of each bucket go through
    one window a key, two rows a bucket at most, while all others keep a window of their own bucket."""
    order = Window.partitionBy(*by, "__b").orderBy("start")
    new = F.when(F.coalesce(same(F.lag(F.struct("start", "end", *values)).over(order)), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    ends = [F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(v).alias(v) for v in values]]
    local = rows.groupBy(*by, "__b", "__run").agg(*ends).withColumn("__runs", F.max("__run").over(Window.partitionBy(*by, "__b")))
    local = local.withColumn("__part", F.when((F.col("__run") > 1) & (F.col("__run") < F.col("__runs")), F.col("__b")))
    order = Window.partitionBy(*by, "__part").orderBy("start")
    local = local.withColumn("__p", F.lag(F.struct("__b", "__run", "__runs", "start", "end", *values)).over(order))
    p, inside = F.col("__p"), F.col("__p")["__b"] == F.col("__b")
    beside = F.when(inside, p["__run"] == F.col("__run") - 1).otherwise((p["__run"] == p["__runs"]) & (F.col("__run") == 1))
    local = local.withColumn("__new", F.when(F.coalesce(beside & same(p), F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    return local.groupBy(*by, "__part", "__run").agg(*ends).select(*by, "start", "end", *values)


def intersect(a: DataFrame, b: DataFrame, by: list[str] = BY, width: int = 1 << 14, closed: bool = False) -> DataFrame:
    """All pairwise overlaps of two interval sets. ``closed``: touching intervals give zero-length overlaps too."""
    pairs = range_join(a.select(*by, "start", "end"), b.select(*by, "start", "end"), by, width, closed)
    return pairs.select(*by, F.greatest("start", "start_b").alias("start"), F.least("end", "end_b").alias("end"))


def range_join(a: DataFrame, b: DataFrame, by: list[str] = BY, width: int = 1 << 14, closed: bool = False) -> DataFrame:
    """Pairs of rows whose intervals overlap; the columns of ``b`` get the suffix _b. Each interval goes to the buckets that it
    covers, pairs meet in an equi-join on (key, bucket), and count only in the bucket that holds the greater start."""
    last = F.col("end") if closed else F.greatest(F.col("end") - 1, F.col("start"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))

    right = dealt(b).select(*by, "__b", *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in by])
    meets = (F.col("start") <= F.col("end_b")) & (F.col("start_b") <= F.col("end")) if closed else (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end"))
    return dealt(a).join(right, [*by, "__b"]).where(meets & (F.floor(F.greatest("start", "start_b") / width) == F.col("__b"))).drop("__b")


def _counted(sets: dict[str, DataFrame], by: list[str], width: int) -> DataFrame:
    """(key, __b, start, end, count a set): stretches within buckets that any set covers."""
    events = None
    for name in sets:
        low, high = F.floor(F.col("start") / F.lit(width)), F.floor((F.col("end") - 1) / F.lit(width))
        cut = sets[name].where("start < end").select(*by, "start", "end", F.explode(F.sequence(low, high)).alias("__b"))
        edges = [F.struct(p.cast("long").alias("__at"), *[F.lit(step if n == name else 0).alias(n) for n in sets]) for p, step in ((F.greatest(F.col("start"), F.col("__b") * width), 1), (F.least(F.col("end"), (F.col("__b") + 1) * width), -1))]
        part = cut.select(*by, "__b", F.inline(F.array(*edges)))
        events = part if events is None else events.unionByName(part)
    summed = events.groupBy(*by, "__b", "__at").agg(*[F.sum(n).alias(n) for n in sets])
    order = Window.partitionBy(*by, "__b").orderBy("__at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = summed.select(*by, "__b", F.col("__at").alias("start"), F.lead("__at").over(order).alias("end"), *[F.sum(n).over(upto).alias(n) for n in sets])
    return rows.where(F.col("end").isNotNull() & (F.greatest(*sets, F.lit(0)) > 0))


def coverage(sets: dict[str, DataFrame], by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Stretches that any set covers, between neighbouring boundaries and at most to the next multiple of ``width``, with, for each
    named set, how many of its intervals cover them."""
    return _counted(sets, by, width).drop("__b")


def where_covered(sets: dict[str, DataFrame], keep: Column | str, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Intervals, of what any set covers, where ``keep``, a condition on the counts of ``coverage``, holds; touching ones are joined."""
    return _joined(_counted(sets, by, width).where(keep), by, lambda before: before["end"] == F.col("start"))


def subtract(a: DataFrame, b: DataFrame, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    return where_covered({"a": a, "b": b}, "a > 0 and b = 0", by, width)


def covered_at_least(intervals: DataFrame, k: int, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Places that at least ``k`` intervals cover (labels seen in k of n cell lines, for instance)."""
    return where_covered({"n": intervals}, f"n >= {k}", by, width)


def complement(intervals: DataFrame, bounds: DataFrame, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """The parts of ``bounds`` (key, start, end) outside the intervals."""
    return subtract(bounds, intervals, by, width)


def overlap_bases(a: DataFrame, b: DataFrame, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """For each key the places in a, in b and in both, each counted once."""
    counts = coverage({"a": a, "b": b}, by, width)
    length = F.col("end") - F.col("start")

    def total(condition: str, name: str) -> Column:
        return F.sum(F.when(F.expr(condition), length).otherwise(0)).alias(name)

    return counts.groupBy(*by).agg(total("a > 0", "bases_a"), total("b > 0", "bases_b"), total("a > 0 and b > 0", "bases_both"))


def inside_outside(annotation: DataFrame, split: DataFrame, by: list[str] = BY, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The parts of an annotation within and outside another (exonic and other, for instance)."""
    sets = {"a": annotation, "b": split}
    return where_covered(sets, "a > 0 and b > 0", by, width), where_covered(sets, "a > 0 and b = 0", by, width)


def progressive(first: DataFrame, others: list[DataFrame], by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Places left after each further mask is intersected: (step, bases), all steps in one sweep."""
    sets = {"m0": first} | {f"m{k}": m for k, m in enumerate(others, 1)}
    counts = coverage(sets, by, width)
    length, kept, steps = F.col("end") - F.col("start"), F.lit(True), []
    for k, name in enumerate(sets):
        kept = kept & (F.col(name) > 0)
        steps.append(F.struct(F.lit(k).alias("step"), F.coalesce(F.sum(F.when(kept, length)), F.lit(0)).cast("long").alias("bases")))
    return counts.agg(F.array(*steps).alias("s")).select(F.inline("s"))


def overlay(maps: dict[str, DataFrame], by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """One common segmentation of step functions (key, start, value), each holding until its next start: (key, start, end, one
    column a map). A value is null before its map's first start; end is null in the last segment."""
    union = None
    for name in maps:
        part = maps[name].select(*by, "start", *[(F.col("value") if n == name else F.lit(None)).cast("double").alias(n) for n in maps])
        union = part if union is None else union.unionByName(part)
    rows = union.groupBy(*by, "start").agg(*[F.max(n).alias(n) for n in maps])
    rows = rows.withColumn("end", F.col("start"))
    fills = [scan.Fill([n]) for n in maps] + [scan.Fill(["end"], forward=True, own=False)]
    return scan.fill(rows, by, "start", fills, width).select(*by, "start", "end", *maps)


def rle(steps: DataFrame, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Join neighbouring segments (key, start, end, value) of equal value."""
    rows = steps.select(*by, "start", "end", "value", F.floor(F.col("start") / F.lit(width)).alias("__b"))
    return _joined(rows, by, lambda before: before.isNotNull() & before["value"].eqNullSafe(F.col("value")), ["value"])


def capped(steps: DataFrame, most: float, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Values above ``most`` become it; then equal neighbours are joined."""
    return rle(steps.withColumn("value", F.least("value", F.lit(most))), by, width)


def from_lengths(segments: DataFrame, by: list[str] = BY, index: str = "seg_idx", width: int = 1 << 16) -> DataFrame:
    """Coordinates of run lengths (key, index, len, ...): start and end are running sums."""
    rows = scan.prefix_sum(segments, by, index, {"end": "len"}, width)
    return rows.withColumn("start", F.col("end") - F.col("len"))


def filled_tail(segments: DataFrame, lengths: DataFrame, by: list[str] = BY, index: str = "seg_idx", most: int = 2) -> DataFrame:
    """Stretch the last run of each key to the key's length, if that misses at most ``most`` and isn't exceeded."""
    total = segments.groupBy(*by).agg(F.sum("len").alias("__sum"), F.max(index).alias("__last")).join(lengths.select(*by, F.col("length").alias("__full")), by)
    gap = F.col("__full") - F.col("__sum")
    stretched = F.when((F.col(index) == F.col("__last")) & (gap > 0) & (gap <= most), F.col("len") + gap).otherwise(F.col("len"))
    return segments.join(F.broadcast(total), by).withColumn("len", stretched).drop("__sum", "__last", "__full")  # one row a key


def not_tiling(segments: DataFrame, lengths: DataFrame, by: list[str] = BY) -> DataFrame:
    """Keys whose run lengths don't sum to the key's length."""
    total = segments.groupBy(*by).agg(F.sum("len").alias("total"))
    return total.join(lengths.select(*by, "length"), by, "full_outer").where(~F.col("total").eqNullSafe(F.col("length")))


def split_long(intervals: DataFrame, longest: int) -> DataFrame:
    """Cut intervals longer than ``longest`` into the fewest near equal parts that aren't."""
    parts = F.ceil((F.col("end") - F.col("start")) / longest)
    rows = intervals.where("start < end").withColumn("__n", parts).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    length = F.col("end") - F.col("start")

    def edge(k: Column) -> Column:
        return F.col("start") + F.floor(length * k / F.col("__n"))

    return rows.withColumn("__s", edge(F.col("__k"))).withColumn("end", edge(F.col("__k") + 1)).withColumn("start", F.col("__s")).drop("__s", "__k", "__n")


def flanks(intervals: DataFrame, upstream: int, inner: int, strand: str = "strand", by: list[str] = BY) -> DataFrame:
    """Stretches ``upstream`` of each interval by its strand, and the first and last ``inner`` places within it."""
    minus = F.col(strand) == "-"
    before = F.struct(F.when(minus, F.col("end")).otherwise(F.greatest(F.col("start") - upstream, F.lit(0))).alias("start"), F.when(minus, F.col("end") + upstream).otherwise(F.col("start")).alias("end"))
    head = F.struct(F.col("start"), F.least(F.col("start") + inner, F.col("end")).alias("end"))
    tail = F.struct(F.greatest(F.col("end") - inner, F.col("start")).alias("start"), F.col("end"))
    return intervals.select(*by, F.inline(F.array(before, head, tail))).where("end - start > 1")


def _fold(intervals: DataFrame, by: list[str], touching: bool, fold, schema: str, width: int = WIDTH) -> DataFrame:
    """A sequential pass, in order of start and end, over each run of overlapping intervals (``touching``: or touching ones), one Arrow
    group a run: nothing is carried from one run to the next."""
    rows = overlap_groups(intervals, by, width, touching)
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy(*by, "group").applyInPandas(lambda pdf: pd.DataFrame(list(fold(pdf.sort_values(["start", "end"]))), columns=names), schema)


def merge_weighted(intervals: DataFrame, width: int = WIDTH) -> DataFrame:
    """Join touching and overlapping (chrom, start, end, value); the value is the mean by length, rounded half up after each join, and
    a run's length takes in the gaps that it bridges. Each mean depends on the one before, so a run is one group."""

    def fold(pdf: pd.DataFrame) -> Iterator[tuple]:
        run = None
        for c, s, e, v in pdf[["chrom", "start", "end", "value"]].itertuples(index=False):
            if run is None:
                run = [c, s, e, int(v)]
            else:
                own, new = run[2] - run[1], e - s
                run[3] = int(0.5 + (run[3] * own + v * new) / (own + new))
                run[2] = max(run[2], e)
        yield tuple(run)

    return _fold(intervals, ["chrom"], True, fold, f"chrom {intervals.schema['chrom'].dataType.simpleString()}, start long, end long, value long", width)


def without_gaps(intervals: DataFrame, lengths: DataFrame, width: int = WIDTH) -> DataFrame:
    """After ``merge_weighted``, stretch each start to the end before it (the first to 0), and the last end to the key's length."""
    merged = scan.neighbour(merge_weighted(intervals, width), ["chrom"], "start", "end", "__before", width)
    last = merged.groupBy("chrom").agg(F.max("start").alias("__last")).join(lengths.select("chrom", "length"), "chrom")
    merged = merged.join(F.broadcast(last), "chrom")  # one row a key
    return merged.select("chrom", F.coalesce("__before", F.lit(0)).alias("start"), F.when(F.col("start") == F.col("__last"), F.col("length")).otherwise(F.col("end")).alias("end"), "value")


def nonredundant(genes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Greedy by start: of genes (chrom, start, end, size, name) that overlap the one kept last, the larger stays."""

    def fold(pdf: pd.DataFrame) -> Iterator[tuple]:
        kept = None
        for row in pdf[["chrom", "start", "end", "size", "name"]].itertuples(index=False):
            if kept is None or row.start >= kept.end:
                if kept is not None:
                    yield tuple(kept)
                kept = row
            elif row.size > kept.size:
                kept = row
        if kept is not None:
            yield tuple(kept)

    return _fold(genes, ["chrom"], False, fold, f"chrom {genes.schema['chrom'].dataType.simpleString()}, start long, end long, size long, name string", width)


def overlap_groups(intervals: DataFrame, by: list[str] = BY, width: int = WIDTH, touching: bool = False) -> DataFrame:
    """Add group: the number of the run of strictly overlapping intervals that a row is in (transcripts of one gene). ``touching``:
    touching ones are in one run too."""
    rows = scan.running_max(intervals, by, "start", "end", "__before", width, ["end"])
    ended = F.col("start") > F.col("__before") if touching else F.col("start") >= F.col("__before")
    rows = rows.withColumn("__new", F.when(F.col("__before").isNull() | ended, 1).otherwise(0))
    rows = rows.withColumn("__rest", 1 - F.col("__new"))
    return scan.prefix_sum(rows, by, "start", {"group": "__new"}, width, ["end", "__rest"]).drop("__new", "__before", "__rest")
