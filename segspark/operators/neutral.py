"""Neutral sites, CpG changes, genetic maps from end to end, and summaries of a fitted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators import lookup, stats
from segspark.operators.intervals import BY, WIDTH, subtract
from segspark.operators.model import Model, simulated


def transition_at_cpg(ref: Column, alt: Column) -> Column:
    """Whether a change is one of those that CpG sites suffer, C to T or G to A."""
    return F.coalesce(F.concat(ref, alt).isin("CT", "GA"), F.lit(False))


def neutral_sites(sites: DataFrame, kept: DataFrame, removed: DataFrame | None = None, without_cpg: bool = False, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Sites (key, pos, ref, alt, ...) inside the intervals ``kept`` and outside ``removed`` (islands, filters), with all their columns;
    ``without_cpg``: changes of the CpG kind are left out too. All masks are one sweep and one lookup."""
    mask = subtract(kept, removed if removed is not None else kept.limit(0), by, width)
    rows = lookup.in_interval(sites.where(~transition_at_cpg(F.col("ref"), F.col("alt"))) if without_cpg else sites, mask, by, width=width)
    return rows.where("inside").drop("inside")


def cpg_changes(sites: DataFrame, bases: DataFrame, by: list[str] = BY) -> DataFrame:
    """Sites with a change of the CpG kind whose neighbour in the reference confirms it: C to T before a G, G to A after a C.
    ``bases``: (key, pos, base). An equi-join on the neighbour's place."""
    rows = sites.where(transition_at_cpg(F.col("ref"), F.col("alt"))).withColumn("__at", F.col("pos") + F.when(F.col("ref") == "C", 1).otherwise(-1))
    beside = bases.select(*by, F.col("pos").alias("__at"), F.col("base").alias("__base"))
    wanted = F.when(F.col("ref") == "C", "G").otherwise("C")
    return rows.join(beside, [*by, "__at"]).where(F.col("__base") == wanted).drop("__at", "__base")


def cpg_places(bases: DataFrame, by: list[str] = BY) -> DataFrame:
    """(key, pos, base): the C and the G of every C that a G follows, from (key, pos, base), by an equi-join on the next place."""
    letter = F.upper("base")
    c, g = (bases.where(letter == x).select(*by, F.col("pos").alias("pos"), F.lit(x).alias("base")) for x in "CG")
    at = c.join(g.select(*by, (F.col("pos") - 1).alias("pos")), [*by, "pos"]).select(*by, "pos").distinct()
    return at.select(*by, F.inline(F.array(F.struct(F.col("pos"), F.lit("C").alias("base")), F.struct((F.col("pos") + 1).alias("pos"), F.lit("G").alias("base")))))


def variable_share(places: DataFrame, variable: DataFrame, by: list[str] = BY) -> DataFrame:
    """(key, places, share): of the distinct places (key, pos), how many are among those of ``variable``."""
    marked = places.select(*by, "pos").distinct().join(variable.select(*by, "pos").distinct().withColumn("__hit", F.lit(1.0)), [*by, "pos"], "left")
    return marked.groupBy(*by).agg(F.count("*").alias("places"), F.avg(F.coalesce("__hit", F.lit(0.0))).alias("share"))


def conversion_biased(ref: Column, alt: Column) -> Column:
    """Whether gene conversion favours one letter of a change: one of A and T against one of C and G; unknown letters: false."""
    weak, strong = ["A", "T"], ["C", "G"]
    a, b = F.upper(ref), F.upper(alt)
    return F.coalesce((a.isin(weak) & b.isin(strong)) | (a.isin(strong) & b.isin(weak)), F.lit(False))


def without_biased(sites: DataFrame, opposite: bool = False) -> DataFrame:
    """Sites without changes that gene conversion favours (``opposite``: without those it doesn't); sites that don't vary stay."""
    biased, varies = conversion_biased(F.col("ref"), F.col("alt")), F.coalesce(F.col("ref") != F.col("alt"), F.lit(False))
    return sites.where(~varies | (biased if opposite else ~biased))


def enough_data(windows: DataFrame, bases: int = 100, subs: int = 1) -> DataFrame:
    """Windows with at least so many bases and substitutions."""
    return windows.where((F.col("bases") >= bases) & (F.col("subs") >= subs))


def constant_rate(segments: DataFrame, weight: str = "sites") -> DataFrame:
    """Segments with their rates replaced by the mean rate by ``weight``."""
    w = F.col(weight).cast("double")
    mean = segments.agg((F.sum(F.col("nu") * w) / F.sum(w)).alias("__nu"))
    return segments.crossJoin(F.broadcast(mean)).withColumn("nu", F.col("__nu")).drop("__nu")  # one row


def genome_places(points: DataFrame, lengths: DataFrame, key: str = "chrom") -> DataFrame:
    """Points with genome_pos: the place in all keys laid end to end in their order, by (key, length), a row a key."""
    from pyspark.sql import Window

    before = F.sum("length").over(Window.orderBy(key)) - F.col("length")  # one row a key
    return points.join(F.broadcast(lengths.select(key, before.alias("__off"))), key).withColumn("genome_pos", F.col("pos") + F.col("__off")).drop("__off")


def flagged_blocks(blocks: DataFrame, size: int, by: list[str] = BY) -> DataFrame:
    """Intervals of the blocks (key, edge, flag) with flag 1; ``edge`` is the number of the block's upper edge, in ``size``."""
    return blocks.where("flag = 1").select(*by, ((F.col("edge") - 1) * size).cast("long").alias("start"), (F.col("edge") * size).cast("long").alias("end"))


def closed_map(knots: DataFrame, lengths: DataFrame, by: list[str] = BY) -> DataFrame:
    """A genetic map (key, pos, rate, gpos) stretched over (key, length): from place 1 at distance 0, with the rate that leads to the
    first knot, to the last place at the last knot's distance, with rate 0."""
    ends = knots.groupBy(*by).agg(F.min("pos").alias("__first"), F.min_by("gpos", "pos").alias("__low"), F.max("pos").alias("__last"), F.max_by("gpos", "pos").alias("__high"))
    ends = ends.join(lengths.select(*by, "length"), by)
    head = ends.where("__first > 1").select(*by, F.lit(1).cast("long").alias("pos"), (F.lit(1e6) * F.col("__low") / F.col("__first")).alias("rate"), F.lit(0.0).alias("gpos"))
    tail = ends.where("__last < length").select(*by, F.col("length").cast("long").alias("pos"), F.lit(0.0).alias("rate"), F.col("__high").alias("gpos"))
    return knots.select(*by, "pos", "rate", "gpos").unionByName(head).unionByName(tail)


def within_map(points: DataFrame, knots: DataFrame, by: list[str] = BY, pos: str = "pos") -> DataFrame:
    """Points strictly between a map's first and last knot."""
    ends = knots.groupBy(*by).agg(F.min("pos").alias("__first"), F.max("pos").alias("__last"))
    rows = points.join(F.broadcast(ends), by)  # one row a key
    return rows.where((F.col(pos) > F.col("__first")) & (F.col(pos) < F.col("__last"))).drop("__first", "__last")


def physical_place(probes: DataFrame, knots: DataFrame, by: list[str] = BY, width: int = WIDTH) -> DataFrame:
    """Add pos: the place of a map distance gpos, by linear interpolation between knots, cut to a whole number."""
    return lookup.interpolate(probes, knots, "gpos", "pos", by, width).withColumn("pos", F.col("pos").cast("long"))


def effect_summary(weights: DataFrame, by: list[str], value: str, log_weight: str) -> DataFrame:
    """Per annotation the total weight, and mean and standard deviation of the selection coefficient under the weights 10^parameter."""
    w = weights.select(*by, F.col(value).cast("double").alias("__v"), F.pow(F.lit(10.0), F.col(log_weight)).alias("__w"))
    total = w.groupBy(*by).agg(F.sum("__w").alias("total"))
    return total.join(stats.weighted(w, "__v", "__w", by).select(*by, "mean", F.sqrt(F.greatest("variance", F.lit(0.0))).alias("sd")), by)


def final_summary(model: Model, segments: DataFrame, p: list[float]) -> DataFrame:
    """One row: mean and variance, by sites, of predicted diversity and of what it would be without selection, and the reduction."""
    theta = F.col("nu") / F.lit(model.parts(p)[2])
    rows = model.predict(segments, p).withColumn("pi0", theta / (1.0 + theta))
    w = F.col("sites").cast("double")
    sums = [f(x).alias(f"{n}{k}") for x in ("pred", "pi0") for n, k, f in ((x, 1, lambda c: F.sum(F.col(c) * w)), (x, 2, lambda c: F.sum(F.col(c) * F.col(c) * w)))]
    one = rows.agg(F.sum(w).alias("w"), (F.sum("het").cast("double") / F.sum(F.col("het") + F.col("hom")).cast("double")).alias("mean_pi"), *sums)
    mean = {x: F.col(f"{x}1") / F.col("w") for x in ("pred", "pi0")}
    return one.select(*[c for x in mean for c in (mean[x].alias(f"mean_{x}"), (F.col(f"{x}2") / F.col("w") - mean[x] * mean[x]).alias(f"var_{x}"))], (1.0 - F.col("mean_pi") / mean["pi0"]).alias("reduction"))


def expected_log_likelihood(binned: DataFrame, pred: str = "pred") -> DataFrame:
    """Per bin the mean log probability of a pair, as observed and as expected if the prediction were true (deterministic counts)."""
    pairs = F.col("het") + F.col("hom")
    het, hom = simulated(F.col(pred), pairs)

    def mean(h: Column, same: Column) -> Column:
        return F.sum(same * F.log1p(-F.col(pred)) + h * F.log(F.col(pred))) / F.sum(pairs)

    return binned.groupBy("bin").agg(mean(F.col("het"), F.col("hom")).alias("observed"), mean(het, hom).alias("expected"))
