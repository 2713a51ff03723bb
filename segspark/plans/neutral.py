"""Queries over neutral sites, CpG changes, genetic maps and summaries of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators import bins
from segspark.operators import neutral as n
from segspark.plans import views as v
from segspark.plans import windows as w


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with sites, each with a reference and another base made of its parts' and orders' numbers."""
    letters = F.array(*map(F.lit, g.BASES))
    rows = v.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), (F.datediff("l_shipdate", F.lit(v.ORIGIN).cast("date")) + 1).cast("long").alias("pos"), "l_partkey", "l_orderkey")
    rows = rows.groupBy("chrom", "pos").agg(F.min("l_partkey").alias("p"), F.max("l_orderkey").alias("o"))
    return rows.select("chrom", "pos", *[F.element_at(letters, (F.col(c) % 4 + 1).cast("int")).alias(x) for c, x in (("p", "ref"), ("o", "alt"))])


def neutral_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.neutral_sites(_changes(spark, sf_dir), v.intervals_a(spark, sf_dir), v.intervals_p(spark, sf_dir), without_cpg=True, width=256)


def cpg_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir)
    return n.cpg_changes(rows, rows.select("chrom", "pos", F.col("ref").alias("base")))


def flagged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose sites have a mean rate over 0.14, in whole hundredths, so that no order of summation decides."""
    rows = v.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), (F.datediff("l_shipdate", F.lit(v.ORIGIN).cast("date")) + 1).alias("pos"), F.round(F.col("l_tax") * 100).cast("long").alias("t"))
    rows = rows.groupBy("chrom", (F.floor(F.col("pos") / 50) + 1).alias("edge")).agg((F.sum("t") > 4 * F.count("t")).cast("int").alias("flag"))
    return n.flagged_blocks(rows, 50)


def _knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.knots(spark, sf_dir).withColumn("rate", F.col("gpos") / F.col("pos"))


def closed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spark.range(5).select(F.col("id").alias("chrom"), F.lit(v.LENGTH).cast("long").alias("length"))
    return n.closed_map(_knots(spark, sf_dir), lengths).select("chrom", "pos", F.round("rate", 6).alias("rate"), "gpos")


def sites_within_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.within_map(v.segments(spark, sf_dir).select("chrom", "pos", "sites"), v.knots(spark, sf_dir))


def physical_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = v.knots(spark, sf_dir)
    return n.physical_place(knots.select("chrom", (F.col("gpos") - 0.5).alias("gpos")), knots, width=4096)


def effect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = n.effect_summary(v.table(spark, sf_dir, "part").withColumn("p", -F.col("p_retailprice") / 1000.0), ["p_brand"], "p_size", "p")
    return rows.select("p_brand", *[F.round(c, 6).alias(c) for c in ("total", "mean", "sd")])


def final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = n.final_summary(w.MODEL, v.segments(spark, sf_dir), w.PARAMETERS)
    return rows.select(*[F.round(c, 8).alias(c) for c in rows.columns])


def expected_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = w.MODEL.predict(v.segments(spark, sf_dir), w.PARAMETERS).withColumn("pred", F.round("pred", 9))
    found = n.expected_log_likelihood(bins.equal_weight(rows, "pred", ["chrom", "pos"], "sites", 25))
    return found.select("bin", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"))


QUERIES = {f.__name__: f for f in (neutral_sites, cpg_changes, flagged_blocks, closed_map, sites_within_map, physical_places, effect_summary, final_summary, expected_log_likelihood)}

_D = "cast({} as double)".format
_CHANGES = f"""ch as (select chrom, pos, substr('ACGT', cast(p % 4 + 1 as int), 1) as ref, substr('ACGT', cast(o % 4 + 1 as int), 1) as alt from (
  select l_suppkey % 5 as chrom, date_diff('day', date '{v.ORIGIN}', cast(l_shipdate as date)) + 1 as pos, min(l_partkey) as p, max(l_orderkey) as o from lineitem group by 1, 2))"""
_INSIDE = 'exists (select 1 from {t} i where i.chrom = ch.chrom and i."start" <= ch.pos and i."end" > ch.pos)'
_PI0 = f"({w._THETA} / (1 + {w._THETA}))"
_MEANS = {x: f"sum({x} * sites) / cast(sum(sites) as double)" for x in ("pred", "pi0")}
ORACLE_SQL = {
    "neutral_sites": f"with {_CHANGES}, {v.INTERVALS} select chrom, pos, ref, alt from ch where {_INSIDE.format(t='iv_a')} and not {_INSIDE.format(t='iv_p')} and concat(ref, alt) not in ('CT', 'GA')",
    "cpg_changes": f"with {_CHANGES} select ch.chrom, ch.pos, ch.ref, ch.alt from ch join ch b on b.chrom = ch.chrom and (ch.ref = 'C' and ch.alt = 'T' and b.pos = ch.pos + 1 and b.ref = 'G' or ch.ref = 'G' and ch.alt = 'A' and b.pos = ch.pos - 1 and b.ref = 'C')",
    "flagged_blocks": f'with {v.SITES} select chrom, pos // 50 * 50 as "start", pos // 50 * 50 + 50 as "end" from sites group by 1, 2, 3 having sum(cast(round(-b2 * 100) as bigint)) > 4 * count(*)',
    "closed_map": f"with {v.KNOTS}, e as (select chrom, min(pos) as first, arg_min(gpos, pos) as low, max(pos) as last, arg_max(gpos, pos) as high from knots group by chrom) select chrom, pos, round(gpos / pos, 6) as rate, gpos from knots union all select chrom, cast(1 as bigint), round(1000000 * low / first, 6), {_D(0)} from e where first > 1 union all select chrom, cast({v.LENGTH} as bigint), {_D(0)}, high from e where last < {v.LENGTH}",
    "sites_within_map": f"with {v.KNOTS}, e as (select chrom, min(pos) as first, max(pos) as last from knots group by chrom) select s.chrom, s.pos, count(*) as sites from sites s join e on s.chrom = e.chrom where s.pos > first and s.pos < last group by 1, 2",
    "physical_places": f"with {v.KNOTS}, l as (select *, lag(pos) over (partition by chrom order by pos) as p0, lag(gpos) over (partition by chrom order by pos) as g0 from knots) select chrom, gpos - {_D(0.5)} as gpos, case when p0 is null then pos else cast(floor(p0 + (pos - p0) * (gpos - {_D(0.5)} - g0) / (gpos - g0)) as bigint) end as pos from l",
    "effect_summary": f"with w as (select p_brand, cast(p_size as double) as v, power({_D(10)}, -p_retailprice / {_D(1000)}) as w from part), m as (select p_brand, sum(w) as total, sum(v * w) / sum(w) as mean from w group by p_brand) select w.p_brand, round(any_value(total), 6) as total, round(any_value(mean), 6) as mean, round(sqrt(sum((v - mean) * (v - mean) * w) / sum(w)), 6) as sd from w join m on w.p_brand = m.p_brand group by w.p_brand",
    "final_summary": f"with {w._PRED}, p as (select *, {_PI0} as pi0 from pred), m as (select {_MEANS['pred']} as a, {_MEANS['pi0']} as b, cast(sum(het) as double) / cast(sum(het + hom) as double) as c from p) select round(any_value(a), 8) as mean_pred, round(sum((pred - a) * (pred - a) * sites) / cast(sum(sites) as double), 8) as var_pred, round(any_value(b), 8) as mean_pi0, round(sum((pi0 - b) * (pi0 - b) * sites) / cast(sum(sites) as double), 8) as var_pi0, round(1 - any_value(c / b), 8) as reduction from p, m",
    "expected_log_likelihood": f"with {w._PRED}, r as (select chrom, pos, sites, het, hom, round(pred, 9) as pred from pred), u as (select *, sum(sites) over (order by pred, chrom, pos rows unbounded preceding) as upto, sum(sites) over () as total from r), b as (select *, upto // (total // 25) as bin, (total - 1) // (total // 25) as edges, floor(pred * (het + hom) + {_D(0.5)}) as sh from u) select cast(bin as bigint) as bin, round(sum(hom * ln(1 - pred) + het * ln(pred)) / cast(sum(het + hom) as double), 6) as observed, round(sum((het + hom - sh) * ln(1 - pred) + sh * ln(pred)) / cast(sum(het + hom) as double), 6) as expected from b where bin < edges group by 1",
}
