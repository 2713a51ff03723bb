"""Queries over the derived operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators import derived as d
from segspark.operators import lookup
from segspark.plans import views as v
from segspark.plans.windows import _FILLED, folded

EPOCHS, SIZES = [0.0, 500.0, 2000.0], [10000.0, 3000.0, 15000.0]


def coalescence_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.segments(spark, sf_dir).select("chrom", "pos", F.exp("b1").alias("b"))
    return rows.select("chrom", "pos", F.round(d.coalescence_time(F.col("b"), EPOCHS, SIZES), 3).alias("t"))


def blocks_by_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir).withColumn("het", g.het_pairs(F.col("n"), F.col("alt")))
    return d.blocks_by_bins(rows, F.floor((F.col("pos") - 1) / 250), F.floor(F.col("alt") / 10), ["het"], ["chrom"])


def arm_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    centromeres = spark.range(5).select(F.col("id").alias("chrom"), (900 + F.col("id") * 10).alias("start"), (1000 + F.col("id") * 20).alias("end"), F.lit(v.LENGTH).alias("length"))
    rows = d.arm_position(v.segments(spark, sf_dir).select("chrom", "pos", "het"), centromeres)
    return rows.select("chrom", "pos", F.col("telomere").cast("long").alias("telomere"), F.round("arm", 6).alias("arm"))


def changed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.sum("alt").alias("alt"))
    return d.changed_from_previous(rows, 0.5, "alt", width=256)


def changed_rates_from_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.sum("alt").alias("alt"))
    return d.changed_from_kept(d.changed_from_previous(rows, 0.0, "alt", width=256), 0.5, "alt")


def corrected_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir).groupBy("chrom", F.floor((F.col("pos") - 1) / 100).cast("long").alias("win")).agg(F.avg((F.col("alt") > 30).cast("double")).alias("share"))
    return rows.select("chrom", "win", F.round(d.jukes_cantor(F.col("share")), 6).alias("divergence"))


def class_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda c: F.element_at(F.array(*map(F.lit, g.BASES)), (F.col(c) % 4 + 1).cast("int"))
    rows = v.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), letter("l_partkey").alias("from"), letter("l_orderkey").alias("to"), F.lit(1).alias("count"))
    out = d.rates_by_class(rows, ["chrom"])
    return out.select("chrom", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def longer_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.without_smallest(v.intervals_b(spark, sf_dir), 0.3)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def points_in_intervals_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites within annotation intervals, by label and kind of site: an annotated set and the rest."""
    inside = lookup.in_interval(v.sites(spark, sf_dir).select("chrom", "pos", "kind"), _disjoint(spark, sf_dir), width=256)
    return inside.groupBy("kind", "inside").agg(F.count("*").alias("n"))


def _disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.operators.intervals import merge

    return merge(v.intervals_p(spark, sf_dir), width=256)


def rebinned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir).groupBy("chrom", F.floor((F.col("pos") - 1) / 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return d.rebinned(rows, 100, "bin", "n", ["chrom"])


QUERIES = {f.__name__: f for f in (coalescence_times, blocks_by_bins, arm_positions, changed_rates, changed_rates_from_kept, corrected_divergence, class_rates, longer_intervals, points_in_intervals_by_label, rebinned_windows)}

_D = "cast({} as double)".format
_T0, _T1 = f"exp(-{_D(500)} / ({_D(20000)} * exp(b1)))", f"exp(-{_D(1500)} / ({_D(6000)} * exp(b1)))"
_X = "substr('ACGT', cast({c} % 4 + 1 as int), 1)"
_FOLD = f"case when a in ('G', 'T') then concat(translate(a, 'ACGT', 'TGCA'), translate(b, 'ACGT', 'TGCA')) else concat(a, b) end"
ORACLE_SQL = {
    "coalescence_times": f"with {v.SEGMENTS} select chrom, pos, round(({_D(20000)} * exp(b1) - {_T0} * ({_D(20000)} * exp(b1) + 500)) + {_T0} * (({_D(6000)} * exp(b1) + 500) - {_T1} * ({_D(6000)} * exp(b1) + 2000)) + {_T0} * {_T1} * ({_D(30000)} * exp(b1) + 2000), 3) as t from segs",
    "blocks_by_bins": f"with {v.SITES} select chrom, (pos - 1) // 250 as block, alt // 10 as bin, count(*) as n, cast(sum(alt * (n - alt)) as bigint) as het from sites group by 1, 2, 3",
    "arm_positions": f"with {v.SEGMENTS}, m as (select chrom, pos, (900 + chrom * 10 + 1000 + chrom * 20) / {_D(2)} as m from segs) select chrom, pos, least(pos, {v.LENGTH} - pos) as telomere, round(case when pos < m then (m - pos) / m else (pos - m) / ({v.LENGTH} - m) end, 6) as arm from m",
    "changed_rates": f"with {v.SITES}, s as (select chrom, pos, cast(sum(alt) as bigint) as alt from sites group by 1, 2), l as (select *, lag(alt) over (partition by chrom order by pos) as p from s) select chrom, pos, alt from l where p is null or (p <> alt and (p = 0 or abs(alt - p) > {_D(0.5)} * abs(p)))",
    "corrected_divergence": f"with {v.SITES}, s as (select chrom, (pos - 1) // 100 as win, avg(case when alt > 30 then {_D(1)} else {_D(0)} end) as p from sites group by 1, 2) select chrom, win, round(case when p < {_D(0.75)} then {_D(-0.75)} * ln(1 - 4 * p / 3) end, 6) as divergence from s",
    "class_rates": f"with r as (select l_suppkey % 5 as chrom, {_X.format(c='l_partkey')} as a, {_X.format(c='l_orderkey')} as b from lineitem), f as (select chrom, {_FOLD} as c from r) select chrom, " + ", ".join(f"round(cast(sum(case when c = '{c}' then 1 else 0 end) as double) / cast(sum(case when c[1] = '{c[0]}' then 1 else 0 end) as double), 6) as \"{c}\"" for c in ("AC", "AG", "AT", "CA", "CG", "CT")) + " from f group by chrom",
    "longer_intervals": f"with {v.INTERVALS}, c as (select quantile_cont(\"end\" - \"start\", 0.3) as c from iv_b) select chrom, count(*) as n, cast(sum(\"end\" - \"start\") as bigint) as bases from iv_b, c where \"end\" - \"start\" >= c group by chrom",
    "points_in_intervals_by_label": f"with {v.SITES}, {v.INTERVALS}, d as (select chrom, pos, kind, count(*) as k from sites group by 1, 2, 3), m as (select *, exists (select 1 from iv_p i where i.chrom = d.chrom and i.\"start\" <= d.pos and i.\"end\" > d.pos) as inside from d) select kind, inside, cast(sum(k) as bigint) as n from m group by 1, 2",
}
ORACLE_SQL["rebinned_windows"] = f"with recursive {v.SITES}, u as (select *, row_number() over (partition by chrom order by bin) as k from (select chrom, (pos - 1) // 10 as bin, count(*) as n from sites group by 1, 2)), {_FILLED.format(m=100)} select chrom, min(bin) as first, max(bin) as last, cast(sum(n) as bigint) as n from f group by chrom, g"
_KEEPS = "r.alt <> s.held and (s.held = 0 or abs(r.alt - s.held) > 0.5::double * abs(s.held))"
_KEPT = folded("u", {"held": ("r.alt", f"case when {_KEEPS} then r.alt else s.held end"), "pos": ("r.pos", "r.pos"), "alt": ("r.alt", "r.alt"), "kept": ("true", _KEEPS)})
ORACLE_SQL["changed_rates_from_kept"] = f"with recursive {v.SITES}, u as (select *, row_number() over (partition by chrom order by pos) as k from (select chrom, pos, cast(sum(alt) as bigint) as alt from sites group by 1, 2)), {_KEPT} select chrom, pos, alt from f where kept"
