"""Interval algebra, step functions and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators import bins, intervals as iv, lookup, kernels, maps, stats
from segspark.plans import views as v

W = 256  # bucket width in days: several buckets an axis, so that scans carry across them


def mask_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.islands(v.sites(spark, sf_dir).where("alt > 40"), width=W)


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(v.intervals_a(spark, sf_dir), width=W)


def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.intersect(iv.merge(v.intervals_a(spark, sf_dir), width=W), iv.merge(v.intervals_p(spark, sf_dir), width=W), width=64)


def interval_intersect_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.intersect(iv.merge(v.intervals_a(spark, sf_dir), width=W), iv.merge(v.intervals_p(spark, sf_dir), width=W), width=64, closed=True)


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.subtract(v.intervals_a(spark, sf_dir), v.intervals_b(spark, sf_dir), width=W)


def interval_coverage_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.covered_at_least(v.intervals_a(spark, sf_dir), 3, width=W)


def overlap_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlap_bases(v.intervals_a(spark, sf_dir), v.intervals_b(spark, sf_dir), width=W)


def progressive_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = v.intervals_a(spark, sf_dir), v.intervals_b(spark, sf_dir)
    return iv.progressive(a, [b, v.intervals_p(spark, sf_dir)], width=W)


def segment_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlay({"a": v.steps(v.intervals_a(spark, sf_dir)), "b": v.steps(v.intervals_b(spark, sf_dir))}, width=W)


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.operators.scan import neighbour

    return neighbour(v.steps(v.intervals_b(spark, sf_dir)), ["chrom"], "start", "start", "end", W, after=True).where("end is not null")


def rle_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.rle(_tiled(spark, sf_dir), width=W)


def capped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.capped(_tiled(spark, sf_dir), 2.0, width=W)


def lengths_to_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("chrom"), F.col("o_orderkey").alias("seg_idx"), (F.col("o_orderkey") % 7 + 1).alias("len"))
    return iv.from_lengths(rows, width=512).select("chrom", "seg_idx", "start", "end")


def long_intervals_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.split_long(v.intervals_b(spark, sf_dir), 4).groupBy("chrom", "start", "end").agg(F.count("*").alias("n"))


def overlap_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = iv.overlap_groups(v.intervals_b(spark, sf_dir), width=W)
    return rows.groupBy("chrom", "group").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).drop("group")


def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = v.segments(spark, sf_dir).select("chrom", "pos", "sites")
    edges = v.steps(v.intervals_b(spark, sf_dir)).withColumnRenamed("start", "pos")
    return lookup.asof(probes, edges, ["value"], width=W)


def step_lookup_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = v.segments(spark, sf_dir).select("chrom", "pos")
    edges = v.steps(v.intervals_b(spark, sf_dir)).withColumnRenamed("start", "edge")
    return lookup.step_value(probes, edges, width=W)


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = v.points(spark, sf_dir)
    return p.where("event_type <> 'purchase'").select("chrom", "pos", "event_id", "value"), p.where("event_type = 'purchase'")


def nearest_focal_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, focal = _events(spark, sf_dir)
    return lookup.nearest(probes, focal, width=1 << 18).select("event_id", "distance")


def collated_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, focal = _events(spark, sf_dir)
    rows = lookup.nearest(probes, focal, within=200_000, width=1 << 18).withColumn("one", F.lit(1).cast("long"))
    return bins.collated(rows, 20_000, ["one"])


def nearest_interval_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = v.segments(spark, sf_dir).select("chrom", "pos")
    return lookup.nearest_edge(probes, iv.merge(v.intervals_p(spark, sf_dir), width=W), width=W)


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = v.segments(spark, sf_dir).select("chrom", "pos", "het")
    rows = lookup.in_interval(probes, iv.merge(v.intervals_p(spark, sf_dir), width=W), width=W)
    return rows.groupBy("chrom", "inside").agg(F.count("*").alias("n"), F.sum("het").alias("het"))


def gpos_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = v.segments(spark, sf_dir).select("chrom", "pos")
    return lookup.interpolate(probes, v.knots(spark, sf_dir), width=W).select("chrom", "pos", F.round("gpos", 6).alias("gpos"))


def segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean count of alternate alleles of the sites in each segment of a tiling (scores, rates or bases per segment alike)."""
    rows = lookup.assign(v.sites(spark, sf_dir).select("chrom", "pos", "alt"), v.steps(v.intervals_b(spark, sf_dir)), width=W)
    return rows.where("seg is not null").groupBy("chrom", "seg").agg(F.count("*").alias("n"), F.sum("alt").alias("alt"), F.round(F.avg((F.col("alt") > 25).cast("double")), 6).alias("share"))


def sites_kept_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with sites that a conjunction of masks keeps (covered by a, not by b), by a semi-join on intervals."""
    kept = iv.subtract(v.intervals_a(spark, sf_dir), v.intervals_b(spark, sf_dir), width=W)
    rows = lookup.in_interval(v.segments(spark, sf_dir).select("chrom", "pos", "sites"), kept, width=W)
    return rows.where("inside").select("chrom", "pos", "sites")


def kernel_sum_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, focal = _events(spark, sf_dir)
    rows = maps.kernel_sum(probes, focal, 50_000, F.exp(-F.col("dist") / 10_000.0))
    return rows.select("chrom", "pos", "sources", F.round("total", 6).alias("total"))


def b_kernel_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, focal = _events(spark, sf_dir)
    r = g.haldane(F.col("dist") / 1_000_000.0)
    rows = maps.kernel_sum(probes, focal, 50_000, g.background_kernel(r, 0.01) / 100.0)
    return rows.select("chrom", "pos", F.round("total", 6).alias("total"))


def b_kernel_sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kernel over all sources, however far, within 1e-11 of its largest value times their number."""
    probes, focal = _events(spark, sf_dir)
    rows = kernels.smooth_sum(probes, focal, lambda d: g.background_kernel(g.haldane(d / 1_000_000.0), 0.01) / 100.0, 20_000, 1e-11)
    return rows.select("chrom", "pos", F.round("total", 6).alias("total"))


def sweep_kernel_sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, focal = _events(spark, sf_dir)
    rows = kernels.exponential_sum(probes, focal, 1e-4)
    return rows.select("chrom", "pos", F.round("total", 6).alias("total"))


def composite_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.operators.scan import neighbour

    rows = v.segments(spark, sf_dir).select("chrom", F.col("pos").alias("start"), "b1", "b2")
    rows = neighbour(rows, ["chrom"], "start", "start", "end", W, after=True).where("end is not null")
    return maps.composite(rows, F.col("b1") * 2.0 + F.col("b2") * 3.0, 20)


def conserved_per_map_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.segments(spark, sf_dir)
    found = lookup.interpolate(s.select("chrom", "pos", "poly", "sites"), v.knots(spark, sf_dir), width=W)
    return maps.conserved_per_bin({"several": found.where("sites > 1"), "single": found.where("sites = 1")}, 64.0)


def rate_windows_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir)
    spans = spark.range(5).select(F.col("id").alias("chrom"), F.lit(0).cast("long").alias("first"), F.lit(v.LENGTH // 20 - 1).cast("long").alias("last"))
    found = stats.windows_filled(rows, spans, 20, ["chrom"], "pos", F.col("alt") > 20)
    return found.select("chrom", "window", "bases", "subs", F.round("rate", 6).alias("rate"))


QUERIES = {f.__name__: f for f in (mask_islands, interval_merge, interval_intersect, interval_intersect_closed, interval_subtract, interval_coverage_k, overlap_bases, progressive_filters, segment_overlay, rle_collapse, capped_map, lengths_to_coordinates, long_intervals_split, overlap_group_sizes, asof_lookup, step_lookup_clamped, nearest_focal_distance, collated_bins, nearest_interval_edge, point_in_interval, gpos_interpolation, segment_means, sites_kept_by_mask, kernel_sum_limited, b_kernel_sum, b_kernel_sum_all, sweep_kernel_sum_all, composite_map, conserved_per_map_bin, rate_windows_filled)}


def _merged(name: str, source: str, where: str = "true") -> str:
    return f"""{name}_0 as (select *, max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as m from {source} where {where}),
{name}_1 as (select *, sum(case when m is null or "start" > m then 1 else 0 end) over (partition by chrom order by "start", "end" rows unbounded preceding) as run from {name}_0),
{name} as (select chrom, min("start") as "start", max("end") as "end" from {name}_1 group by chrom, run)"""


def _swept(name: str, sets: dict[str, tuple[str, str]], keep: str) -> str:
    """sets: name -> (source, condition). Places as days: a day is kept if ``keep`` holds for the counts of intervals over it."""
    counts = ", ".join(f"(select count(*) from {s} where {s}.chrom = c.chrom and {s}.\"start\" <= d.day and {s}.\"end\" > d.day and {w}) as {n}" for n, (s, w) in sets.items())
    return f"""{name}_d as (select c.chrom, d.day, {counts} from (select unnest(generate_series(0, 4)) as chrom) c, (select unnest(generate_series(0, 2700)) as day) d),
{name}_k as (select chrom, day, day - row_number() over (partition by chrom order by day) as g from {name}_d where {keep}),
{name} as (select chrom, min(day) as "start", max(day) + 1 as "end" from {name}_k group by chrom, g)"""


_PROBES = f"{v.POINTS}, probes as (select * from points where event_type <> 'purchase'), focal as (select distinct chrom, pos from points where event_type = 'purchase')"
_NEAR = f"{_PROBES}, near as (select p.event_id, case when up is null then down when down is null then up when up <= -down then up else down end as distance from (select event_id, (select min(f.pos) - p.pos from focal f where f.chrom = p.chrom and f.pos >= p.pos) as up, (select max(f.pos) - p.pos from focal f where f.chrom = p.chrom and f.pos <= p.pos) as down from probes p) p)"
_TILED = f"{v.STEPS}, tiled as (select * from (select chrom, \"start\", lead(\"start\") over (partition by chrom order by \"start\") as \"end\", value from map_b) where \"end\" is not null)"
_KERNEL = f"{_PROBES}, g as (select distinct chrom, pos from probes), w as (select chrom, pos, count(*) as w from points where event_type = 'purchase' group by chrom, pos), j as (select g.chrom, g.pos, coalesce(sum(w), 0) as sources, coalesce(sum(w * ({{k}})), 0) as total from g left join w on g.chrom = w.chrom and abs(g.pos - w.pos) <= 50000 group by g.chrom, g.pos)"
_KERNEL_ALL = _KERNEL.replace(" and abs(g.pos - w.pos) <= 50000", "")


def _rle(source: str) -> str:
    return f"r0 as (select *, lag(value) over (partition by chrom order by \"start\") as p from {source}), r1 as (select *, sum(case when p is null or p <> value then 1 else 0 end) over (partition by chrom order by \"start\" rows unbounded preceding) as run from r0) select chrom, min(\"start\") as \"start\", max(\"end\") as \"end\", any_value(value) as value from r1 group by chrom, run"


ORACLE_SQL = {
    "mask_islands": f"with {v.SITES}, d as (select distinct chrom, pos from sites where alt > 40), k as (select *, pos - row_number() over (partition by chrom order by pos) as g from d) select chrom, min(pos) as \"start\", max(pos) + 1 as \"end\" from k group by chrom, g",
    "interval_merge": f"with {v.INTERVALS}, {_merged('m', 'iv_a')} select * from m",
    "interval_intersect": f"with {v.INTERVALS}, {_merged('x', 'iv_a')}, {_merged('y', 'iv_p')} select x.chrom, greatest(x.\"start\", y.\"start\") as \"start\", least(x.\"end\", y.\"end\") as \"end\" from x join y on x.chrom = y.chrom and x.\"start\" < y.\"end\" and y.\"start\" < x.\"end\"",
    "interval_intersect_closed": f"with {v.INTERVALS}, {_merged('x', 'iv_a')}, {_merged('y', 'iv_p')} select x.chrom, greatest(x.\"start\", y.\"start\") as \"start\", least(x.\"end\", y.\"end\") as \"end\" from x join y on x.chrom = y.chrom and x.\"start\" <= y.\"end\" and y.\"start\" <= x.\"end\"",
    "interval_subtract": f"with {v.INTERVALS}, {_swept('s', {'a': ('iv_a', 'true'), 'b': ('iv_b', 'true')}, 'a > 0 and b = 0')} select * from s",
    "interval_coverage_k": f"with {v.INTERVALS}, {_swept('s', {'a': ('iv_a', 'true')}, 'a >= 3')} select * from s",
    "overlap_bases": f"with {v.INTERVALS}, {_swept('s', {'a': ('iv_a', 'true'), 'b': ('iv_b', 'true')}, 'true')} select chrom, cast(sum(case when a > 0 then 1 else 0 end) as bigint) as bases_a, cast(sum(case when b > 0 then 1 else 0 end) as bigint) as bases_b, cast(sum(case when a > 0 and b > 0 then 1 else 0 end) as bigint) as bases_both from s_d group by chrom",
    "progressive_filters": f"with {v.INTERVALS}, {_swept('s', {'a': ('iv_a', 'true'), 'b': ('iv_b', 'true'), 'c': ('iv_p', 'true')}, 'true')} select 0 as step, count(*) as bases from s_d where a > 0 union all select 1, count(*) from s_d where a > 0 and b > 0 union all select 2, count(*) from s_d where a > 0 and b > 0 and c > 0",
    "segment_overlay": f"with {v.STEPS}, p as (select chrom, \"start\" from map_a union select chrom, \"start\" from map_b) select p.chrom, p.\"start\", lead(p.\"start\") over (partition by p.chrom order by p.\"start\") as \"end\", (select arg_max(a.value, a.\"start\") from map_a a where a.chrom = p.chrom and a.\"start\" <= p.\"start\") as a, (select arg_max(b.value, b.\"start\") from map_b b where b.chrom = p.chrom and b.\"start\" <= p.\"start\") as b from p",
    "rle_collapse": f"with {_TILED}, {_rle('tiled')}",
    "capped_map": f"with {_TILED}, c as (select chrom, \"start\", \"end\", least(value, cast(2.0 as double)) as value from tiled), {_rle('c')}",
    "lengths_to_coordinates": "select o_custkey % 5 as chrom, o_orderkey as seg_idx, cast(sum(o_orderkey % 7 + 1) over w as bigint) - (o_orderkey % 7 + 1) as \"start\", cast(sum(o_orderkey % 7 + 1) over w as bigint) as \"end\" from orders window w as (partition by o_custkey % 5 order by o_orderkey rows unbounded preceding)",
    "long_intervals_split": f"with {v.INTERVALS}, p as (select *, (\"end\" - \"start\" + 3) // 4 as k, \"end\" - \"start\" as l from iv_b), q as (select *, unnest(generate_series(0, k - 1)) as i from p) select chrom, \"start\" + l * i // k as \"start\", \"start\" + l * (i + 1) // k as \"end\", count(*) as n from q group by 1, 2, 3",
    "overlap_group_sizes": f"""with {v.INTERVALS}, f as (select *, max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as m from iv_b), h as (select *, sum(case when m is null or "start" >= m then 1 else 0 end) over (partition by chrom order by "start", "end" rows unbounded preceding) as run from f) select chrom, count(*) as n, min("start") as "start", max("end") as "end" from h group by chrom, run""",
    "asof_lookup": f"with {v.SEGMENTS}, {v.STEPS} select s.chrom, s.pos, s.sites, (select arg_max(b.value, b.\"start\") from map_b b where b.chrom = s.chrom and b.\"start\" <= s.pos) as value from segs s",
    "step_lookup_clamped": f"with {v.SEGMENTS}, {v.STEPS}, e as (select * from map_b) select s.chrom, s.pos, coalesce((select arg_min(b.value, b.\"start\") from e b where b.chrom = s.chrom and b.\"start\" >= s.pos), (select arg_max(b.value, b.\"start\") from e b where b.chrom = s.chrom)) as value from segs s",
    "nearest_focal_distance": f"with {_NEAR} select event_id, distance from near",
    "collated_bins": f"with {_NEAR} select cast(floor(cast(distance as double) / 20000) as bigint) as bin, count(*) as n, count(*) as one from near where abs(distance) <= 200000 group by 1",
    "nearest_interval_edge": f"""with {v.SEGMENTS}, {v.INTERVALS}, {_merged('m', 'iv_p')}, u as (select s.chrom, s.pos, (select min(m."start") - s.pos from m where m.chrom = s.chrom and m."start" > s.pos) as up, (select max(m."end") - 1 - s.pos from m where m.chrom = s.chrom and m."start" <= s.pos) as down from segs s where not exists (select 1 from m where m.chrom = s.chrom and m."start" <= s.pos and m."end" > s.pos)) select chrom, pos, case when up is null then down when down is null then up when -down < up then down else up end as distance from u""",
    "point_in_interval": f"""with {v.SEGMENTS}, {v.INTERVALS} select chrom, inside, count(*) as n, cast(sum(het) as bigint) as het from (select s.chrom, s.het, exists (select 1 from iv_p where iv_p.chrom = s.chrom and iv_p."start" <= s.pos and iv_p."end" > s.pos) as inside from segs s) group by chrom, inside""",
    "gpos_interpolation": f"""with {v.KNOTS}, p as (select distinct chrom, pos from sites), b as (select p.*, (select max(k.pos) from knots k where k.chrom = p.chrom and k.pos <= p.pos) as x0, (select min(k.pos) from knots k where k.chrom = p.chrom and k.pos >= p.pos) as x1 from p) select b.chrom, b.pos, round(case when x0 is null then k1.gpos when x1 is null or x1 = x0 then k0.gpos else k0.gpos + (k1.gpos - k0.gpos) * (b.pos - x0) / cast(x1 - x0 as double) end, 6) as gpos from b left join knots k0 on k0.chrom = b.chrom and k0.pos = x0 left join knots k1 on k1.chrom = b.chrom and k1.pos = x1""",
    "segment_means": f"""with {v.SITES}, {v.STEPS}, d as (select s.chrom, s.alt, (select max(b."start") from map_b b where b.chrom = s.chrom and b."start" <= s.pos) as seg from sites s) select chrom, seg, count(*) as n, cast(sum(alt) as bigint) as alt, round(avg(case when alt > 25 then 1.0::double else 0.0::double end), 6) as share from d where seg is not null group by chrom, seg""",
    "sites_kept_by_mask": f"""with {v.SEGMENTS}, {v.INTERVALS} select chrom, pos, sites from segs s where exists (select 1 from iv_a i where i.chrom = s.chrom and i."start" <= s.pos and i."end" > s.pos) and not exists (select 1 from iv_b i where i.chrom = s.chrom and i."start" <= s.pos and i."end" > s.pos)""",
    "b_kernel_sum_all": f"with {_KERNEL_ALL.format(k='1 / (cast(0.01 as double) * power(1 + cast(99.0 as double) * ((1 - exp(-2 * abs(g.pos - w.pos) / cast(1000000 as double))) / 2), 2)) / 100')} select chrom, pos, round(total, 6) as total from j",
    "sweep_kernel_sum_all": f"with {_KERNEL_ALL.format(k='exp(-abs(g.pos - w.pos) / cast(10000 as double))')} select chrom, pos, round(total, 6) as total from j",
    "kernel_sum_limited": f"with {_KERNEL.format(k='exp(-abs(g.pos - w.pos) / cast(10000 as double))')} select chrom, pos, cast(sources as bigint) as sources, round(total, 6) as total from j",
    "b_kernel_sum": f"with {_KERNEL.format(k='1 / (cast(0.01 as double) * power(1 + cast(99.0 as double) * ((1 - exp(-2 * abs(g.pos - w.pos) / cast(1000000 as double))) / 2), 2)) / 100')} select chrom, pos, round(total, 6) as total from j",
    "composite_map": f"""with {v.SEGMENTS}, t as (select * from (select chrom, pos as "start", lead(pos) over (partition by chrom order by pos) as "end", cast(floor(exp(b1 * 2 + b2 * 3) * 20 + cast(0.5 as double)) as bigint) as value from segs) where "end" is not null), {_rle('t')}""",
    "conserved_per_map_bin": None,
    "rate_windows_filled": f"""with {v.SITES}, c as (select chrom, pos // 20 as win, count(*) as bases, cast(sum(case when alt > 20 then 1 else 0 end) as bigint) as subs from sites group by 1, 2), g as (select c.chrom, d.win from (select unnest(generate_series(0, 4)) as chrom) c, (select unnest(generate_series(0, {v.LENGTH // 20 - 1})) as win) d), r as (select g.chrom, g.win, coalesce(bases, 0) as bases, coalesce(subs, 0) as subs, case when bases > 0 then cast(subs as double) / cast(bases as double) end as own from g left join c on g.chrom = c.chrom and g.win = c.win), f as (select *, last_value(own ignore nulls) over (partition by chrom order by win rows between unbounded preceding and 1 preceding) as b, first_value(own ignore nulls) over (partition by chrom order by win rows between 1 following and unbounded following) as a from r) select chrom, win as "window", bases, subs, round(coalesce(own, case when b is null then a when a is null then b else (a + b) / 2 end), 6) as rate from f""",
}
_GPOS = ORACLE_SQL["gpos_interpolation"]
ORACLE_SQL["conserved_per_map_bin"] = f"with q as ({_GPOS}), c as (select l_suppkey % 5 as chrom, date_diff('day', date '{v.ORIGIN}', cast(l_shipdate as date)) + 1 as pos, count(*) as k from lineitem group by 1, 2) select q.chrom, cast(floor(gpos / 64) as bigint) as bin, cast(sum(case when k > 1 then 1 else 0 end) as bigint) as several, cast(sum(case when k = 1 then 1 else 0 end) as bigint) as single from q join c on q.chrom = c.chrom and q.pos = c.pos group by 1, 2"
