"""Queries over ranges around sites, all pairs of populations, simulated counts and the bootstrap of R^2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators import coding, maps, populations, ranges, resample, simulate
from segspark.plans import neutral
from segspark.plans import views as v
from segspark.plans import windows as w
from segspark.plans.sites import draw_sql


def windows_around_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean count of alternate alleles of the sites within 15 days, and within 40 units of map distance, of each place with sites."""
    sites = v.sites(spark, sf_dir).select("chrom", "pos", "alt")
    rows = ranges.around(sites, sites, v.knots(spark, sf_dir), 15, 40.0, "alt", width=256)
    return rows.select("chrom", "pos", "n_near", F.round("mean_near", 6).alias("mean_near"), "n_map", F.round("mean_map", 6).alias("mean_map"))


def _populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_suppkey") % 5).alias("chrom"), "l_shipdate", (F.col("l_partkey") % 26).alias("pop"), F.lit(100).alias("n"), F.col("l_quantity").cast("long").alias("alt"))


def population_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity within and between 26 populations: a part's number is the population, a chromosome's day the site."""
    rows = populations.pair_matrix(_populations(spark, sf_dir), ["chrom", "l_shipdate"])
    return rows.select("a", "b", "sites", "diff", "pairs", F.round(F.col("diff") / F.col("pairs"), 6).alias("pi"))


def population_pairs_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _populations(spark, sf_dir).withColumns({"pop": F.col("pop") % 4, "seg": F.year("l_shipdate")})
    return populations.pair_matrix(rows, ["chrom", "seg", "l_shipdate"], ["chrom", "seg"])


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w._predicted(spark, sf_dir).withColumn("pred", F.round("pred", 9))


def sim_beta_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.neutral_counts(_segments(spark, sf_dir), "pred", 10, F.col("chrom") * 3001 + F.col("pos"), ["chrom", "pos"])


def sim_two_chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.neutral_counts(_segments(spark, sf_dir), "pred", 2, F.col("chrom") * 3001 + F.col("pos"), ["chrom", "pos"])


def sim_snp_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of simulated polymorphic sites: of each 50 days' places, the share that the mean prediction asks for."""
    rows = _segments(spark, sf_dir).select("chrom", F.floor((F.col("pos") - 1) / 50).alias("win"), "pos", (F.col("pred") * 10**9).cast("decimal(20,0)").alias("nano"))
    wanted = rows.groupBy("chrom", "win").agg(F.floor(F.sum("nano") / 10**9 + 0.5).cast("long").alias("count"))
    return simulate.placed(rows.select("chrom", "win", "pos"), wanted, ["chrom", "win"], F.col("chrom"))


def bootstrap_rsquared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R^2 of windows of 20 days under two parameter vectors, 1,000 draws of groups of five windows, and how often the second gains."""
    rows = v.segments(spark, sf_dir)
    rows = w.MODEL.predict(w.MODEL.predict(rows, [-6.0, 0.1, 0.25], "one"), w.PARAMETERS, "two")
    win = F.floor(F.col("pos") / 20).alias("win")
    windows = rows.groupBy("chrom", win).agg(
        (F.sum("het").cast("double") / F.sum(F.col("het") + F.col("hom")).cast("double")).alias("obs"), *[(F.sum(F.col(p) * F.col("sites")) / F.sum("sites").cast("double")).alias(p) for p in ("one", "two")]
    )
    groups = resample.grouped(windows, ["chrom", "win"], 5, {"one": ("obs", "one"), "two": ("obs", "two")})
    found = resample.compared(resample.bootstrap_r2(groups, 1000, ["one", "two"]), "one", "two")
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


def coding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are genes and their orders exons, of which a second transcript has every other; days hold two letters each."""
    from segspark.plans.neutral import _changes

    start = F.datediff("o_orderdate", F.lit(v.ORIGIN).cast("date")).cast("long")
    rows = v.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("chrom"), F.col("o_custkey").alias("gene"), F.when(F.col("o_custkey") % 2 == 0, "-").otherwise("+").alias("strand"), start.alias("start"), (start + 3 + F.col("o_orderkey") % 7).alias("end"), (F.col("o_orderkey") % 2 == 0).alias("both"))
    rows = rows.withColumn("transcript", F.explode(F.when(F.col("both"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("both")
    letters = _changes(spark, sf_dir).select("chrom", "pos", F.col("ref").alias("q"), F.col("alt").alias("t"))
    found = coding.coding_changes(rows, letters)
    return found.select("gene", "sites", "degeneracy", "syn", "nonsyn", *[v.rounded(F.col(c), 6).alias(c) for c in ("ds", "dn", "dnds")])


def sweep_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps at half-yearly days with sites, on a grid of all of them; map distances are days, a hundredth of a unit each."""
    sites = v.sites(spark, sf_dir).select("chrom", "pos", (F.col("pos") / 100.0).alias("gpos"))
    found = maps.sweep_map(sites, sites.where("pos % 180 = 0").distinct(), 0.05, 20_000.0, delta=0.07)
    return found.select("chrom", "pos", F.round("rate", 6).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (windows_around_sites, population_pairs, population_pairs_by_segment, sim_beta_binomial, sim_two_chromosomes, sim_snp_places, bootstrap_rsquared, coding_changes, sweep_map)
}

_D = "cast({} as double)".format
_U = f"(cast({draw_sql('(chrom * 3001 + pos)', 'k', 1 << 20)} as double) + {_D(0.5)}) / {_D(1 << 20)}"
_EACH = f"{w._PRED}, each as (select chrom, pos, k, p, {_U} as u from (select chrom, pos, round(pred, 9) as p, unnest(range(0, sites)) as k from pred))"
_SUM = "lgamma({} + 1)".format
_PMF = f"exp({_SUM(10)} - {_SUM('a')} - {_SUM('10 - a')} + lgamma(a + p) + lgamma(10 - a + p) - lgamma(10 + 2 * p) - 2 * lgamma(p) + lgamma(2 * p))"
_COUNTS = "select chrom, l_shipdate, pop, sum(n) as n, cast(sum(alt) as bigint) as alt from (select l_suppkey % 5 as chrom, l_shipdate, l_partkey % {m} as pop, 100 as n, cast(l_quantity as bigint) as alt from lineitem) group by all"
_PAIRS = """cast(sum(case when x.pop = y.pop then x.alt * (x.n - x.alt) else x.alt * (y.n - y.alt) + y.alt * (x.n - x.alt) end) as bigint) as diff,
  cast(sum(case when x.pop = y.pop then x.n * (x.n - 1) // 2 else x.n * y.n end) as bigint) as pairs"""
_MET = "c x join c y on x.chrom = y.chrom and x.l_shipdate = y.l_shipdate and x.pop <= y.pop"
_BACK = """(select case when max(k.gpos) filter (k.gpos <= {g}) is null then min(k.pos) when min(k.gpos) filter (k.gpos >= {g}) is null then max(k.pos)
  when max(k.gpos) filter (k.gpos <= {g}) = min(k.gpos) filter (k.gpos >= {g}) then max(k.pos) filter (k.gpos <= {g})
  else floor(max(k.pos) filter (k.gpos <= {g}) + (min(k.pos) filter (k.gpos >= {g}) - max(k.pos) filter (k.gpos <= {g})) * ({g} - max(k.gpos) filter (k.gpos <= {g}))
    / (min(k.gpos) filter (k.gpos >= {g}) - max(k.gpos) filter (k.gpos <= {g}))) end from knots k where k.chrom = b.chrom)"""
_ON_MAP = f"""{v.KNOTS}, p as (select distinct chrom, pos from sites), beside as (select p.*, (select max(k.pos) from knots k where k.chrom = p.chrom and k.pos <= p.pos) as x0,
  (select min(k.pos) from knots k where k.chrom = p.chrom and k.pos >= p.pos) as x1 from p),
  mapped as (select p.chrom, p.pos, case when x0 is null then k1.gpos when x1 is null or x1 = x0 then k0.gpos else k0.gpos + (k1.gpos - k0.gpos) * (p.pos - x0) / cast(x1 - x0 as double) end as gpos
  from beside p left join knots k0 on k0.chrom = p.chrom and k0.pos = x0 left join knots k1 on k1.chrom = p.chrom and k1.pos = x1),
  b as (select chrom, pos, greatest({_D(0)}, gpos - 40) as glow, gpos + 40 as ghigh from mapped)"""
_MEAN = "round(avg({v}), 6)".format
_ROLL = draw_sql("rep", "k", "c")
_R2 = "1 - sum((obs - {m}) * (obs - {m})) / (sum(obs * obs) - sum(obs) * sum(obs) / cast(count(*) as double))".format
_AMINO = f"substr('{g.AMINO_ACIDS}', cast((instr('TCAG', substr({{c}}, 1, 1)) - 1) * 16 + (instr('TCAG', substr({{c}}, 2, 1)) - 1) * 4 + instr('TCAG', substr({{c}}, 3, 1)) as int), 1)"
_SUB = "concat(substr(codon, 1, place), {b}, substr(codon, place + 2))"
_CODING = f"""with {{changes}}, ex as (select o_custkey % 5 as chrom, o_custkey as gene, o_custkey % 2 as fwd, date_diff('day', date '{v.ORIGIN}', cast(o_orderdate as date)) as s, 3 + o_orderkey % 7 as len, unnest(case when o_orderkey % 2 = 0 then [0, 1] else [0] end) as tr from orders),
  pl as (select distinct chrom, gene, tr, fwd, unnest(range(s, s + len)) as pos from ex), ix as (select *, row_number() over (partition by gene, tr order by case when fwd = 1 then pos else -pos end) - 1 as idx from pl),
  le as (select ix.gene, ix.tr, ix.pos, idx // 3 as cod, idx % 3 as place, case when fwd = 1 then ref else translate(ref, 'ACGT', 'TGCA') end as q, case when fwd = 1 then alt else translate(alt, 'ACGT', 'TGCA') end as t from ix join ch on ch.chrom = ix.chrom and ch.pos = ix.pos),
  co as (select *, string_agg(q, '') over w as codon, count(*) over w as n from le window w as (partition by gene, tr, cod order by place rows between unbounded preceding and unbounded following)),
  fi as (select *, row_number() over (partition by gene, pos order by tr) as k from co where n = 3),
  ea as (select gene, q <> t as changed, {_AMINO.format(c='codon')} = {_AMINO.format(c=_SUB.format(b='t'))} as same, {' + '.join(f"case when q <> '{b}' and {_AMINO.format(c='codon')} = {_AMINO.format(c=_SUB.format(b=f"'{b}'"))} then 1 else 0 end" for b in 'ACGT')} as deg from fi where k = 1),
  su as (select gene, count(*) as sites, cast(sum(deg) as bigint) as degeneracy, count(*) filter (changed and same) as syn, count(*) filter (changed and not same) as nonsyn from ea group by gene),
  ra as (select *, case when syn > 0 then cast(syn as double) / degeneracy else 0 end as ds, case when syn > 0 then cast(nonsyn as double) / (3 * sites - degeneracy) else 0 end as dn from su)
  select gene, sites, degeneracy, syn, nonsyn, round(ds, 6) as ds, round(dn, 6) as dn, round(case when syn > 0 then dn / ds else 0 end, 6) as dnds from ra"""
_TIME = f"{_D(g.sweep_time(0.05, 20_000.0))}"
ORACLE_SQL = {
    "coding_changes": _CODING.format(changes=neutral._CHANGES),
    "sweep_map": f"with {v.SITES}, u as (select distinct chrom, pos, pos / {_D(100)} as g from sites), c as (select *, cast(floor((g - min(g) over (partition by chrom)) / {_D(0.07)}) as bigint) as cell from u), "
    "k as (select *, lag(cell) over w as p, lead(cell) over w as n from c window w as (partition by chrom order by g)), kept as (select * from k where p is null or n is null or p <> cell or n <> cell) "
    f"select k.chrom, k.pos, round(coalesce(sum(exp(-abs(k.g - u.g) * {_TIME})), 0), 6) as rate from kept k left join u on u.chrom = k.chrom and u.pos % 180 = 0 group by 1, 2",
    "windows_around_sites": (
        f"with {_ON_MAP}, "
        f"e as (select chrom, pos, cast({_BACK.format(g='b.glow')} as bigint) as low, cast({_BACK.format(g='b.ghigh')} as bigint) as high from b), "
        "near as (select e.chrom, e.pos, count(s.alt) as n_near, round(avg(s.alt), 6) as mean_near from e left join sites s on s.chrom = e.chrom and s.pos >= e.pos - 15 and s.pos < e.pos + 15 group by 1, 2), "
        "far as (select e.chrom, e.pos, count(s.alt) as n_map, round(avg(s.alt), 6) as mean_map from e left join sites s on s.chrom = e.chrom and s.pos >= e.low and s.pos < e.high group by 1, 2) "
        "select chrom, pos, n_near, mean_near, n_map, mean_map from near join far using (chrom, pos)"
    ),
    "population_pairs": f"with c as ({_COUNTS.format(m=26)}) select x.pop as a, y.pop as b, count(*) as sites, {_PAIRS}, round(cast(diff as double) / pairs, 6) as pi from {_MET} group by 1, 2",
    "population_pairs_by_segment": f"with c as (select chrom, l_shipdate, pop % 4 as pop, sum(n) as n, cast(sum(alt) as bigint) as alt from ({_COUNTS.format(m=26)}) group by all) select x.chrom, cast(year(x.l_shipdate) as int) as seg, x.pop as a, y.pop as b, count(*) as sites, {_PAIRS} from {_MET} group by 1, 2, 3, 4",
    "sim_beta_binomial": f"with {_EACH}, pmf as (select chrom, pos, p, a, {_PMF} as f from (select distinct chrom, pos, p, unnest(range(0, 11)) as a from each)), cdf as (select chrom, pos, a, sum(f) over (partition by chrom, pos order by a) as upto from pmf), "
    "drawn as (select e.chrom, e.pos, e.k, least(10, sum(case when c.upto <= e.u then 1 else 0 end)) as alt from each e join cdf c on c.chrom = e.chrom and c.pos = e.pos group by 1, 2, 3) "
    "select chrom, pos, cast(sum(alt * (10 - alt)) as bigint) as het, cast(count(*) * 45 - sum(alt * (10 - alt)) as bigint) as hom from drawn group by 1, 2",
    "sim_two_chromosomes": f"with {_EACH} select chrom, pos, cast(count(*) filter (u >= 1 - p) as bigint) as het, cast(count(*) filter (u < 1 - p) as bigint) as hom from each group by 1, 2",
    "sim_snp_places": f"with {w._PRED}, r as (select chrom, (pos - 1) // 50 as win, pos, cast(round(round(pred, 9) * 1000000000) as bigint) as nano from pred), t as (select chrom, win, floor(cast(sum(nano) as double) / 1000000000 + {_D(0.5)}) as want from r group by 1, 2), "
    f"k as (select r.chrom, r.win, r.pos, want, row_number() over (partition by r.chrom, r.win order by {draw_sql('r.chrom', 'r.pos', 1 << 20)}, r.pos) as k from r join t on t.chrom = r.chrom and t.win = r.win) select chrom, win, pos from k where k <= want",
    "bootstrap_rsquared": f"with {v.SEGMENTS}, pred as (select *, {w._PI} as two, {w._PI.replace(f'b1 * power({_D(10)}, {_D(0.3)})', f'b1 * power({_D(10)}, {_D(-6)})')} as one from segs), "
    "win as (select chrom, pos // 20 as win, cast(sum(het) as double) / cast(sum(het + hom) as double) as obs, sum(one * sites) / cast(sum(sites) as double) as one, sum(two * sites) / cast(sum(sites) as double) as two from pred group by 1, 2), "
    "num as (select *, (row_number() over (order by chrom, win) - 1) // 5 as idx, count(*) over () // 5 as c from win), d as (select distinct i // c as rep, i % c as k, c from (select unnest(generate_series(0, 1000 * c - 1)) as i, c from (select distinct c from num))), "
    f"x as (select rep, {_ROLL} as idx from d), r as (select rep, {_R2(m='one')} as one, {_R2(m='two')} as two from x join num using (idx) group by rep), t as (select {_R2(m='one')} as one, {_R2(m='two')} as two from num where idx < c) "
    "select round(t.one, 4) as one, round(t.two, 4) as two, round(stddev_pop(r.one), 4) as sd_one, round(stddev_pop(r.two), 4) as sd_two, round(cast(count(*) filter (r.two - r.one >= t.two - t.one) + 1 as double) / (count(*) + 1), 4) as p from r, t group by t.one, t.two",
}
