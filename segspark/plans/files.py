"""Queries over text formats and small filters; lines and records are made of the tables' rows and parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.operators import neutral as n
from segspark.operators import stats
from segspark.plans import neutral
from segspark.plans import views as v
from segspark.sources import alignments, formats


def _lines(rows: DataFrame, *parts: Column, by: str = "\t") -> DataFrame:
    return rows.select(F.concat_ws(by, *parts).alias("value"))


def _letter(letters: str, k: Column) -> Column:
    return F.substring(F.lit(letters), (k % len(letters) + 1).cast("int"), F.lit(1))


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = formats.bed(_lines(v.table(spark, sf_dir, "orders"), F.concat(F.lit("chr"), c % 5), o, o + c % 50, F.concat(F.lit("L"), o % 7, F.lit(",x"))), one_based=True)
    return rows.groupBy("chrom", "label").agg(F.count("*").alias("n"), F.sum("start").alias("start"), F.sum("end").alias("end"))


def genetic_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = v.knots(spark, sf_dir)
    lines = _lines(knots, F.concat(F.lit("chr"), "chrom"), F.col("pos"), F.col("gpos") / 7.0, F.col("gpos"))
    rows = formats.genetic_map(lines.union(lines.limit(1).select(F.lit("Chromosome Position Rate Map"))))
    return rows.select("chrom", "pos", F.round("rate", 6).alias("rate"), F.round("gpos", 6).alias("gpos"))


def b_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "part")
    lines = _lines(rows, F.col("p_size"), F.col("p_partkey") % 90, by=" ").union(rows.limit(1).select(F.lit("#SCALE=100")))
    return formats.b_map(lines)[1].groupBy("b").agg(F.count("*").alias("n"), F.sum("len").alias("len"))


def axt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise blocks of four columns, one an order; codes of the places of the first sequence."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    first, second = F.concat(*[_letter("ACGT-", F.floor(o / k)) for k in (1, 2, 3, 5)]), F.concat(*[_letter("ACGTN", c * k) for k in (1, 2, 3, 4)])
    head = F.concat_ws(" ", o, F.lit("chr1"), o + 1, o + 4, F.lit("chrA"), c, c + 3, F.lit("+"), F.lit("9"))
    rows = formats.aligned_codes(formats.axt(_lines(v.table(spark, sf_dir, "orders"), head, first, second, by="\n")))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))


def maf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three sequences; how often each column is whole."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    line = lambda name, k, by: F.concat(F.lit(f"s {name}.chr1 "), by, F.lit(" 5 + 900 "), *[_letter("ACGT-N", F.floor(by / j) + k) for j in (1, 2, 3, 4, 5)])
    rows = formats.maf(_lines(v.table(spark, sf_dir, "orders"), F.lit("a score=1"), line("hs", 0, o), line("pt", 1, c), line("mm", 2, o + c), by="\n"))
    return formats.whole_columns(rows).groupBy("column").agg(F.count("*").alias("n"))


def call_mask_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of twelve letters a customer; runs of called places, by length."""
    k = F.col("c_custkey")
    rows = formats.fasta(_lines(v.table(spark, sf_dir, "customer"), F.concat(F.lit("c"), k), F.concat(*[_letter("PNP", F.floor(k / j)) for j in range(1, 7)]), F.concat(*[_letter("pnn", F.floor(k / j)) for j in range(7, 13)]), by="\n"), chunk=5)
    return formats.callable_mask(rows).groupBy((F.col("end") - F.col("start")).alias("len")).agg(F.count("*").alias("n"), F.sum("start").alias("start"))


def mean_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth a sample of two samples' variants at the places of orders in part delivered."""
    o = F.col("o_orderkey")
    fields = [F.lit("chr1"), o, F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.concat(F.lit("AC=1;DP="), F.col("o_custkey") % 97), F.lit("GT"), F.lit("0|1"), F.lit("1|1")]
    orders = v.table(spark, sf_dir, "orders")
    listed = orders.where("o_orderstatus = 'P'").select(F.lit("chr1").alias("chrom"), (o - 1).alias("pos"))
    return formats.mean_depth(formats.vcf(_lines(orders, *fields)), listed).select(F.round("depth", 6).alias("depth"))


def population_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.concat(F.lit("P"), F.col("c_nationkey")).alias("pop"))
    return formats.members(people, "P7")


def greatest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.concat(F.lit("chr"), F.col("l_suppkey") % 5), F.col("l_orderkey"), F.lit("A"), F.lit("C"), F.lit("0"), F.col("l_extendedprice")]
    return formats.greatest_score(_lines(v.table(spark, sf_dir, "lineitem"), *fields))


def gene_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene models of three exons, one an order; number and length of every kind of part by strand."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    starts, ends = [o, o + 20, o + 50], [o + 5 + o % 10, o + 25 + c % 10, o + 57]
    listed = lambda xs: F.concat(*[y for x in xs for y in (x.cast("string"), F.lit(","))])
    line = [F.concat(F.lit("g"), o), F.lit("chr1"), F.when(c % 2 == 0, "+").otherwise("-"), o, o + 57, o + 3 + o % 5, o + 45 + c % 10, F.lit(3), listed(starts), listed(ends)]
    rows = formats.all_parts(_lines(v.table(spark, sf_dir, "orders"), *line))
    return rows.groupBy("part", "strand").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.sum("start").alias("start"))


def map_without_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.intervals_b(spark, sf_dir).groupBy("chrom", "start").agg(F.max("end").alias("end")).withColumn("gpos", F.col("start") / 10.0)
    return formats.without_nested(rows, 25.0).select("chrom", "start", "end", F.round("rate", 4).alias("rate"))


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neutral._changes(spark, sf_dir).select("chrom", "pos", F.col("ref").alias("base"))


def cpg_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.cpg_places(_bases(spark, sf_dir))


def variable_cpg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = n.variable_share(n.cpg_places(_bases(spark, sf_dir)), neutral._changes(spark, sf_dir).where("ref <> alt"))
    return rows.withColumn("share", F.round("share", 6))


def without_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neutral._changes(spark, sf_dir)
    return n.without_biased(rows).withColumn("kept", F.lit("unbiased")).unionByName(n.without_biased(rows, True).withColumn("kept", F.lit("biased")))


def windows_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neutral._changes(spark, sf_dir).groupBy("chrom", F.floor(F.col("pos") / 120).alias("win")).agg(F.count("*").alias("bases"), F.sum((F.col("ref") != F.col("alt")).cast("long")).alias("subs"))
    return n.enough_data(rows)


def constant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.plans import windows as w

    rows = w.MODEL.predict(n.constant_rate(v.segments(spark, sf_dir)), w.PARAMETERS)
    return rows.groupBy("chrom").agg(F.round(F.avg("pred"), 6).alias("pred"))


def genome_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.segments(spark, sf_dir).select("chrom", "pos")
    return n.genome_places(rows, rows.groupBy("chrom").agg(F.max("pos").alias("length")))


def haplotype_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability over haplotypes at each place, then its sum in windows of 100."""
    rows = formats.haplotype_means(v.sites(spark, sf_dir).select("chrom", "pos", (F.col("alt") / 50.0).alias("prob")))
    return rows.groupBy("chrom", F.floor(F.col("pos") / 100).alias("win")).agg(F.sum("haplotypes").alias("haplotypes"), F.round(F.sum("prob"), 6).alias("prob"))


def ratio_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.segments(spark, sf_dir).groupBy("chrom").agg(F.avg("sites").alias("x"), F.avg("poly").alias("y"), F.var_pop("sites").alias("vx"), F.var_pop("poly").alias("vy"))
    return rows.select("chrom", F.round(stats.ratio_variance(F.col("x"), F.col("y"), F.col("vx"), F.col("vy")), 6).alias("variance"))


_SPECIES = ["hs", "pt", "mm"]


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of an alignment of three sequences, a block of five columns an order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    line = lambda name, k, by: F.concat(F.lit(f"s {name}.chr1 "), o * 5, F.lit(" 5 + 900 "), *[_letter("ACGT-N", F.floor(by / j) + k) for j in (1, 2, 3, 4, 5)])
    lines = _lines(v.table(spark, sf_dir, "orders"), F.lit("a score=1"), line("hs", 0, o), line("pt", 1, c), line("mm", 2, o + c), by="\n")
    return alignments.reference_places(formats.maf(lines), _SPECIES)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint intervals of the places with orders, in four classes."""
    rows = v.table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("k")).distinct()
    return rows.select(F.lit("chr1").alias("chrom"), (F.col("k") * 40).alias("start"), (F.col("k") * 40 + 23).alias("end"), (F.col("k") % 4).alias("label"))


def class_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.substitutions(alignments.in_class(_places(spark, sf_dir), _classes(spark, sf_dir)), _SPECIES)


def class_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.sub_alignments(alignments.in_class(_places(spark, sf_dir), _classes(spark, sf_dir)), _SPECIES, piece=4000)


def alignment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.quality(_places(spark, sf_dir), _SPECIES, _classes(spark, sf_dir), 0.5)


def score_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose number of sites lies between the 30th and the 60th percentile."""
    counts = v.sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.count("*").alias("score"))
    return alignments.score_slice(counts, 0.3, 0.6)


QUERIES = {
    f.__name__: f
    for f in (
        bed_lines, genetic_map_lines, b_map_lines, axt_lines, maf_lines, call_mask_lines, mean_depth, population_members, greatest_scores, gene_parts,
        map_without_nested, cpg_places, variable_cpg, without_biased, windows_with_data, constant_rate, genome_places, haplotype_sums, ratio_errors,
        class_substitutions, class_alignments, alignment_quality, score_slice,
    )
}

_D = "cast({} as double)".format


def _pick(letters: str, k: str) -> str:
    return f"substr('{letters}', cast(({k}) % {len(letters)} + 1 as int), 1)"


_PLAIN = "regexp_full_match({}, '[ACGT]')".format
_MAF = " union all ".join(f"select {j} as k, {_pick('ACGT-N', f'o_orderkey // {j + 1}')} as a, {_pick('ACGT-N', f'o_custkey // {j + 1} + 1')} as b, {_pick('ACGT-N', f'(o_orderkey + o_custkey) // {j + 1} + 2')} as c from orders" for j in range(5))
_AXT = " union all ".join(f"select o_orderkey as o, {j} as k, {_pick('ACGT-', f'o_orderkey // {d}')} as a, {_pick('ACGTN', f'o_custkey * {j + 1}')} as b from orders" for j, d in enumerate((1, 2, 3, 5)))
_MASK = " union all ".join(f"select c_custkey as c, {j - 1} as pos, {_pick('PNP' if j < 7 else 'PNN', f'c_custkey // {j}')} as x from customer" for j in range(1, 13))
_CPG = f"{neutral._CHANGES}, c0 as (select a.chrom, a.pos from ch a join ch b on a.chrom = b.chrom and b.pos = a.pos + 1 where a.ref = 'C' and b.ref = 'G'), cpg as (select chrom, pos, 'C' as base from c0 union all select chrom, pos + 1, 'G' from c0)"
_BIASED = "((ref in ('A', 'T')) <> (alt in ('A', 'T')))"
_ONE = " union all ".join(f"select {j} as k, {_pick('ACGT-N', f'o_orderkey // {j + 1}')} as a, {_pick('ACGT-N', f'o_custkey // {j + 1} + 1')} as b, {_pick('ACGT-N', f'(o_orderkey + o_custkey) // {j + 1} + 2')} as c" for j in range(5))
_PLACES = f"al as (select o_orderkey as o, k, a, b, c from (select o_orderkey, o_custkey from orders) as od, lateral ({_ONE})), pl as (select *, 5 * o + sum(case when a <> '-' then 1 else 0 end) over (partition by o order by k) - 1 as pos from al), "
_PLACES += "cl as (select a, b, c, cast(pos as bigint) as pos, cast(pos // 40 % 4 as bigint) as label from pl where a <> '-' and pos % 40 < 23), it as (select distinct o_orderkey // 8 as k from orders)"
_EXONS = "ex as (select *, unnest([{'k': 0, 's': o, 'e': o + 5 + o % 10}, {'k': 1, 's': o + 20, 'e': o + 25 + c % 10}, {'k': 2, 's': o + 50, 'e': o + 57}], recursive := true) from g)"
ORACLE_SQL = {
    "bed_lines": "select concat('chr', o_custkey % 5) as chrom, concat('L', o_orderkey % 7) as label, count(*) as n, cast(sum(o_orderkey - 1) as bigint) as start, cast(sum(o_orderkey + o_custkey % 50) as bigint) as \"end\" from orders group by 1, 2",
    "genetic_map_lines": f"with {v.KNOTS} select concat('chr', chrom) as chrom, pos, round(gpos / 7, 6) as rate, round(gpos * {_D(0.01)}, 6) as gpos from knots",
    "b_map_lines": "select cast(p_size as bigint) as b, count(*) as n, cast(sum(p_partkey % 90) as bigint) as len from part group by 1",
    "axt_lines": f"with a as ({_AXT}), p as (select *, o + sum(case when a <> '-' then 1 else 0 end) over (partition by o order by k) - 1 as pos from a) "
    f"select case when not {_PLAIN('b')} then 0 when a = b then 1 else 2 end as code, count(*) as n, cast(sum(pos) as bigint) as pos from p where a <> '-' group by 1",
    "maf_lines": f"select k as \"column\", count(*) as n from ({_MAF}) where {_PLAIN('a')} and {_PLAIN('b')} and {_PLAIN('c')} group by 1",
    "call_mask_lines": f"with m as ({_MASK}), r as (select c, pos, pos - row_number() over (partition by c order by pos) as run from m where x = 'P'), i as (select c, min(pos) as s, count(*) as len from r group by c, run) select len, count(*) as n, cast(sum(s) as bigint) as start from i group by len",
    "mean_depth": "select round(avg(cast(o_custkey % 97 as double) / 2), 6) as depth from orders where o_orderstatus = 'P'",
    "population_members": "select c_custkey as sample_id from customer where c_nationkey = 7",
    "greatest_scores": "select concat('chr', l_suppkey % 5) as chrom, l_orderkey - 1 as pos, max(cast(l_extendedprice as double)) as score from lineitem group by 1, 2",
    "gene_parts": f"with g as (select o_orderkey as o, o_custkey as c, case when o_custkey % 2 = 0 then '+' else '-' end as strand, o_orderkey + 3 + o_orderkey % 5 as cs, o_orderkey + 45 + o_custkey % 10 as ce from orders), {_EXONS}, "
    "i as (select *, lead(s) over (partition by o order by k) as n from ex), pa as (select strand, 'exons' as part, s as s, e as e from ex union all select strand, 'cds', greatest(s, cs), least(e, ce) from ex "
    "union all select strand, case when strand = '+' then 'utr5' else 'utr3' end, s, least(e, cs) from ex union all select strand, case when strand = '+' then 'utr3' else 'utr5' end, greatest(s, ce), e from ex "
    "union all select strand, 'introns', e, n from i where n is not null union all select strand, 'splice', e, e + 2 from i where n is not null union all select strand, 'splice', n - 2, n from i where n is not null) "
    "select part, strand, count(*) as n, cast(sum(e - s) as bigint) as bases, cast(sum(s) as bigint) as start from pa where s < e group by 1, 2",
    "map_without_nested": f'with {v.INTERVALS}, r as (select chrom, "start", max("end") as "end" from iv_b group by 1, 2), k as (select *, max("end") over (partition by chrom order by "start" rows between unbounded preceding and 1 preceding) as b from r) '
    f'select chrom, "start", "end", round(("start" / {_D(10)} - lag("start" / {_D(10)}) over w) / ("end" - lag("end") over w) * 1000000, 4) as rate from k where b is null or "end" > b window w as (partition by chrom order by "start")',
    "cpg_places": f"with {_CPG} select chrom, pos, base from cpg",
    "variable_cpg": f"with {_CPG} select c.chrom, count(*) as places, round(avg(case when ch.ref <> ch.alt then {_D(1)} else 0 end), 6) as share from (select distinct chrom, pos from cpg) c join ch on c.chrom = ch.chrom and c.pos = ch.pos group by 1",
    "without_biased": f"with {neutral._CHANGES} select chrom, pos, ref, alt, 'unbiased' as kept from ch where ref = alt or not {_BIASED} union all select chrom, pos, ref, alt, 'biased' from ch where ref = alt or {_BIASED}",
    "windows_with_data": f"with {neutral._CHANGES} select chrom, pos // 120 as win, count(*) as bases, count(*) filter (ref <> alt) as subs from ch group by 1, 2 having count(*) >= 100 and count(*) filter (ref <> alt) > 0",
    "constant_rate": f"with {v.SEGMENTS}, m as (select sum(nu * sites) / cast(sum(sites) as double) as nu from segs), s as (select chrom, b1, b2, m.nu as nu from segs, m) select chrom, round(avg({neutral.w._PI}), 6) as pred from s group by chrom",
    "genome_places": f"with {v.SITES}, p as (select distinct chrom, pos from sites), l as (select chrom, max(pos) as len from p group by chrom), o as (select chrom, sum(len) over (order by chrom) - len as off from l) select p.chrom, pos, cast(pos + off as bigint) as genome_pos from p join o on p.chrom = o.chrom",
    "haplotype_sums": f"with {v.SITES}, h as (select chrom, pos, count(*) as n, avg(alt / {_D(50)}) as prob from sites group by 1, 2) select chrom, pos // 100 as win, cast(sum(n) as bigint) as haplotypes, round(sum(prob), 6) as prob from h group by 1, 2",
    "class_substitutions": f"with {_PLACES}, p as (select label, 'pt' as species, a, b as x from cl union all select label, 'mm', a, c from cl) select label, species, count(*) filter ({_PLAIN('a')} and {_PLAIN('x')} and a = x) as same, "
    f"count(*) filter ({_PLAIN('a')} and {_PLAIN('x')} and a <> x) as different, count(*) filter (not ({_PLAIN('a')} and {_PLAIN('x')})) as missing from p group by 1, 2",
    "class_alignments": f"with {_PLACES}, p as (select label, pos, unnest([{{'species': 'hs', 'x': a}}, {{'species': 'pt', 'x': b}}, {{'species': 'mm', 'x': c}}], recursive := true) from cl) "
    "select label, species, 'chr1' as chrom, pos // 4000 as piece, cast(count(*) as int) as columns, string_agg(x, '' order by pos) as sequence from p group by 1, 2, 4",
    "alignment_quality": f"with {_PLACES}, t as (select cast(count(*) * 23 as bigint) as bases from it), p as (select unnest([{{'species': 'hs', 'x': a}}, {{'species': 'pt', 'x': b}}, {{'species': 'mm', 'x': c}}], recursive := true) from cl), "
    f"f as (select species, count(*) filter ({_PLAIN('x')}) as n from p group by 1) select species, bases, bases - n as missing, bases - n < {_D(0.5)} * bases as ok from f, t",
    "score_slice": f"with {v.SITES}, s as (select chrom, pos, count(*) as score from sites group by 1, 2), u as (select score, sum(count(*)) over (order by score) as upto, sum(count(*)) over () as total from s group by score), "
    f"b as (select min(score) filter (upto >= {_D(0.3)} * total) as low, min(score) filter (upto >= {_D(0.6)} * total) as high from u), i as (select chrom, pos, pos - row_number() over (partition by chrom order by pos) as run from s, b where score between low and high) "
    "select chrom, min(pos) as start, max(pos) + 1 as \"end\" from i group by chrom, run",
    "ratio_errors": f"with {v.SEGMENTS}, m as (select chrom, avg(sites) as x, avg(poly) as y, var_pop(sites) as vx, var_pop(poly) as vy from segs group by 1) select chrom, round((vx * (y / x) * (y / x) + vy) / (x * x), 6) as variance from m",
}
