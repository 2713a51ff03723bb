"""Statistics of sites and segments, filters and cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions import genetics as g
from segspark.operators import bins, stats
from segspark.plans import views as v


def site_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, alt = F.col("n"), F.col("alt")
    rows = v.sites(spark, sf_dir).select("chrom", g.het_pairs(n, alt).alias("het"), g.hom_pairs(n, alt).alias("hom"), g.pi(n, alt).alias("pi"))
    return rows.groupBy("chrom").agg(F.sum("het").alias("het"), F.sum("hom").alias("hom"), F.round(F.avg("pi"), 6).alias("mean_pi"), F.count("*").alias("sites"))


def segment_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.segments(spark, sf_dir).select("chrom", "pos", "het", "hom", "sites", "poly", *[F.round(c, 6).alias(c) for c in ("b1", "b2", "nu")])


def genome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.genome_summary(v.segments(spark, sf_dir)).select("pairs", *[F.round(c, 8).alias(c) for c in ("mean_pi", "mean_nu", "tau")])


def weighted_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted(v.sites(spark, sf_dir), "nu", "alt", ["chrom"]).select("chrom", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def harmonic_and_relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir).groupBy("chrom").agg(stats.harmonic_mean(F.col("nu")).alias("h"), F.sum((F.col("alt") > 25).cast("long")).alias("k"), F.count("*").alias("n"))
    return rows.select("chrom", F.round("h", 6).alias("harmonic"), F.round(stats.relative_error(F.col("k"), F.col("n")), 6).alias("relative_error"))


def outlier_rates_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.segments(spark, sf_dir).where((F.col("sites") > 0) & (F.col("nu") <= 0.15))
    return rows.groupBy("chrom").agg(F.count("*").alias("segments"), F.sum("het").alias("het"))


def fraction_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ~F.col("nu").between(0.12, 0.16)
    return v.segments(spark, sf_dir).groupBy("chrom").agg(F.round(F.avg(out.cast("double")), 6).alias("removed"))


def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable Bernoulli sample of segments by integer arithmetic on their key."""
    from segspark.operators.resample import draw

    return v.segments(spark, sf_dir).where(draw(F.col("chrom"), F.col("pos"), 1000) < 250).select("chrom", "pos", "het")


def score_percentile_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = v.sites(spark, sf_dir).groupBy(F.col("alt").alias("score")).agg(F.count("*").alias("n"))
    cuts = [stats.percentile_cutoff(counts, p / 100.0).select(F.lit(p).alias("percent"), F.col("cutoff")) for p in (5, 50, 95)]
    return cuts[0].unionByName(cuts[1]).unionByName(cuts[2])


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.sites(spark, sf_dir).groupBy("chrom", F.col("alt").alias("score")).agg(F.count("*").alias("n"))


def histogram_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(v.sites(spark, sf_dir), "alt", 0, 10, 5, F.col("alt")).select("bin", F.col("n").alias("total"))


def population_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = v.sites(spark, sf_dir).groupBy("chrom", "pos", "pop").agg(F.max("n").alias("n"), F.max("alt").alias("alt"))
    both = stats.populations(first.where("pop = 'F'"), first.where("pop = 'O'"), ["chrom", "pos"], 100)
    div = g.between_populations(F.col("n1"), F.col("alt1"), F.col("n2"), F.col("alt2"))
    return both.select("chrom", "pos", "alt1", "alt2", F.round(div, 6).alias("divergence"))


def mutation_class_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["AF", "AO", "NF", "NO", "RF", "RO"]
    return v.sites(spark, sf_dir).groupBy("chrom", F.floor((F.col("pos") - 1) / 500).cast("long").alias("win")).pivot("kind", kinds).agg(F.sum(g.het_pairs(F.col("n"), F.col("alt")))).fillna(0, kinds)


def mutation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six strand-folded classes of ancestral and derived bases, made of the part and the quantity."""
    rows = v.table(spark, sf_dir, "lineitem").select(F.element_at(F.array(*map(F.lit, g.BASES)), (F.col("l_partkey") % 4 + 1).cast("int")).alias("anc"), F.element_at(F.array(*map(F.lit, g.BASES)), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("der"))
    return rows.where("anc <> der").groupBy(g.mutation_class(F.col("anc"), F.col("der")).alias("class")).agg(F.count("*").alias("n"))


def substitution_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*map(F.lit, [*g.BASES, "N"]))
    rows = v.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), F.element_at(letters, (F.col("l_partkey") % 5 + 1).cast("int")).alias("a"), F.element_at(letters, (F.col("l_orderkey") % 5 + 1).cast("int")).alias("b"))
    return rows.groupBy("chrom", g.substitution_code(F.col("a"), F.col("b"), ["CT", "GA"]).alias("code")).agg(F.count("*").alias("n"))


def codon_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*map(F.lit, g.CODON_BASES))
    base = lambda c: F.element_at(letters, (F.col(c) % 4 + 1).cast("int"))
    rows = v.table(spark, sf_dir, "lineitem").select(F.concat(base("l_orderkey"), base("l_partkey"), base("l_suppkey")).alias("codon"), F.concat(base("l_orderkey"), base("l_partkey"), base("l_linenumber")).alias("changed"))
    return rows.groupBy(g.amino_acid(F.col("codon")).alias("amino_acid"), g.variant_effect(F.col("codon"), F.col("changed")).alias("effect")).agg(F.count("*").alias("n"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return stats.first_of_each(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of runs 0 to 1440, those without an order of that number that is finished."""
    return spark.range(1441).toDF("run").join(v.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run")), "run", "left_anti")


def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(3)


def symmetric_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with scores in one source only, in the other only, and in both."""
    s = v.sites(spark, sf_dir)
    a, b = (s.where(F.col("pop") == p).select("chrom", "pos").distinct().withColumn(p, F.lit(1)) for p in ("F", "O"))
    both = a.join(b, ["chrom", "pos"], "full_outer")
    return both.groupBy("chrom").agg(F.count(F.when(F.col("O").isNull(), 1)).alias("only_f"), F.count(F.when(F.col("F").isNull(), 1)).alias("only_o"), F.count(F.when(F.col("O").isNotNull() & F.col("F").isNotNull(), 1)).alias("both"))


def neighbours_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dinucleotides: places of kind R followed by a place of kind N on the next day with sites (as C is by G)."""
    from segspark.operators.scan import neighbour

    days = v.sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.min("kind").alias("kind"))
    rows = neighbour(days, ["chrom"], "pos", "kind", "next", 256, after=True)
    return rows.where("kind = 'AF' and next = 'NO' or kind = 'NO' and next = 'AF'").select("chrom", "pos", "kind", "next")


QUERIES = {f.__name__: f for f in (site_pair_counts, segment_sufficient_stats, genome_summary, weighted_variance, harmonic_and_relative_error, outlier_rates_removed, fraction_out_of_range, downsampled, score_percentile_cutoff, score_distribution, histogram_weighted, population_full_outer, mutation_class_pivot, mutation_classes, substitution_codes, codon_translation, dedupe_first, missing_runs, best_runs, symmetric_missing, neighbours_of_kind)}

_DRAW = "((((((({a} * 7919 + {b} * 104729 + 17) % 2147483648) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) // 256) % {m}"


def draw_sql(a: str, b: str, m: str | int) -> str:
    return _DRAW.format(a=a, b=b, m=m)


_BASE = "substr('ACGT', cast({c} % 4 + 1 as int), 1)"
ORACLE_SQL = {
    "site_pair_counts": f"with {v.SITES} select chrom, cast(sum(alt * (n - alt)) as bigint) as het, cast(sum(n * (n - 1) // 2 - alt * (n - alt)) as bigint) as hom, round(avg(2.0::double * cast(alt * (n - alt) as double) / cast(n * (n - 1) as double)), 6) as mean_pi, count(*) as sites from sites group by chrom",
    "segment_sufficient_stats": f"with {v.SEGMENTS} select chrom, pos, het, hom, sites, poly, round(b1, 6) as b1, round(b2, 6) as b2, round(nu, 6) as nu from segs",
    "genome_summary": f"with {v.SEGMENTS}, s as (select cast(sum(het + hom) as bigint) as pairs, cast(sum(het) as double) / cast(sum(het + hom) as double) as m, sum(nu * sites) / cast(sum(sites) as double) as r from segs) select pairs, round(m, 8) as mean_pi, round(r, 8) as mean_nu, round(r * (1 - m) / m, 8) as tau from s",
    "weighted_variance": f"with {v.SITES}, m as (select chrom, sum(nu * alt) / sum(alt) as mean from sites group by chrom) select s.chrom, round(any_value(mean), 6) as mean, round(sum((nu - mean) * (nu - mean) * alt) / sum(alt), 6) as variance from sites s join m on s.chrom = m.chrom group by s.chrom",
    "harmonic_and_relative_error": f"with {v.SITES}, s as (select chrom, cast(count(*) as double) / sum(1 / nu) as h, cast(sum(case when alt > 25 then 1 else 0 end) as double) / cast(count(*) as double) as p, cast(count(*) as double) as n from sites group by chrom) select chrom, round(h, 6) as harmonic, round(sqrt(p * (1 - p) / n) / p, 6) as relative_error from s",
    "outlier_rates_removed": f"with {v.SEGMENTS} select chrom, count(*) as segments, cast(sum(het) as bigint) as het from segs where sites > 0 and nu <= cast(0.15 as double) group by chrom",
    "fraction_out_of_range": f"with {v.SEGMENTS} select chrom, round(avg(case when nu between cast(0.12 as double) and cast(0.16 as double) then 0.0::double else 1.0::double end), 6) as removed from segs group by chrom",
    "downsampled": f"with {v.SEGMENTS} select chrom, pos, het from segs where {draw_sql('chrom', 'pos', 1000)} < 250",
    "score_percentile_cutoff": f"with {v.SITES}, c as (select alt as score, count(*) as n from sites group by alt), u as (select score, sum(n) over (order by score) as upto, sum(n) over () as total from c) select p as percent, coalesce(min(case when upto >= cast(p as double) / 100 * total then score end), max(score)) as cutoff from u, (values (5), (50), (95)) t(p) group by p",
    "score_distribution": f"with {v.SITES} select chrom, alt as score, count(*) as n from sites group by chrom, alt",
    "histogram_weighted": f"with {v.SITES} select least(alt // 10, 4) as bin, cast(sum(alt) as bigint) as total from sites where alt between 0 and 50 group by 1",
    "population_full_outer": f"with {v.SITES}, p as (select chrom, pos, pop, max(n) as n, max(alt) as alt from sites group by chrom, pos, pop), j as (select coalesce(a.chrom, b.chrom) as chrom, coalesce(a.pos, b.pos) as pos, coalesce(a.n, 100) as n1, coalesce(a.alt, 0) as alt1, coalesce(b.n, 100) as n2, coalesce(b.alt, 0) as alt2 from (select * from p where pop = 'F') a full join (select * from p where pop = 'O') b on a.chrom = b.chrom and a.pos = b.pos) select chrom, pos, alt1, alt2, round(cast(alt1 * (n2 - alt2) + alt2 * (n1 - alt1) as double) / cast(n1 * n2 as double), 6) as divergence from j",
    "mutation_class_pivot": "with " + v.SITES + " select chrom, (pos - 1) // 500 as win, " + ", ".join(f"cast(coalesce(sum(case when kind = '{k}' then alt * (n - alt) end), 0) as bigint) as \"{k}\"" for k in ("AF", "AO", "NF", "NO", "RF", "RO")) + " from sites group by 1, 2",
    "mutation_classes": f"with r as (select {_BASE.format(c='l_partkey')} as a, {_BASE.format(c='l_orderkey')} as d from lineitem) select case when a in ('G', 'T') then concat(translate(a, 'ACGT', 'TGCA'), translate(d, 'ACGT', 'TGCA')) else concat(a, d) end as class, count(*) as n from r where a <> d group by 1",
    "substitution_codes": "with r as (select l_suppkey % 5 as chrom, substr('ACGTN', cast(l_partkey % 5 + 1 as int), 1) as a, substr('ACGTN', cast(l_orderkey % 5 + 1 as int), 1) as b from lineitem) select chrom, case when a = 'N' or b = 'N' or concat(a, b) in ('CT', 'GA') then 0 when a = b then 1 else 2 end as code, count(*) as n from r group by 1, 2",
    "codon_translation": f"with r as (select l_orderkey % 4 * 16 + l_partkey % 4 * 4 + l_suppkey % 4 as c, l_orderkey % 4 * 16 + l_partkey % 4 * 4 + l_linenumber % 4 as d from lineitem), t as (select substr('{g.AMINO_ACIDS}', cast(c + 1 as int), 1) as x, substr('{g.AMINO_ACIDS}', cast(d + 1 as int), 1) as y from r) select x as amino_acid, case when x = y then 'S' when y = '*' then 'STOP' else 'NS' end as effect, count(*) as n from t group by 1, 2",
    "dedupe_first": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as k from lineitem) where k = 1",
    "missing_runs": "select run from (select unnest(generate_series(0, 1440)) as run) r where not exists (select 1 from orders where o_orderstatus = 'F' and o_orderkey = run)",
    "best_runs": "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 3",
    "symmetric_missing": f"with {v.SITES}, p as (select distinct chrom, pos, pop from sites), q as (select chrom, pos, max(case when pop = 'F' then 1 else 0 end) as f, max(case when pop = 'O' then 1 else 0 end) as o from p group by chrom, pos) select chrom, cast(sum(case when o = 0 then 1 else 0 end) as bigint) as only_f, cast(sum(case when f = 0 then 1 else 0 end) as bigint) as only_o, cast(sum(f * o) as bigint) as both from q group by chrom",
    "neighbours_of_kind": f"with {v.SITES}, d as (select chrom, pos, min(kind) as kind from sites group by chrom, pos), l as (select *, lead(kind) over (partition by chrom order by pos) as next from d) select chrom, pos, kind, next from l where kind = 'AF' and next = 'NO' or kind = 'NO' and next = 'AF'",
}
