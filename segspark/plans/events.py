"""Event windows, and text formats parsed from lines made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.plans import views as v
from segspark.sources import formats
from segspark.streaming import windows as w


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.tumbling(_events(spark, sf_dir), "6 hours", ["event_type"], "value").select("start", "event_type", "n", F.round("total", 6).alias("total"))


def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.sliding(_events(spark, sf_dir), "12 hours", "6 hours", ["event_type"], "value").select("start", "event_type", "n", F.round("mean", 6).alias("mean"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.sessions(_events(spark, sf_dir), "6 hours", ["user_id"]).select("user_id", "start", "n")


_LETTER = "substr('ACGT', cast({c} % 4 + 1 as int), 1)"


def allele_count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.element_at(F.array(*map(F.lit, "ACGTN")), (F.col(c) % 5 + 1).cast("int")) for c in ("l_partkey", "l_orderkey"))
    alt = F.col("l_quantity").cast("int")
    line = F.format_string("chr%d\t%d\t2\t100\t%s:%d\t%s:%d", F.col("l_suppkey") % 5, F.col("l_orderkey"), a, 100 - alt, b, alt)
    rows = formats.allele_counts(v.table(spark, sf_dir, "lineitem").select(line.alias("value")))
    return rows.groupBy("chrom", "ref", "alt").agg(F.count("*").alias("n"), F.sum("alt_count").alias("alt_count"), F.sum("pos").alias("pos"))


def variant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of three samples in VCF lines, counted, plain, polymorphic, first of each position."""
    o = F.col("o_orderkey")
    gt = lambda k: F.concat((o % (k + 1) > 0).cast("int"), F.lit("|"), (o % (k + 2) == 0).cast("int"), F.lit(":9"))
    letter = lambda c: F.element_at(F.array(*map(F.lit, "ACGT")), (c % 4 + 1).cast("int"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("o_custkey") % 3), F.floor(o / 2) + 1, F.lit("."), letter(o), letter(F.col("o_custkey") + 1), F.lit("."), F.lit("PASS"), F.lit("DP=30;AN=6"), F.lit("GT:DP"), gt(1), gt(2), gt(3))
    counted = formats.genotype_counts(formats.vcf(v.table(spark, sf_dir, "orders").select(line.alias("value"))))
    return formats.polymorphic_once(counted.where("ref <> alt"))


def fixed_step_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an order, its lines' quantities as scores; then the mean score per place modulo 50."""
    scores = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("int"))).alias("q"))
    record = F.concat(F.lit("chrom=chr1 start="), F.col("l_orderkey"), F.lit(" step=1\n"), F.array_join(F.transform("q", lambda x: x.cast("string")), "\n"), F.lit("\n"))
    rows = formats.scaled_scores(formats.fixed_step(scores.select(record.alias("value"))))
    return rows.groupBy((F.col("pos") % 50).alias("place")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


QUERIES = {f.__name__: f for f in (tumbling_events, sliding_events, session_events, allele_count_lines, variant_lines, fixed_step_lines)}

_EPOCH = "cast(floor(epoch(ts)) as bigint)"
ORACLE_SQL = {
    "tumbling_events": f"select {_EPOCH} // 21600 * 21600 as \"start\", event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "sliding_events": f"select unnest([{_EPOCH} // 21600 * 21600, {_EPOCH} // 21600 * 21600 - 21600]) as \"start\", event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2",
    "session_events": "with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as p from events), g as (select *, sum(case when p is null or ts >= p + interval 6 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from l) select user_id, cast(floor(epoch(min(ts))) as bigint) as \"start\", count(*) as n from g group by user_id, k",
    "allele_count_lines": "with r as (select concat('chr', l_suppkey % 5) as chrom, substr('ACGTN', cast(l_partkey % 5 + 1 as int), 1) as ref, substr('ACGTN', cast(l_orderkey % 5 + 1 as int), 1) as alt, cast(l_quantity as bigint) as a, l_orderkey - 1 as pos from lineitem) select chrom, ref, alt, count(*) as n, cast(sum(a) as bigint) as alt_count, cast(sum(pos) as bigint) as pos from r where ref <> 'N' and alt <> 'N' and pos >= -1 group by 1, 2, 3",
    "variant_lines": "with r as (select concat('chr', o_custkey % 3) as chrom, o_orderkey // 2 as pos, substr('ACGT', cast(o_orderkey % 4 + 1 as int), 1) as ref, substr('ACGT', cast((o_custkey + 1) % 4 + 1 as int), 1) as alt, cast(6 as bigint) as n, " + " + ".join(f"(case when o_orderkey % {k + 1} > 0 then 1 else 0 end) + (case when o_orderkey % {k + 2} = 0 then 1 else 0 end)" for k in (1, 2, 3)) + " as alt_count from orders), k as (select *, row_number() over (partition by chrom, pos order by ref, alt, n, alt_count) as i from r where ref <> alt and alt_count > 0 and alt_count < n) select chrom, pos, ref, alt, n, cast(alt_count as bigint) as alt_count from k where i = 1",
    "fixed_step_lines": "with r as (select l_orderkey - 1 + row_number() over (partition by l_orderkey order by cast(l_quantity as int)) - 1 as pos, cast(l_quantity as bigint) * 1000 as score from lineitem) select pos % 50 as place, count(*) as n, cast(sum(score) as bigint) as score from r group by 1",
}
