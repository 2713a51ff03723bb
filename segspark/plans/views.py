"""The tables at hand seen as coordinate data, for Spark and as SQL common table expressions with the same names.

Lines of orders are sites: a supplier's last digit base five is the chromosome, the day of shipping the position, the quantity
the count of alternate alleles among 100. Orders are intervals of days; events are points in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "1995-01-01"
LENGTH = 2600  # days, beyond the last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.datediff(F.col(column), F.lit(ORIGIN).cast("date")).cast("long")


def rounded(value: Column, digits: int) -> Column:
    """Rounded as SQL rounds doubles: the nearest whole number of units. ``F.round`` goes by the decimal digits a double prints as, so a double just
    below a half, that prints as one, goes up there and down here."""
    return F.round(value * 10.0**digits) / 10.0**digits


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("chrom"), (_day("l_shipdate") + 1).alias("pos"), F.lit(100).cast("long").alias("n"), F.col("l_quantity").cast("long").alias("alt"),
        (-F.col("l_discount")).alias("b1"), (-F.col("l_tax")).alias("b2"), (F.lit(0.1) + F.col("l_tax")).alias("nu"), F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_linestatus").alias("pop"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.operators.stats import sufficient

    return sufficient(sites(spark, sf_dir), ["chrom", "pos"], ["b1", "b2", "nu"])


def intervals_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _day("o_orderdate")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("chrom"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 7).alias("end"))


def intervals_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _day("o_orderdate")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 5).alias("chrom"), start.alias("start"), (start + 1 + F.col("o_custkey") % 11).alias("end"))


def intervals_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparser annotation: urgent orders in part delivered."""
    start = _day("o_orderdate")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority like '1%'")
    return rows.select((F.col("o_custkey") % 5).alias("chrom"), start.alias("start"), (start + 1 + F.col("o_custkey") % 11).alias("end"))


def steps(intervals: DataFrame) -> DataFrame:
    """A step function: at each start, how many intervals start there; it holds until the next."""
    return intervals.groupBy("chrom", "start").agg(F.count("*").cast("double").alias("value"))


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piecewise-linear map: on every tenth day with sites, the number of sites up to it."""
    from segspark.operators.scan import prefix_sum

    days = sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.count("*").alias("k"))
    return prefix_sum(days, ["chrom"], "pos", {"gpos": "k"}, 256).where("pos % 10 = 0").select("chrom", "pos", F.col("gpos").cast("double").alias("gpos"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chrom"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long").alias("second"), "event_type", "value", "event_id").withColumn("pos", F.col("second") - 1704067200).drop("second")


SITES = f"""sites as (select l_suppkey % 5 as chrom, date_diff('day', date '{ORIGIN}', cast(l_shipdate as date)) + 1 as pos, cast(100 as bigint) as n,
  cast(l_quantity as bigint) as alt, -l_discount as b1, -l_tax as b2, cast(0.1 as double) + l_tax as nu, concat(l_returnflag, l_linestatus) as kind, l_linestatus as pop from lineitem)"""
SEGMENTS = f"""{SITES}, segs as (select chrom, pos, cast(sum(alt * (n - alt)) as bigint) as het, cast(sum(n * (n - 1) // 2) - sum(alt * (n - alt)) as bigint) as hom, count(*) as sites,
  cast(sum(case when alt > 0 and alt < n then 1 else 0 end) as bigint) as poly, avg(b1) as b1, avg(b2) as b2, avg(nu) as nu from sites group by chrom, pos)"""
INTERVALS = f"""iv_a as (select o_custkey % 5 as chrom, date_diff('day', date '{ORIGIN}', cast(o_orderdate as date)) as "start", date_diff('day', date '{ORIGIN}', cast(o_orderdate as date)) + 1 + o_orderkey % 7 as "end" from orders),
iv_b as (select o_custkey % 5 as chrom, date_diff('day', date '{ORIGIN}', cast(o_orderdate as date)) as "start", date_diff('day', date '{ORIGIN}', cast(o_orderdate as date)) + 1 + o_custkey % 11 as "end" from orders where o_orderstatus = 'F'),
iv_p as (select o_custkey % 5 as chrom, date_diff('day', date '{ORIGIN}', cast(o_orderdate as date)) as "start", date_diff('day', date '{ORIGIN}', cast(o_orderdate as date)) + 1 + o_custkey % 11 as "end" from orders where o_orderstatus = 'P' and o_orderpriority like '1%')"""
STEPS = f"""{INTERVALS}, map_a as (select chrom, "start", cast(count(*) as double) as value from iv_a group by chrom, "start"), map_b as (select chrom, "start", cast(count(*) as double) as value from iv_b group by chrom, "start")"""
KNOTS = f"""{SITES}, knots as (select chrom, pos, gpos from (select chrom, pos, cast(sum(count(*)) over (partition by chrom order by pos) as double) as gpos from sites group by chrom, pos) where pos % 10 = 0)"""
POINTS = """points as (select user_id as chrom, cast(floor(epoch(ts)) as bigint) - 1704067200 as pos, event_type, value, event_id from events)"""
