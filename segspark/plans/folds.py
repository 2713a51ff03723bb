"""Queries over folds along an axis: maps without overlaps, blocks of rates, thinned maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.operators import folds
from segspark.plans import views as v
from segspark.plans.windows import folded
from segspark.sources import formats

WIDTH = 128  # days; a bucket


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map features of days, both ends included: the intervals of delivered orders that start on two of three days, scored by how many there are."""
    rows = v.intervals_b(spark, sf_dir).where("start % 3 < 2")
    return rows.groupBy("chrom", F.col("start") + 1, "end").agg(F.count("*").cast("double").alias("score")).toDF("chrom", "start", "end", "score")


def longer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.longer_kept(_features(spark, sf_dir), width=WIDTH)


def rate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _features(spark, sf_dir)
    kept = folds.longer_kept(features, width=WIDTH)
    lengths = features.groupBy("chrom").agg((F.max("end") + 100).alias("length"))
    rows = folds.rate_blocks(kept, lengths, 0.5, width=WIDTH)
    return rows.select("chrom", "start", "end", "rate", F.round("r_start", 4).alias("r_start"), F.round("r_end", 4).alias("r_end"))


def thinned_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knots of a map of seconds at least a day apart, by user; events of one second count once."""
    points = v.points(spark, sf_dir).groupBy((F.col("chrom") % 5).alias("chrom"), "pos").agg(F.count("*").cast("double").alias("gpos"))
    return formats.thinned(points, 86_400)


QUERIES = {f.__name__: f for f in (longer_features, rate_blocks, thinned_map)}

_FREE = "r.s >= s.e"
_LONGER = "r.e - r.s > s.e - s.b"
_NOW = f"{_FREE} or {_LONGER}"
_KEPT = folded(
    "u",
    {
        "g": ("cast(0 as bigint)", f"s.g + case when {_FREE} then 1 else 0 end"),
        "before": ("cast(-1 as bigint)", f"case when {_FREE} then s.e else s.before end"),
        "b": ("r.s", f"case when {_FREE} then r.s when {_LONGER} then greatest(r.s, s.before + 1) else s.b end"),
        "e": ("r.e", f"case when {_NOW} then r.e else s.e end"),
        "score": ("r.score", f"case when {_NOW} then r.score else s.score end"),
    },
)
_MAP = f"""{v.INTERVALS}, fe as (select chrom, "start" + 1 as s, "end" as e, cast(count(*) as double) as score from iv_b where "start" % 3 < 2 group by 1, 2, 3),
u as (select *, row_number() over (partition by chrom order by s, e, score) as k from fe), {_KEPT},
kept as (select chrom, arg_max(b, k) as "start", arg_max(e, k) as "end", arg_max(score, k) as score from f group by chrom, g)"""
ORACLE_SQL = {
    "longer_features": f"with recursive {_MAP} select * from kept",
    "rate_blocks": f"""with recursive {_MAP}, ends as (select chrom, max(e) + 100 as length from fe group by 1),
p as (select *, score * 0.5::double as rate, lag("end") over w as pe, lag(score * 0.5::double) over w as pr, lead("start") over w as nx from kept window w as (partition by chrom order by "start", "end")),
bl as (select chrom, "start" as s, "end" as e, rate from p union all select chrom, coalesce(pe, 0) + 1, "start" - 1, (coalesce(pr, rate) + rate) / 2 from p
  union all select chrom, "end" + 1, length, rate from p join ends using (chrom) where nx is null),
c as (select *, sum((e - s + 1) * rate) over (partition by chrom order by s, e) as upto from bl where s <= e)
select chrom, s as "start", e as "end", rate, round(upto - (e - s + 1) * rate, 4) as r_start, round(upto - rate, 4) as r_end from c""",
    "thinned_map": f"""with recursive {v.POINTS}, kn as (select chrom % 5 as chrom, pos, cast(count(*) as double) as gpos from points group by 1, 2),
k as (select chrom, min(pos) as pos from kn group by 1 union all select kn.chrom, min(kn.pos) from k join kn on kn.chrom = k.chrom and kn.pos >= k.pos + 86400 group by kn.chrom, k.pos)
select kn.* from k join kn using (chrom, pos)""",
}
