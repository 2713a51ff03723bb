"""Simulated allele counts. Draws are functions of keys, so they don't depend on partitions and come out the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.operators.resample import draw

_STEPS = 1 << 20


def uniform(a: Column, b: Column) -> Column:
    """A number strictly between 0 and 1 for a pair of whole numbers."""
    return (draw(a, b, _STEPS).cast("double") + 0.5) / float(_STEPS)


def binomial(u: Column, n: int, p: Column) -> Column:
    """The count among ``n`` whose cumulative probability first exceeds ``u``."""
    return _counted(u, *_binomial(n, p))


def beta_binomial(u: Column, n: int, a: Column, b: Column) -> Column:
    """The same for ``n`` draws whose probability is itself drawn from a beta distribution; ``a`` and ``b`` above 0."""
    return _counted(u, *_beta_binomial(n, a, b))


def _binomial(n: int, p: Column) -> tuple:
    return n, F.pow(1.0 - p, F.lit(float(n))), lambda k: (F.lit(float(n)) - k) * p / ((k + 1.0) * (1.0 - p))


def _beta_binomial(n: int, a: Column, b: Column) -> tuple:
    start = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(1.0), lambda x, i: x * (b + i) / (a + b + i))
    return n, start, lambda k: (F.lit(float(n)) - k) * (a + k) / ((k + 1.0) * (b + float(n) - k - 1.0))


def _cumulated(n: int, start: Column, ratio) -> Column:
    """Cumulative probabilities of 0 to n - 1, from the first probability and the ratio of each to the one before."""
    state = F.struct(start.alias("p"), F.array(start).alias("upto"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * ratio(i.cast("double"))
        return F.struct(p.alias("p"), F.concat(s["upto"], F.array(F.element_at(s["upto"], -1) + p)).alias("upto"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 2)), state, step, lambda s: s["upto"]) if n > 1 else F.array(start)


def _counted(u: Column, n: int, start: Column, ratio) -> Column:
    """Inverse of a distribution on 0 to n: how many of the cumulative probabilities of 0 to n - 1 are not above ``u``."""
    return F.aggregate(_cumulated(n, start, ratio), F.lit(0), lambda k, c: k + (u >= c).cast("int"))


def neutral_counts(segments: DataFrame, pred: str, n: int, key: Column, by: list[str], piece: int = 4096) -> DataFrame:
    """(``by``, het, hom): pairs that differ and that don't in each segment of ``sites`` sites with a sample of ``n`` chromosomes. Two chromosomes
    differ with the predicted probability; of more, each site's count of alternate alleles is beta-binomial with both shapes the prediction.

    A distribution is cumulated once a segment; its sites are drawn by comparisons in generated code. Segments are cut into pieces of ``piece``
    sites, which are dealt out by an explicit number: the segment table is small, however many sites it stands for."""
    p = F.col(pred)
    upto = _cumulated(*(_binomial(1, p) if n == 2 else _beta_binomial(n, p, p)))
    rows = segments.where("sites > 0").select(*by, key.alias("__key"), "sites", upto.alias("__c"))
    rows = rows.select(*by, "__key", "sites", "__c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sites") - 1, F.lit(piece).cast("long"))).alias("__from"))
    parts = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartition(parts, *by, "__from")
    most = 1 if n == 2 else n
    places = F.sequence(F.col("__from"), F.least(F.col("__from") + piece, "sites") - 1)
    rows = rows.select(*by, "__key", *[F.col("__c")[k].alias(f"__c{k}") for k in range(most)], F.explode(places).alias("__k"))
    rows = rows.select(*by, *[f"__c{k}" for k in range(most)], uniform(F.col("__key"), F.col("__k")).alias("__u"))
    rows = rows.select(*by, sum(((F.col("__u") >= F.col(f"__c{k}")).cast("long") for k in range(most)), F.lit(0).cast("long")).alias("__alt"))
    alt = F.col("__alt")
    sums = rows.groupBy(*by).agg(F.sum(alt * (n - alt) if n > 2 else alt).alias("het"), F.count("*").alias("__n"))
    return sums.select(*by, "het", (F.col("__n") * (n * (n - 1) // 2) - F.col("het")).alias("hom"))


def placed(places: DataFrame, wanted: DataFrame, by: list[str], key: Column, pos: str = "pos") -> DataFrame:
    """Of each group's places as many as ``wanted`` (``by``, count) asks for, picked without replacement: those of least draw."""
    order = Window.partitionBy(*by).orderBy("__u", pos)
    rows = places.withColumn("__u", draw(key, F.col(pos), _STEPS)).join(wanted.select(*by, F.col("count").alias("__want")), by)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("__want")).drop("__u", "__r", "__want")
