"""Changes in coding sequence: synonymous and other ones, each base counted once, and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import genetics as g


def coding_places(exons: DataFrame, chrom: str = "chrom") -> DataFrame:
    """(gene, transcript, strand, chrom, pos, idx): every base of the exons (gene, transcript, strand, chrom, start, end) with its place from 0
    in the coding sequence, which runs down the axis where ``strand`` is -. Bases of overlapping exons of one transcript count once. A window
    holds one transcript's bases."""
    whose = ["gene", "transcript", "strand", chrom]
    rows = exons.where("start < end").select(*whose, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).distinct()
    order = Window.partitionBy(*whose).orderBy(F.when(F.col("strand") == "-", -F.col("pos")).otherwise(F.col("pos")))
    return rows.withColumn("idx", F.row_number().over(order) - 1)


def _at(codon: Column, place: Column, base: Column) -> Column:
    """The codon with another base in a place from 0."""
    return F.concat(F.substring(codon, F.lit(1), place), base, F.substring(codon, place + 2, F.lit(3)))


def degeneracy(codon: Column, place: Column) -> Column:
    """How many of the three other bases in a place of a codon leave its amino acid as it is."""
    return sum((((_at(codon, place, F.lit(b)) != codon) & (g.amino_acid(_at(codon, place, F.lit(b))) == g.amino_acid(codon))).cast("int") for b in g.BASES), F.lit(0))


def coding_changes(exons: DataFrame, bases: DataFrame, chrom: str = "chrom") -> DataFrame:
    """(gene, sites, degeneracy, syn, nonsyn, ds, dn, dnds), a row a gene with coding sites. ``bases``: (chrom, pos, q, t), two aligned letters of the
    forward strand. Codons with a gap, an unknown or a missing letter in either sequence, and incomplete ones at the end, are left out. A
    base in several transcripts counts in the least of those whose codon is whole. Without synonymous changes the rates are 0.

    Bases meet exons in one equi-join by place; codons and places of genes are then grouped, so there is no range join.
    """
    upper = {c: F.upper(c) for c in ("q", "t")}
    letters = bases.select(chrom, "pos", *[F.when(x.isin(g.BASES), x).alias(c) for c, x in upper.items()]).dropDuplicates([chrom, "pos"])
    rows = coding_places(exons, chrom).join(letters, [chrom, "pos"])
    turned = [F.when(F.col("strand") == "-", g.complement(F.col(c))).otherwise(F.col(c)).alias(c) for c in ("q", "t")]
    rows = rows.where("q is not null and t is not null").select("gene", "transcript", "pos", F.floor(F.col("idx") / 3).alias("codon"), (F.col("idx") % 3).cast("int").alias("place"), *turned)
    codons = rows.groupBy("gene", "transcript", "codon").agg(F.sort_array(F.collect_list(F.struct("place", "pos", "q", "t"))).alias("b")).where(F.size("b") == 3)
    each = codons.select("gene", "transcript", F.array_join("b.q", "").alias("codon"), F.explode("b").alias("b")).select("gene", "transcript", "codon", "b.*")
    once = each.groupBy("gene", "pos").agg(F.min_by(F.struct("codon", "place", "q", "t"), "transcript").alias("x")).select("gene", "x.*")
    changed, same = F.col("q") != F.col("t"), g.amino_acid(F.col("codon")) == g.amino_acid(_at(F.col("codon"), F.col("place"), F.col("t")))
    sums = once.groupBy("gene").agg(
        F.count("*").alias("sites"), F.sum(degeneracy(F.col("codon"), F.col("place"))).alias("degeneracy"),
        F.sum((changed & same).cast("long")).alias("syn"), F.sum((changed & ~same).cast("long")).alias("nonsyn"),
    )
    some = F.col("syn") > 0
    ds = F.when(some, F.col("syn").cast("double") / F.col("degeneracy").cast("double")).otherwise(0.0)
    dn = F.when(some, F.col("nonsyn").cast("double") / (3 * F.col("sites") - F.col("degeneracy")).cast("double")).otherwise(0.0)
    return sums.select("*", ds.alias("ds"), dn.alias("dn"), F.when(some, dn / ds).otherwise(0.0).alias("dnds"))
