"""Multiple alignments by place of a reference sequence: sub-alignments of classes of places, substitutions by class, quality.

Alignments are the rows of ``formats.maf``. A block's sequences are zipped to columns where the block stands, columns in which the
reference has a gap are left out, and the others are dealt out as rows (chrom, pos, letters), one letter for each of the species,
upper case, N where a species isn't in the block. The reference is on the forward strand; others stand as the block has them.
Where blocks overlap, each gives its own row. Classes are disjoint intervals with a label, found by an as-of lookup, not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators.intervals import WIDTH, islands
from segspark.operators.lookup import asof
from segspark.operators.stats import percentile_cutoff

PLAIN = ("A", "C", "G", "T")


def reference_places(alignments: DataFrame, species: list[str]) -> DataFrame:
    """(chrom, pos, letters): the first of the ``species`` is the reference; a block without it gives nothing. Names are ``src`` up
    to its first dot, the rest of it the chromosome. Of several sequences of one species in a block the first by ``src`` and start counts."""
    name = F.element_at(F.split("src", r"\."), 1)
    rows = alignments.where(name.isin(species)).withColumn("__s", name)
    sequence = lambda s: F.min(F.when(F.col("__s") == s, F.struct("src", "start", F.upper("text").alias("text"))))
    blocks = rows.groupBy("block").agg(*[sequence(s).alias(f"__{k}") for k, s in enumerate(species)]).where("__0 is not null")
    zipped = F.arrays_zip(*[F.split(F.coalesce(f"__{k}.text", F.lit("")), "").alias(f"l{k}") for k in range(len(species))])
    columns = F.filter(zipped, lambda c: c["l0"].isNotNull() & ~c["l0"].isin("-", ""))
    places = blocks.select(F.substring_index("__0.src", ".", -1).alias("chrom"), F.col("__0.start").alias("start"), F.posexplode(columns).alias("k", "c"))
    letter = lambda k: F.when(F.coalesce(F.col(f"c.l{k}"), F.lit("")) == "", "N").otherwise(F.col(f"c.l{k}"))
    return places.select("chrom", (F.col("start") + F.col("k")).alias("pos"), F.array(*[letter(k) for k in range(len(species))]).alias("letters"))


def in_class(places: DataFrame, classes: DataFrame, label: str = "label", width: int = WIDTH) -> DataFrame:
    """The places that lie in one of the disjoint intervals (chrom, start, end, ``label``), with its label."""
    edges = classes.select("chrom", F.col("start").alias("pos"), F.col("end").alias("__end"), label)
    return asof(places, edges, ["__end", label], ["chrom"], "pos", width=width).where("pos < __end").drop("__end")


def sub_alignments(places: DataFrame, species: list[str], label: str = "label", piece: int = 1 << 14) -> DataFrame:
    """(``label``, species, chrom, piece, columns, sequence): the letters of a class in order of place, cut at every ``piece`` places of
    the reference, so that no row grows with the class. In order of chrom and piece, a class's pieces are its sub-alignment."""
    rows = places.groupBy(label, "chrom", F.floor(F.col("pos") / piece).alias("piece"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("pos", "letters"))).alias("__c"))
    text = lambda k: F.array_join(F.transform("__c", lambda c: c["letters"][k]), "")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("species"), text(k).alias("sequence")) for k, s in enumerate(species)]))
    return rows.select(label, "chrom", "piece", F.size("__c").alias("columns"), each.alias("__s")).select(label, "__s.species", "chrom", "piece", "columns", "__s.sequence")


def _plain(letter: Column) -> Column:
    return letter.isin(*PLAIN)


def substitutions(places: DataFrame, species: list[str], by: list[str] = ["label"]) -> DataFrame:
    """(``by``, species, same, different, missing) against the reference, for each of the other species; a place is missing where either
    letter isn't a plain base. One aggregation whatever the number of species."""
    a = F.col("letters")[0]
    sums = []
    for k in range(1, len(species)):
        b = F.col("letters")[k]
        both = _plain(a) & _plain(b)
        sums += [F.count_if(cond).alias(f"__{k}{c}") for c, cond in (("s", both & (a == b)), ("d", both & (a != b)), ("m", ~both))]
    each = F.array(*[F.struct(F.lit(species[k]).alias("species"), F.col(f"__{k}s").alias("same"), F.col(f"__{k}d").alias("different"), F.col(f"__{k}m").alias("missing")) for k in range(1, len(species))])
    return places.groupBy(*by).agg(*sums).select(*by, F.inline(each))


def quality(places: DataFrame, species: list[str], features: DataFrame, share: float) -> DataFrame:
    """(species, bases, missing, ok): of the places of disjoint ``features``, how many lack a plain base, those outside of every block
    included; ok where these are fewer than 1 - ``share`` of all. Without features bases is 0 and ok is false."""
    inside = in_class(places.dropDuplicates(["chrom", "pos"]), features.select("chrom", "start", "end", F.lit(1).alias("label")))
    found = [f"__{k}" for k in range(len(species))]
    counts = inside.agg(F.lit(0).cast("long").alias("bases"), *[F.count_if(_plain(F.col("letters")[k])).alias(c) for k, c in enumerate(found)])
    total = features.agg(F.coalesce(F.sum((F.col("end") - F.col("start")).cast("long")), F.lit(0)).alias("bases"), *[F.lit(0).cast("long").alias(c) for c in found])
    each = F.array(*[F.struct(F.lit(s).alias("species"), "bases", (F.col("bases") - F.col(f"__{k}")).alias("missing")) for k, s in enumerate(species)])
    rows = total.unionByName(counts).agg(*[F.sum(c).alias(c) for c in ("bases", *found)]).select(F.inline(each))
    return rows.withColumn("ok", F.col("missing") < (1.0 - share) * F.col("bases"))


def score_slice(scores: DataFrame, low: float, high: float, width: int = WIDTH) -> DataFrame:
    """Islands (chrom, start, end) of the places (chrom, pos, score) whose score lies from the ``low`` to the ``high`` share of all
    scores, both included. Shares come from one histogram of the scores; the two cuts are one row."""
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))
    cuts = [percentile_cutoff(counts, p).select(F.col("cutoff").alias(c)) for p, c in ((low, "__low"), (high, "__high"))]
    bounds = cuts[0].crossJoin(cuts[1])
    return islands(scores.crossJoin(F.broadcast(bounds)).where("score between __low and __high").select("chrom", "pos").distinct(), ["chrom"], "pos", width)
