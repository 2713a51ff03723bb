"""Text formats of genome data as DataFrames.

Every reader has two halves: one that reads files with Spark (``spark.read.text``, with the format's own record delimiter where
records span lines) and one that parses a DataFrame with a column ``value``, so that lines from anywhere can be parsed.
Coordinates come out 0-based and half-open whatever the file has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.operators import scan


def _value() -> Column:
    return F.col("value")


def read_records(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """One row a record, in ``value``; ``delimiter`` for records other than lines."""
    reader = spark.read.option("lineSep", delimiter) if delimiter else spark.read
    return reader.text(path)


def _fields(pattern: str = r"\s+") -> Column:
    return F.split(F.trim(_value()), pattern)


def _data(lines: DataFrame) -> DataFrame:
    return lines.where((F.length(F.trim(_value())) > 0) & ~_value().startswith("#"))


# --- allele counts, masks, maps


def allele_counts(lines: DataFrame) -> DataFrame:
    """``CHROM POS N_ALLELES N_CHR REF:COUNT ALT:COUNT``: biallelic rows of plain bases only; pos becomes 0-based."""
    at = lambda k: F.regexp_extract(_value(), r"^(\S+)\s+(\d+)\s+2\s+(\d+)\s+([ACGT]):(\d+)\s+([ACGT]):(\d+)\s*$", k)
    rows = lines.where(at(1) != "")
    return rows.select(at(1).alias("chrom"), (at(2).cast("long") - 1).alias("pos"), at(3).cast("long").alias("n"), at(4).alias("ref"), at(5).cast("long").alias("ref_count"), at(6).alias("alt"), at(7).cast("long").alias("alt_count"))


def bed(lines: DataFrame, one_based: bool = False) -> DataFrame:
    """Chromosome, start, end and, if there is a fourth column, its first label. ``one_based``: starts count from 1."""
    f = _fields()
    label = F.when(F.size(f) > 3, F.element_at(F.split(f[3], ","), 1))
    return _data(lines).select(f[0].alias("chrom"), (f[1].cast("long") - int(one_based)).alias("start"), f[2].cast("long").alias("end"), label.alias("label"))


def bed_of(spark: SparkSession, template: str, chroms: list[str], listed: list[str]) -> DataFrame:
    """All BED files of a list whose names hold ``{chrom}``, in one scan."""
    paths = [t.format(chrom=c) for t in listed for c in chroms] or [template.format(chrom=c) for c in chroms]
    return bed(read_records(spark, paths))


def fixed_step(records: DataFrame) -> DataFrame:
    """wigFix: records split at ``fixedStep ``; (chrom, pos, score), a row a score. The header's start counts from 1."""
    head = F.element_at(F.split(_value(), "\n"), 1)
    get = lambda k: F.regexp_extract(head, rf"{k}=(\S+)", 1)
    step = F.coalesce(F.expr("try_cast(nullif(regexp_extract(element_at(split(value, '\n'), 1), 'step=(\\\\d+)', 1), '') as long)"), F.lit(1))
    body = F.filter(F.slice(F.split(_value(), "\n"), 2, 2**31 - 2), lambda s: F.length(F.trim(s)) > 0)
    rows = records.where(get("chrom") != "").select(get("chrom").alias("chrom"), (get("start").cast("long") - 1).alias("start"), step.alias("step"), F.posexplode(body).alias("k", "s"))
    return rows.select("chrom", (F.col("start") + F.col("k") * F.col("step")).alias("pos"), F.trim("s").cast("double").alias("score"))


def scaled_scores(scores: DataFrame, scale: int = 1000) -> DataFrame:
    """Scores as whole numbers, floor(score * scale)."""
    return scores.withColumn("score", F.floor(F.col("score") * scale).cast("long"))


def b_map(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``#KEY=VALUE`` header rows, and (seg_idx, b, len) data rows in file order."""
    header = lines.where(_value().startswith("#")).select(F.regexp_extract(_value(), r"^#+\s*([^=\s]+)\s*=", 1).alias("key"), F.regexp_extract(_value(), r"=\s*(.*)$", 1).alias("text")).where("key <> ''")
    f = _fields()
    rows = _data(lines).select(F.monotonically_increasing_id().alias("seg_idx"), f[0].cast("long").alias("b"), f[1].cast("long").alias("len"))
    return header, rows


def write_b_map(segments: DataFrame, path: str, by: str = "chrom", index: str = "seg_idx") -> None:
    """``b len`` lines, one folder a chromosome, in order within it."""
    line = F.concat_ws(" ", F.col("b").cast("string"), F.col("len").cast("string")).alias("value")
    segments.repartition(by).sortWithinPartitions(by, index).select(by, line).write.partitionBy(by).text(path)


def genetic_map(lines: DataFrame, scale: float = 0.01) -> DataFrame:
    """Position, rate and cumulated distance; the distance times ``scale`` (centimorgans to morgans)."""
    f = _fields()
    rows = _data(lines).where(F.expr("try_cast(split(trim(value), '\\\\s+')[1] as long)").isNotNull())
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].cast("double").alias("rate"), (f[3].cast("double") * scale).alias("gpos"))


def without_nested(knots: DataFrame, width: float = 1.0) -> DataFrame:
    """Drop map rows (chrom, gpos, start, end) whose end doesn't pass every end before it in the order of gpos; add the rate per Mb. Kept ends
    are the running maximum, so two scans in buckets of ``width`` map units do without a task for a whole key."""
    rows = scan.running_max(knots, ["chrom"], "gpos", "end", "__before", width, ["start", "end"]).where("__before is null or end > __before").drop("__before")
    rows = scan.neighbour(rows.withColumn("__own", F.struct("gpos", "end")), ["chrom"], "gpos", "__own", "__last", width, ["start", "end"])
    return rows.withColumn("rate", (F.col("gpos") - F.col("__last.gpos")) / (F.col("end") - F.col("__last.end")) * 1e6).drop("__own", "__last")


def haplotype_means(probabilities: DataFrame, by: list[str] = ["chrom", "pos"], value: str = "prob") -> DataFrame:
    """The mean over haplotypes of a probability a haplotype and place, with their number; nulls don't count."""
    return probabilities.groupBy(*by).agg(F.count(value).alias("haplotypes"), F.avg(value).alias(value))


def thinned(knots: DataFrame, resolution: int) -> DataFrame:
    """Down-sample a map (chrom, pos, gpos): the first knot, and each that lies at least ``resolution`` past the last one kept."""
    from segspark.operators.folds import spaced

    return spaced(knots.select("chrom", "pos", "gpos"), resolution)


# --- sequences and alignments


def fasta(records: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Records split at ``>``: (name, start, sequence) in pieces of ``chunk`` letters, upper case."""
    name = F.regexp_extract(_value(), r"^(\S+)", 1)
    whole = F.upper(F.regexp_replace(F.regexp_replace(_value(), r"^[^\n]*\n?", ""), r"\s+", ""))
    rows = records.where(name != "").select(name.alias("name"), whole.alias("whole")).where(F.length("whole") > 0)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / chunk).cast("int"))))
    return rows.select("name", (F.col("k") * chunk).cast("long").alias("start"), F.substring("whole", F.col("k") * chunk + 1, F.lit(chunk)).alias("sequence"))


def bases(pieces: DataFrame) -> DataFrame:
    """(name, pos, base), a row a letter."""
    rows = pieces.select("name", "start", F.posexplode(F.split("sequence", "")).alias("k", "base")).where("base <> ''")
    return rows.select("name", (F.col("start") + F.col("k")).alias("pos"), "base")


def callable_mask(pieces: DataFrame, letter: str = "P", width: int = 1 << 20) -> DataFrame:
    """Intervals (name, start, end) of a call mask where the letter is ``letter``."""
    from segspark.operators.intervals import islands

    return islands(bases(pieces).where(F.col("base") == letter), ["name"], "pos", width)


def axt(records: DataFrame) -> DataFrame:
    """Pairwise blocks split at blank lines: header fields, and both sequences without the columns where the first has a gap."""
    parts = F.split(F.trim(_value()), r"\s*\n\s*")
    h = F.split(parts[0], r"\s+")
    rows = records.where((F.size(parts) >= 3) & ~F.trim(_value()).startswith("#")).select(h[1].alias("chrom"), (h[2].cast("long") - 1).alias("start"), h[3].cast("long").alias("end"), h[4].alias("aln_chrom"), (h[5].cast("long") - 1).alias("aln_start"), h[6].cast("long").alias("aln_end"), h[7].alias("strand"), F.split(parts[1], "").alias("a"), F.split(parts[2], "").alias("b"))
    pairs = F.filter(F.arrays_zip("a", "b"), lambda p: (p["a"] != "-") & (p["a"] != ""))
    rows = rows.withColumn("pairs", pairs)
    return rows.select("chrom", "start", "end", "aln_chrom", "aln_start", "aln_end", "strand", F.array_join(F.transform("pairs", lambda p: p["a"]), "").alias("seq1"), F.array_join(F.transform("pairs", lambda p: p["b"]), "").alias("seq2"))


def aligned_codes(blocks: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """(chrom, pos, code) of pairwise blocks: 0 unusable, 1 match, 2 different."""
    from segspark.functions.genetics import substitution_code

    rows = blocks.select("chrom", "start", F.posexplode(F.arrays_zip(F.split("seq1", "").alias("a"), F.split("seq2", "").alias("b"))).alias("k", "p")).where("p.a <> ''")
    return rows.select("chrom", (F.col("start") + F.col("k")).alias("pos"), substitution_code(F.col("p.a"), F.col("p.b"), skip).alias("code"))


def maf(records: DataFrame, species: list[str] | None = None) -> DataFrame:
    """Multiple alignment blocks split at blank lines: (block, src, start, size, strand, src_size, text), a row a sequence."""
    lines = F.filter(F.split(_value(), "\n"), lambda s: s.startswith("s "))
    rows = records.where(F.size(lines) > 0).select(F.monotonically_increasing_id().alias("block"), lines.alias("l")).select("block", F.explode("l").alias("s"))
    f = F.split("s", r"\s+")
    rows = rows.select("block", f[1].alias("src"), f[2].cast("long").alias("start"), f[3].cast("long").alias("size"), f[4].alias("strand"), f[5].cast("long").alias("src_size"), f[6].alias("text"))
    return rows if species is None else rows.where(F.element_at(F.split("src", r"\."), 1).isin(species))


def whole_columns(alignments: DataFrame, by: str = "block") -> DataFrame:
    """(block, column) of the alignment columns in which every sequence of the block has a plain base."""
    rows = alignments.select(by, F.posexplode(F.split(F.upper("text"), "")).alias("column", "base")).where("base <> ''")
    return rows.groupBy(by, "column").agg(F.bool_and(F.col("base").isin("A", "C", "G", "T")).alias("ok")).where("ok").select(by, "column")


# --- variants, scores, genes


def vcf(lines: DataFrame) -> DataFrame:
    """Fields of VCF data lines: info as a map, samples as an array of maps keyed by the format's names; pos 0-based."""
    f = F.split(_value(), "\t")
    pairs = F.transform(F.split(f[7], ";"), lambda s: F.struct(F.element_at(F.split(s, "="), 1), F.coalesce(F.get(F.split(s, "=", 2), F.lit(1)), F.lit(""))))
    keys = F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ":")
    samples = F.transform(F.slice(f, 10, 2**31 - 10), lambda s: F.map_from_entries(F.filter(F.zip_with(keys, F.split(s, ":"), lambda k, x: F.struct(k.alias("k"), x.alias("x"))), lambda e: e["k"].isNotNull() & e["x"].isNotNull())))
    return _data(lines).select(f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), f[5].alias("qual"), f[6].alias("filter"), F.map_from_entries(F.array_distinct(pairs)).alias("info"), samples.alias("samples"))


def genotype_counts(variants: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, n, alt_count) from the samples' GT; missing alleles don't count."""
    alleles = F.flatten(F.transform("samples", lambda s: F.split(F.coalesce(s["GT"], F.lit("")), r"[|/]")))
    known = F.filter(alleles, lambda a: a.rlike(r"^\d+$"))
    return variants.select("chrom", "pos", "ref", "alt", F.size(known).cast("long").alias("n"), F.size(F.filter(known, lambda a: a != "0")).cast("long").alias("alt_count"))


def polymorphic_once(variants: DataFrame) -> DataFrame:
    """Biallelic plain variants, the first of each position by its letters, without monomorphic ones (needs n and alt_count)."""
    from segspark.operators.stats import first_of_each

    plain = variants.where(F.col("ref").isin("A", "C", "G", "T") & F.col("alt").isin("A", "C", "G", "T") & (F.col("alt_count") > 0) & (F.col("alt_count") < F.col("n")))
    return first_of_each(plain, ["chrom", "pos"], ["ref", "alt", "n", "alt_count"])


def mean_depth(variants: DataFrame, listed: DataFrame) -> DataFrame:
    """Mean depth a sample at listed positions (chrom, pos)."""
    rows = variants.join(listed.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    return rows.agg(F.avg(F.col("info")["DP"].cast("double") / F.size("samples")).alias("depth"))


def members(people: DataFrame, population: str, at_most: int | None = None, seed: int = 1) -> DataFrame:
    """Samples of a population; ``at_most``: so many of them, by a hash of their id."""
    rows = people.where(F.col("pop") == population).select("sample_id")
    return rows if at_most is None else rows.orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id").limit(at_most)


def greatest_score(lines: DataFrame) -> DataFrame:
    """The greatest of the alternates' scores at each position, from ``chrom pos ref alt raw score`` lines."""
    f = _fields("\t")
    rows = _data(lines).select(f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[5].cast("double").alias("score"))
    return rows.groupBy("chrom", "pos").agg(F.max("score").alias("score"))


def known_genes(lines: DataFrame) -> DataFrame:
    """Gene models with exons, and from them the coding parts, untranslated ends, introns and splice places, as arrays."""
    f = F.split(_value(), "\t")
    numbers = lambda k: F.transform(F.filter(F.split(f[k], ","), lambda s: s != ""), lambda s: s.cast("long"))
    rows = _data(lines).select(f[0].alias("name"), f[1].alias("chrom"), f[2].alias("strand"), *[f[k].cast("long").alias(n) for k, n in ((3, "tx_start"), (4, "tx_end"), (5, "cds_start"), (6, "cds_end"))], F.zip_with(numbers(8), numbers(9), lambda s, e: F.struct(s.alias("start"), e.alias("end"))).alias("exons"))

    def cut(low: str | None, high: str | None) -> Column:
        def part(x: Column) -> Column:
            s = F.greatest(x["start"], F.col(low)) if low else x["start"]
            e = F.least(x["end"], F.col(high)) if high else x["end"]
            return F.struct(s.alias("start"), e.alias("end"))

        return F.filter(F.transform("exons", part), lambda x: x["start"] < x["end"])

    n = F.size("exons")
    introns = F.zip_with(F.slice("exons", 1, F.greatest(n - 1, F.lit(0))), F.slice("exons", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    rows = rows.withColumn("cds", cut("cds_start", "cds_end")).withColumn("left", cut(None, "cds_start")).withColumn("right", cut("cds_end", None)).withColumn("introns", introns)
    plus = F.col("strand") == "+"
    splice = F.flatten(F.transform("introns", lambda i: F.array(F.struct(i["start"].alias("start"), (i["start"] + 2).alias("end")), F.struct((i["end"] - 2).alias("start"), i["end"].alias("end")))))
    return rows.withColumn("utr5", F.when(plus, F.col("left")).otherwise(F.col("right"))).withColumn("utr3", F.when(plus, F.col("right")).otherwise(F.col("left"))).withColumn("splice", splice).drop("left", "right")


def parts_of(genes: DataFrame, part: str) -> DataFrame:
    """One kind of part (exons, cds, introns, utr5, utr3, splice) as interval rows."""
    return genes.select("name", "chrom", "strand", F.inline(part))


def all_parts(lines: DataFrame) -> DataFrame:
    """(name, chrom, strand, part, start, end): the rows that ``parts_of`` gives for every kind of part of ``known_genes``, by plain columns. Lines
    are read once, and the generated code is short enough to be compiled: no filter, arrays of structs or functions on arrays repeat it."""
    value = _value()
    f, k, more = F.col("f"), F.col("k"), F.col("next").isNotNull()
    rows = lines.select(F.when((F.length(F.trim(value)) > 0) & ~value.startswith("#"), F.split(value, "\t")).alias("f"))
    listed = lambda x: F.array_remove(F.split(x, ","), "")
    at = lambda j: F.get(f, F.lit(j))
    rows = rows.select(at(0).alias("name"), at(1).alias("chrom"), at(2).alias("strand"), at(5).cast("long").alias("low"), at(6).cast("long").alias("high"), listed(at(8)).alias("starts"), listed(at(9)).alias("ends"))
    rows = rows.select("name", "chrom", "strand", "low", "high", "starts", "ends", F.posexplode_outer("starts").alias("k", "s")).where(k.isNotNull())
    rows = rows.select("name", "chrom", "strand", "low", "high", F.col("s").cast("long").alias("s"), F.get("ends", k).cast("long").alias("e"), F.get("starts", k + 1).cast("long").alias("next"))
    s, e, low, high, after, plus = F.col("s"), F.col("e"), F.col("low"), F.col("high"), F.col("next"), F.col("strand") == "+"
    first, last = F.when(plus, "utr5").otherwise("utr3"), F.when(plus, "utr3").otherwise("utr5")
    kinds = [
        (F.lit("exons"), s, e), (F.lit("cds"), F.greatest(s, low), F.least(e, high)), (first, s, F.least(e, low)), (last, F.greatest(s, high), e),
        (F.lit("introns"), e, after), (F.lit("splice"), e, e + 2), (F.lit("splice"), after - 2, after),
    ]
    each = F.explode(F.array(*map(F.lit, range(len(kinds))))).alias("j")
    rows = rows.select("name", "chrom", "strand", "low", "high", "s", "e", "next", each)

    def pick(column: int) -> Column:
        return reduce(lambda found, j: found.when(F.col("j") == j, kinds[j][column]), range(1, len(kinds)), F.when(F.col("j") == 0, kinds[0][column]))

    rows = rows.select("name", "chrom", "strand", "j", more.alias("more"), pick(0).alias("part"), pick(1).alias("start"), pick(2).alias("end"))
    kept = F.when(F.col("j") == 0, True).when(F.col("j") < 4, F.col("start") < F.col("end")).otherwise(F.col("more"))
    return rows.where(kept).select("name", "chrom", "strand", "part", "start", "end")


def longest_transcripts(genes: DataFrame, by: str) -> DataFrame:
    """Of each gene the transcript with most coding places, then by name."""
    size = F.aggregate("cds", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return genes.withColumn("size", size).groupBy(by).agg(F.max_by("name", F.struct("size", F.hash("name"))).alias("name"), F.max("size").alias("size"))
