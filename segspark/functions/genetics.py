"""Column functions: pair counts, diversity, distances and kernels, sequence letters. All stay within generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
BASES = ["A", "C", "G", "T"]
#: The standard genetic code, by first, second and third base in the order T, C, A, G. Fixed values.
CODON_BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def het_pairs(n: Column, alt: Column) -> Column:
    """Pairs of the n chromosomes that differ."""
    return alt * (n - alt)


def all_pairs(n: Column) -> Column:
    return F.shiftright(n * (n - 1), 1)


def hom_pairs(n: Column, alt: Column) -> Column:
    return all_pairs(n) - het_pairs(n, alt)


def pi(n: Column, alt: Column) -> Column:
    """Nucleotide diversity of one site."""
    return 2.0 * het_pairs(n, alt).cast("double") / (n * (n - 1)).cast("double")


def between_populations(n1: Column, a1: Column, n2: Column, a2: Column) -> Column:
    """Share of pairs, one chromosome from each population, that differ."""
    return (a1 * (n2 - a2) + a2 * (n1 - a1)).cast("double") / (n1 * n2).cast("double")


def haldane(morgans: Column) -> Column:
    """Recombination fraction at a map distance."""
    return -F.expm1(-2.0 * morgans) / 2.0


def background_kernel(r: Column, s: float) -> Column:
    """Weight of a selected site at recombination fraction r: 1 / (s (1 + rho r)^2), rho = (1 - s) / s."""
    rho = (1.0 - s) / s
    return 1.0 / (F.lit(s) * F.pow(1.0 + F.lit(rho) * r, F.lit(2.0)))


def sweep_time(s: float, population: float) -> float:
    """Generations of a sweep: 2 (ln(4 N s) + gamma - 1 / (4 N s)) / s."""
    x = 4 * population * s
    return 2 * (math.log(x) + EULER_GAMMA - 1 / x) / s


def sweep_kernel(r: Column, s: float, population: float) -> Column:
    return F.exp(-r * F.lit(sweep_time(s, population)))


def log_b(b: Column, scale: float, least: float) -> Column:
    """Natural log of B from its integer bins, not below ``least``."""
    return F.greatest(F.lit(least), b * F.lit(math.log1p(-1 / scale)))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def exponential_cdf(x: Column, rate: float) -> Column:
    return -F.expm1(-F.lit(rate) * x)


def complement(sequence: Column) -> Column:
    """Each base's partner, in place (not reversed)."""
    return F.translate(sequence, "ACGTacgt", "TGCAtgca")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def amino_acid(codon: Column) -> Column:
    """One-letter amino acid (* for stop), null unless all three letters are bases."""
    places = [F.instr(F.lit(CODON_BASES), F.substring(F.upper(codon), k, 1)) for k in (1, 2, 3)]
    valid = (F.length(codon) == 3) & (places[0] > 0) & (places[1] > 0) & (places[2] > 0)
    return F.when(valid, F.substring(F.lit(AMINO_ACIDS), (places[0] - 1) * 16 + (places[1] - 1) * 4 + places[2], F.lit(1)))


def variant_effect(codon: Column, changed: Column) -> Column:
    """S, NS or STOP: whether a changed codon keeps, changes or ends the protein."""
    before, after = amino_acid(codon), amino_acid(changed)
    return F.when(before == after, "S").when(after == "*", "STOP").when(after.isNotNull() & before.isNotNull(), "NS")


def substitution_code(a: Column, b: Column, skip: list[str] | None = None) -> Column:
    """0 where a letter of the pair isn't a base or the pair is skipped, 1 where they match, 2 where they differ."""
    plain = F.upper(a).isin(BASES) & F.upper(b).isin(BASES)
    skipped = F.concat(F.upper(a), F.upper(b)).isin(skip) if skip else F.lit(False)
    return F.when(~F.coalesce(plain, F.lit(False)) | skipped, 0).when(F.upper(a) == F.upper(b), 1).otherwise(2)


def mutation_class(ancestral: Column, derived: Column) -> Column:
    """One of six classes: pairs from G or T are folded onto their partners' pair."""
    fold = ancestral.isin("G", "T")
    return F.concat(F.when(fold, complement(ancestral)).otherwise(ancestral), F.when(fold, complement(derived)).otherwise(derived))
