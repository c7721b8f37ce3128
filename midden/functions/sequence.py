"""Column expressions over nucleotide strings."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT, either case, stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def count_of(seq: Column, letters: str) -> Column:
    """How many of the letters seq has."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_fraction(seq: Column) -> Column:
    """G and C among A, C, G, T, either case; null without any."""
    known = count_of(seq, "ACGTacgt")
    return F.when(known > 0, count_of(seq, "GCgc") / known)


def n_count(seq: Column) -> Column:
    return count_of(seq, "Nn")


def is_dna(seq: Column) -> Column:
    """Only A, C, G, T, N, and at least one letter."""
    return seq.rlike("^[ACGTNacgtn]+$")


def plain_name(name: Column) -> Column:
    """Identifiers of letters, digits, underscore and hyphen only."""
    return name.rlike("^[A-Za-z0-9_-]+$")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def canonical_kmers(k: int) -> list[str]:
    """Every canonical k-mer, sorted: 136 of k = 4."""
    swap = str.maketrans("ACGT", "TGCA")
    every = ("".join(x) for x in itertools.product(BASES, repeat=k))
    return sorted({min(x, x[::-1].translate(swap)) for x in every})


# Markers that count as others.
ALIASES = {"TIGR00388": "TIGR00389", "TIGR00471": "TIGR00472", "TIGR00408": "TIGR00409", "TIGR02386": "TIGR02387"}


def marker_alias(marker: Column) -> Column:
    """The marker under which another one counts, else itself."""
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, marker), marker)


def strip_version(accession: Column) -> Column:
    """PF00001.21 to PF00001."""
    return F.regexp_replace(accession, r"^(PF\d+)\.\d+$", "$1")


def contig_of_gene(target: Column) -> Column:
    """Contig of a gene name contig_start_end_strand; else what stands before the third underscore from the right."""
    strict = F.regexp_extract(target, r"^(.+)_\d+_\d+_[+-]$", 1)
    loose = F.regexp_extract(target, r"^(.+)_[^_]*_[^_]*_[^_]*$", 1)
    return F.when(strict != "", strict).when(loose != "", loose).otherwise(target)


def is_transversion(a: Column, b: Column) -> Column:
    """Purine against pyrimidine."""
    return a.isin("A", "G") != b.isin("A", "G")
