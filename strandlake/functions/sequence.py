"""Nucleotide strings as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base complements and ambiguity codes of the IUPAC nomenclature.
IUPAC_FROM, IUPAC_TO = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# The standard genetic code, bases in the order TCAG.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def reverse_complement(s: Column) -> Column:
    """Upper-case ACGT are complemented, other characters kept."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def reverse_complement_iupac(s: Column) -> Column:
    """All ambiguity codes."""
    return F.reverse(F.translate(s, IUPAC_FROM, IUPAC_TO))


def reverse_complement_cased(s: Column) -> Column:
    """Keeps the case of acgt."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def iupac_compatible(code: Column, base: Column) -> Column:
    """Whether the ambiguity code covers the base."""
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.coalesce(F.contains(F.try_element_at(table, F.upper(code)), F.upper(base)), F.lit(False))


def amino_acid(codon: Column) -> Column:
    """One-letter code, ``*`` for stops, null for what isn't a codon."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv]), F.upper(codon))


def assemble_cds(exons: Column, strand: Column) -> Column:
    """Exon sequences (array, in genome order) as one coding sequence on its strand."""
    joined = F.array_join(exons, "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def translate_cds(cds: Column) -> Column:
    """Amino acids of a coding sequence; unknown codons are ``X``; an incomplete last codon is dropped."""
    n = F.floor(F.length(cds) / 3).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.coalesce(amino_acid(F.substr(cds, i * 3 + 1, F.lit(3))), F.lit("X"))), "")


def degeneracies(cds: Column) -> Column:
    """For each base how many of the 4 bases there keep the amino acid (0 if only itself does; -1
    where the codon is unknown), read on the coding strand."""
    places = F.when(F.length(cds) >= 3, F.sequence(F.lit(0), (F.floor(F.length(cds) / 3) * 3 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        k = i % 3
        codon = F.upper(F.substr(cds, i - k + 1, F.lit(3)))
        own = amino_acid(codon)
        same = sum((F.when(amino_acid(F.overlay(codon, F.lit(b), k + 1, F.lit(1))) == own, 1).otherwise(0) for b in "ACGT"), F.lit(0))
        return F.when(own.isNull(), -1).when(same == 1, 0).otherwise(same)

    return F.transform(places, at)


def cpg(before: Column, base: Column, after: Column) -> Column:
    """1 if the base is the C or the G of a CG, -1 if it isn't a known base, else 0."""
    b = F.upper(base)
    hit = ((b == "C") & (F.upper(after) == "G")) | ((b == "G") & (F.upper(before) == "C"))
    return F.when(~b.isin("A", "C", "G", "T"), -1).when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)


def transition_class(ref: Column, alt: Column) -> Column:
    """``ts``, ``tv`` or null for what isn't a single-base change."""
    pair = F.concat(ref, alt)
    both = ref.isin("A", "C", "G", "T") & alt.isin("A", "C", "G", "T") & (ref != alt)
    return F.when(pair.isin("AG", "GA", "CT", "TC"), "ts").when(both, "tv")


def trim_reverse(seq: Column, qual: Column, length: int) -> tuple[Column, Column]:
    """P10: reverse complement of a read and its reversed qualities, cut to ``length``."""
    return F.substring(reverse_complement_cased(seq), 1, length), F.substring(F.reverse(qual), 1, length)


def mask_low_quality(seq: Column, qual: Column, least: int, offset: int = 33) -> Column:
    """Bases whose quality is under ``least`` in lower case."""
    at = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))).otherwise(F.array().cast("array<int>"))
    base = lambda i: F.substr(seq, i, F.lit(1))
    return F.array_join(F.transform(at, lambda i: F.when(F.ascii(F.substr(qual, i, F.lit(1))) - offset < least, F.lower(base(i))).otherwise(base(i))), "")


def split_barcode(name: Column, seq: Column, cell: int, umi: int) -> Column:
    """``name:BARCODE:UMI`` from the first bases of the barcode read."""
    return F.concat_ws(":", name, F.substring(seq, 1, cell), F.substring(seq, cell + 1, umi))


def pad_barcode(barcode: Column, width: int, base: str = "A") -> Column:
    """Trimmed barcodes are filled up at their end."""
    return F.rpad(barcode, width, base)


def kmers(seq: Column, k: int) -> Column:
    """All windows of k bases, in order."""
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(seq, i, F.lit(k)))
