"""Nucleotide sequences: base content, reverse complement, translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, first, second and third base each in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Three-letter names.
THREE = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter", "X": "Xaa"}


def gc(s: Column) -> Column:
    """Share of G and C among A, C, G and T; 0.0 where there is none."""
    up = F.upper(s)
    acgt = F.char_length(F.regexp_replace(up, "[^ACGT]", ""))
    cg = F.char_length(F.regexp_replace(up, "[^CG]", ""))
    return F.when(acgt == 0, F.lit(0.0)).otherwise(cg / acgt)


def revcomp(s: Column) -> Column:
    return F.translate(F.reverse(F.upper(s)), "ACGTU", "TGCAA")


# Bits 1 and 2 of their codes tell A, C, T (or U) and G apart: 0, 1, 2, 3. The code in that order:
_BY_BITS = "".join(AMINO_ACIDS[BASES.index(a) * 16 + BASES.index(b) * 4 + BASES.index(c)] for a in "ACTG" for b in "ACTG" for c in "ACTG")


def _of_codon(codon: Column) -> Column:
    """One letter for three characters, each of ACGTU in upper case or N; X where there is an N."""
    bits = lambda c: F.shiftright(F.ascii(c), 1).bitwiseAND(F.lit(3))
    index = bits(codon) * 16 + bits(F.substring(codon, 2, 1)) * 4 + bits(F.substring(codon, 3, 1)) + 1
    return F.when(F.instr(codon, "N") > 0, "X").otherwise(F.substr(F.lit(_BY_BITS), index, F.lit(1)))


def _bases(s: Column) -> Column:
    """Bases in upper case; anything else is N."""
    return F.regexp_replace(F.translate(s, "acgtu", "ACGTU"), "(?s)[^ACGTU]", "N")


def amino_acid(codon: Column) -> Column:
    """One letter for three bases (U as T); X for anything else."""
    return F.when(F.char_length(codon) == 3, _of_codon(_bases(codon))).otherwise("X")


def translated(s: Column, frame: Column) -> Column:
    """Amino acids of the codons from ``frame`` on; a partial codon is dropped. One pass over the sequence."""
    codons = F.regexp_extract_all(_bases(F.substr(s, (frame + 1).cast("int"))), F.lit(".{3}"), F.lit(0))
    return F.when(frame >= F.char_length(s), "").otherwise(F.array_join(F.transform(codons, _of_codon), ""))


def codon_at(s: Column, i: Column) -> Column:
    return F.when((i >= 0) & (i + 3 <= F.char_length(s)), F.substr(s, (i + 1).cast("int"), F.lit(3)))


def three_letter(aa: Column) -> Column:
    out = F.lit("Xaa")
    for one, three in THREE.items():
        out = F.when(aa == one, three).otherwise(out)
    return out
