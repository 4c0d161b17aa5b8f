"""Nucleotide functions on columns; a base is a string of one IUPAC symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbol of each set of A=1, C=2, G=4, T=8, from none to all.
SYMBOLS = "-ACMGRSVTWYHKDBN"
#: Each symbol and its complement.
PLAIN, PAIRED = "ACGTMRWSYKVHDBN-", "TGCAKYWSRMBDHVN-"
#: Order in which alleles stand in a row.
ALLELES = "ACGTN-"


def code(base: Column) -> Column:
    """Bit mask of the bases that a symbol allows; null for what is no symbol."""
    at = F.instr(F.lit(SYMBOLS), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def symbol(mask: Column) -> Column:
    return F.substring(F.lit(SYMBOLS), mask + 1, F.lit(1))


def complement(seq: Column) -> Column:
    return F.translate(seq, PLAIN, PAIRED)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_ambiguous(base: Column) -> Column:
    """True for symbols that allow several bases."""
    return F.bit_count(code(base)) > 1


def can_match(a: Column, b: Column) -> Column:
    return code(a).bitwiseAND(code(b)) != 0


def union(a: Column, b: Column) -> Column:
    return symbol(code(a).bitwiseOR(code(b)))


def false_negative_rate(base: Column) -> Column:
    """Chance that a mutation away from a symbol is missed: (choices - 1) / 3."""
    return (F.bit_count(code(base)) - 1) / F.lit(3.0)


def checked(seq: Column) -> Column:
    """Upper-cased sequence; fails on symbols that are no bases."""
    up = F.upper(seq)
    return F.when(up.rlike("^[-ACMGRSVTWYHKDBN]*$"), up).otherwise(F.raise_error(F.concat(F.lit("Not a nucleotide sequence: "), F.substring(seq, 1, 80))).cast("string"))


def allele_rank(base: Column) -> Column:
    return F.instr(F.lit(ALLELES), base)


def highlight(seq: Column, index: Column, deletion: Column) -> Column:
    """``left[X]right``, or ``left[-]right`` between two bases for a deletion."""
    left = F.substring(seq, F.lit(1), index)
    return F.when(deletion, F.concat(left, F.lit("[-]"), F.substring(seq, index + 1, F.length(seq)))).otherwise(
        F.concat(left, F.lit("["), F.substring(seq, index + 1, F.lit(1)), F.lit("]"), F.substring(seq, index + 2, F.length(seq)))
    )


def shared_pairs_similar(a: Column, b: Column) -> Column:
    """One contains the other, or the shorter's pairs of neighbours in the longer
    number its length less two at least."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    places = F.when(F.length(short) >= 2, F.sequence(F.lit(1), F.length(short) - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.size(F.filter(places, lambda i: F.instr(long, F.substring(short, i, F.lit(2))) > 0))
    return (F.instr(long, short) > 0) | (pairs >= F.length(short) - 2)
