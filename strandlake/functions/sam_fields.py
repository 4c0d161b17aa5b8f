"""Fields of SAM lines: flags, supplementary tags, names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "struct<contig:string,pos:int,rev:boolean>"


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def first_word(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def supplementary(tags: Column) -> Column:
    """Places named by ``SA:Z:`` tags; a tag with an entry of other than six fields is
    ignored as a whole."""
    found = F.filter(tags, lambda t: t.startswith("SA:Z:"))
    entries = lambda t: F.filter(F.split(F.substring(t, 6, 1 << 30), ";"), lambda e: e != "")
    good = F.filter(found, lambda t: F.forall(entries(t), lambda e: F.size(F.split(e, ",")) == 6))
    place = lambda e: F.struct(F.split(e, ",")[0].alias("contig"), F.split(e, ",")[1].cast("int").alias("pos"), (F.split(e, ",")[2] == "-").alias("rev"))
    return F.flatten(F.transform(good, lambda t: F.transform(entries(t), place)))


def bad_supplementary(tags: Column) -> Column:
    """Number of ignored ``SA:Z:`` tags."""
    found = F.filter(tags, lambda t: t.startswith("SA:Z:"))
    return F.size(F.filter(found, lambda t: F.exists(F.filter(F.split(F.substring(t, 6, 1 << 30), ";"), lambda e: e != ""), lambda e: F.size(F.split(e, ",")) != 6)))


def contig_length(contig: Column) -> Column:
    """Length that a contig's name tells (``size123`` or ``_length_123_``), else 0."""
    a, b = F.regexp_extract(contig, r"size(\d+)", 1), F.regexp_extract(contig, r"_length_(\d+)_", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("0")).cast("int")


def pair_distance(contig1: Column, pos1: Column, len1: Column, contig2: Column, pos2: Column, len2: Column) -> Column:
    """Gap between two reads of one contig; of two contigs, the sum of the distances
    to the nearest contig ends."""
    edge = lambda c, p, n: F.least(p, F.abs(contig_length(c) - p - n))
    same = F.when(pos2 >= pos1 + len1, pos2 - (pos1 + len1)).otherwise(F.abs(pos2 - pos1))
    return F.when(contig1 == contig2, same).otherwise(edge(contig1, pos1, len1) + edge(contig2, pos2, len2))
