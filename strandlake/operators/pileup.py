"""Counts of alleles by position, strand and part of the read.

Weights are whole hundredths, so sums do not depend on their order and are combined
before the shuffle.  ``pileup`` has a row for each (contig, pos, ins_idx, allele) with four
containers: forward or reverse reads, middle or end of the read.  ``positions`` gathers
a position's alleles into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import allele_rank
from ..functions.numbers import depth, f32

CONTAINERS = ("fm", "rm", "fe", "re")


def container(name: str) -> Column:
    fwd = F.col("fwd") if name[0] == "f" else ~F.col("fwd")
    return fwd & (~F.col("near_end") if name[1] == "m" else F.col("near_end"))


def example_key() -> Column:
    """Order of examples, the best greatest: long reads, near the middle, early in the
    read, then the larger name and the smaller id; what is shown comes last."""
    length = F.length("ex_seq")
    delta = F.abs(F.abs("ex_idx") - F.floor(length / 2))
    return F.struct(length.alias("n"), (-delta).alias("d"), (-F.col("ex_idx")).alias("i"), F.col("ex_name").alias("name"), (-F.col("ex_id")).alias("id"), F.col("ex_seq").alias("seq"), F.col("ex_del").alias("gone"))


def pileup(observations: DataFrame, examples: bool = True) -> DataFrame:
    """fm, rm, fe, re: hundredths; ex_fm ...: best example of each container (alternates
    only; left out with ``examples=False``, which keeps sequences out of the shuffle)."""
    sums = [F.sum(F.when(container(c), F.col("w100")).otherwise(0)).cast("long").alias(c) for c in CONTAINERS]
    best = [F.max(F.when(container(c) & (F.col("allele") != F.col("ref")), example_key())).alias(f"ex_{c}") for c in CONTAINERS] if examples else []
    return observations.groupBy("contig", "pos", "ins_idx", "ref", "allele").agg(*sums, *best)


def shown_example(insertion: Column) -> Column:
    base = F.coalesce("ex_fm", "ex_rm", "ex_fe", "ex_re")
    return F.when(insertion, F.coalesce("ex_rm", "ex_fm", "ex_re", "ex_fe")).otherwise(base)


def with_absences(piled: DataFrame) -> DataFrame:
    """Adds the rows of reads without an insertion: for each insertion offset, the base
    depth at its anchor less the insertions there, by container, where positive.

    The sums stand beside the rows of one exchange by place; what groups them by place and
    offset afterwards (``positions``) needs no other."""
    order = ["ref", "allele"]
    place = Window.partitionBy("contig", "pos").orderBy("ins_idx", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offset = Window.partitionBy("contig", "pos", "ins_idx").orderBy(*order)
    whole = offset.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ins = F.col("ins_idx").isNotNull()
    rows = piled.withColumns({f"_b_{c}": F.sum(F.when(~ins, F.col(c))).over(place) for c in CONTAINERS})
    rows = rows.withColumns({**{f"_i_{c}": F.sum(c).over(whole) for c in CONTAINERS}, "_first": F.row_number().over(offset) == 1})
    scaled = lambda c: (depth(F.coalesce(F.col(f"_b_{c}"), F.lit(0))) * f32(100)).cast("long")
    kinds = {c: t for c, t in piled.dtypes if c not in ("contig", "pos", "ins_idx")}
    rest = {c: F.greatest(F.lit(0), scaled(c) - F.col(f"_i_{c}")) for c in CONTAINERS} | {c: F.lit("-") for c in order}
    one = F.struct(*kinds)
    absent = F.struct(*(rest.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    rows = rows.select("contig", "pos", "ins_idx", F.explode(F.when(ins & F.col("_first"), F.array(one, absent)).otherwise(F.array(one))).alias("_r"))
    return rows.select("contig", "pos", "ins_idx", *(F.col(f"_r.{c}").alias(c) for c in kinds)).select(*piled.columns)


def positions(piled: DataFrame, examples: bool = True) -> DataFrame:
    """One row for each (contig, pos, ins_idx): ref, r_fm ... (the reference's containers),
    ``alts`` in allele order, middle, ends, total (hundredths), and indel hundredths."""
    alt = F.col("allele") != F.col("ref")
    shown = shown_example(F.col("ins_idx").isNotNull()) if examples else F.lit(None).cast("struct<i:int,seq:string,gone:boolean>")
    piece = F.struct(allele_rank(F.col("allele")).alias("rank"), "allele", *CONTAINERS, *([shown.alias("ex")] if examples else []))
    is_indel = F.when(F.col("ins_idx").isNotNull(), F.col("allele") != "-").otherwise(F.col("allele") == "-") & alt
    return piled.groupBy("contig", "pos", "ins_idx").agg(
        F.max("ref").alias("ref"), *(F.sum(F.when(~alt, F.col(c)).otherwise(0)).cast("long").alias(f"r_{c}") for c in CONTAINERS), F.array_sort(F.collect_list(F.when(alt, piece))).alias("alts"),
        F.sum(F.col("fm") + F.col("rm")).cast("long").alias("middle"), F.sum(F.col("fe") + F.col("re")).cast("long").alias("ends"),
        F.sum(F.when(is_indel, F.col("fm") + F.col("rm")).otherwise(0)).cast("long").alias("indel_middle"), F.sum(F.when(is_indel, F.col("fe") + F.col("re")).otherwise(0)).cast("long").alias("indel_ends"),
        *(F.sum(c).cast("long").alias(f"t_{c}") for c in CONTAINERS),
    )


def container_depth(prefix: str = "t_") -> Column:
    """Depth over all containers as 32-bit sums in the order fm, fe, rm, re."""
    out = depth(F.col(f"{prefix}fm"))
    for c in ("fe", "rm", "re"):
        out = f32(out + depth(F.col(f"{prefix}{c}")))
    return out


def alt_depth(a: Column) -> Column:
    return depth(a["fm"] + a["rm"] + a["fe"] + a["re"])


def major_alternate(alts: Column) -> Column:
    """Allele with the greatest count, of equals the first in allele order."""
    total = lambda a: a["fm"] + a["rm"] + a["fe"] + a["re"]
    first = F.aggregate(
        alts, F.struct(F.lit(-1).cast("long").alias("n"), F.lit(None).cast("string").alias("allele")),
        lambda acc, a: F.when(total(a) > acc["n"], F.struct(total(a).alias("n"), a["allele"].alias("allele"))).otherwise(acc),
    )
    return first["allele"]


def major_allele() -> Column:
    """The reference unless an alternate is strictly more frequent."""
    alt = F.array_max(F.transform("alts", lambda a: a["fm"] + a["rm"] + a["fe"] + a["re"]))
    own = F.col("r_fm") + F.col("r_rm") + F.col("r_fe") + F.col("r_re")
    return F.when(F.coalesce(alt, F.lit(-1)) > own, major_alternate(F.col("alts"))).otherwise(F.col("ref"))
