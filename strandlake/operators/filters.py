"""Thresholds for variants, and which deletions and insertions they admit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import depth, f32
from .grouping import running
from .pileup import alt_depth, container_depth


#: Positions that one window holds.
BIN = 65_536


@dataclass(frozen=True)
class Thresholds:
    """Least depths and fractions; the defaults let everything pass."""

    snp_depth: float = 0.0
    snp_fraction: float = 0.0
    start_depth: float = 0.0
    start_fraction: float = 0.0
    go_on_depth: float = 0.0
    go_on_fraction: float = 0.0

    @staticmethod
    def for_mutations() -> "Thresholds":
        return Thresholds(5, 0.9, 1, 0.8, 1, 0.7)


def below(part: Column, whole: Column, least: float) -> Column:
    """part / whole < least in 32 bits; 0 / 0 is not below anything."""
    return F.when(whole == 0, F.lit(False)).otherwise(f32(part / whole) < f32(least))


def snp_passes(alt: Column, total: Column, t: Thresholds) -> Column:
    return (total >= f32(t.snp_depth)) & (alt > 0) & ~below(alt, total, t.snp_fraction)


def indel_passes(least_depth: float, least_fraction: float) -> Column:
    """Over ``positions``: enough middle depth, an indel somewhere, enough of it."""
    middle = depth(F.col("middle"))
    some = (F.col("indel_middle") > 0) | (F.col("indel_ends") > 0)
    return ~(middle < f32(least_depth)) & some & ~below(depth(F.col("indel_middle")), middle, least_fraction)


def start_passes(t: Thresholds) -> Column:
    return indel_passes(t.start_depth, t.start_fraction)


def go_on_passes(t: Thresholds) -> Column:
    return indel_passes(t.go_on_depth, t.go_on_fraction)


def deletion_admissible(rows: DataFrame, start: Column, go_on: Column, by: str = "contig", pos: str = "pos") -> DataFrame:
    """``admissible`` for rows of one depth table: looking left over adjacent positions
    that may go on, a start comes before a break.  A gap in coverage is a break; the
    first position of a contig is none.

    The nearest start and the nearest break to the left are running maxima, taken in bins
    of positions and carried from bin to bin.  A gap shows where the place before is not
    there; only the last place of the bin before is looked up in another bin."""
    bin_ = F.floor(F.col(pos) / BIN)
    last = rows.groupBy(by, (bin_ + 1).alias("_bin")).agg((F.max(pos) == (F.max(bin_) + 1) * BIN - 1).alias("_full"))
    w = Window.partitionBy(by, "_bin").orderBy(pos)
    rows = rows.withColumns({"_start": start, "_go": go_on, "_bin": bin_}).withColumn("_lag", F.lag(pos).over(w)).join(last, [by, "_bin"], "left")
    first = F.col(pos) == F.col("_bin") * BIN
    gap = F.when(F.col("_lag").isNotNull(), F.col("_lag") != F.col(pos) - 1).otherwise((F.col(pos) > 0) & ~(first & F.coalesce("_full", F.lit(False))))
    stop = F.when(~F.col("_start") & ~F.col("_go"), F.col(pos)).when(gap & ~F.col("_start"), F.col(pos) - 1)
    rows = running(rows, [by], F.col("_bin"), [pos], {"_s": (F.when(F.col("_start"), F.col(pos)), "max"), "_b": (stop, "max")})
    keep = F.col("_b").isNull() | (F.coalesce(F.col("_s"), F.lit(-2)) > F.col("_b"))
    return rows.withColumn("admissible", keep).drop("_start", "_go", "_bin", "_lag", "_full", "_s", "_b")


def filtered_positions(positions: DataFrame, t: Thresholds) -> DataFrame:
    """``positions`` with the alternates that pass in ``alts``; those that do not still
    count in the depths.  Insertion rows after the first offset without an alternate
    are dropped."""
    total = container_depth()
    base = deletion_admissible(positions.filter("ins_idx is null"), start_passes(t), go_on_passes(t))
    kept = F.filter("alts", lambda a: F.when(a["allele"] == "-", F.col("admissible") & (alt_depth(a) > 0)).otherwise(snp_passes(alt_depth(a), total, t)))
    base = base.withColumn("alts", kept).drop("admissible")
    ins = positions.filter("ins_idx is not null")
    ok = F.when(F.col("ins_idx") == 0, start_passes(t)).otherwise(go_on_passes(t))
    ins = ins.withColumn("alts", F.when(ok, F.filter("alts", lambda a: alt_depth(a) > 0)).otherwise(F.filter("alts", lambda a: F.lit(False))))
    run = Window.partitionBy("contig", "pos").orderBy("ins_idx")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ins = ins.withColumns({"_n": F.row_number().over(run) - 1, "_all": F.min((F.size("alts") > 0).cast("int")).over(so_far)})
    ins = ins.filter((F.col("_n") == F.col("ins_idx")) & (F.col("_all") == 1)).drop("_n", "_all")
    return base.unionByName(ins)
