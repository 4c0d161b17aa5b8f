"""Aligned lines to base observations: one row for each base, deletion or insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions.numbers import f32, hundredths

#: References up to this many bases are broadcast; larger ones are joined by pieces.
BROADCAST_BASES = 64_000_000
PIECE = 65_536


def with_blocks(grouped: DataFrame, extended: bool = False) -> DataFrame:
    """Adds ``blocks``, the ends of the aligned part of the query, and the overlap of the
    alignment's parts (greatest start, least end; contigs are not compared)."""
    df = grouped.withColumn("_b", cigar.blocks(F.col("cigar"), F.col("pos"), F.col("seq_len"), extended))
    df = df.withColumn("blocks", F.explode(F.array("_b"))).drop("_b").filter(F.size("blocks") > 0)  # the filter does not fold again
    first, last = F.element_at("blocks", 1), F.element_at("blocks", -1)
    df = df.withColumns({"q_first": first["q_start"], "q_last": last["q_start"] + last["q_len"]})
    none = {"lap_from": F.lit(None).cast("int"), "lap_to": F.lit(None).cast("int"), "all_blocks": F.lit(None).cast(f"array<array<{cigar.BLOCK}>>")}
    alone = df.filter("n_parts < 2").withColumns(none)  # nothing overlaps, so the lines stay where they are
    df = df.filter("n_parts > 1").withColumns({"_lo": first["r_start"], "_hi": last["r_start"] + last["r_len"], "_whole": ~cigar.has_gap(F.col("cigar"))})
    aln = Window.partitionBy("input_index", "aln")
    gaps = F.when(~F.bool_and("_whole").over(aln), F.collect_list("blocks").over(aln))
    return alone.unionByName(df.withColumns({"lap_from": F.max("_lo").over(aln), "lap_to": F.min("_hi").over(aln), "all_blocks": gaps}).drop("_lo", "_hi", "_whole"))


def covering(index: Column) -> Column:
    """How many parts of the alignment cover a reference index, of alignments without gaps."""
    lap = (index >= F.col("lap_from")) & (index < F.col("lap_to"))
    return F.when((F.col("n_parts") > 1) & lap, F.col("n_parts")).otherwise(1)


def covering_parts(start: Column, step: Column, n: Column) -> Column:
    """The same for ``n`` indices from ``start`` on, from the blocks of all parts; null where
    the overlap tells it.  The functions of arrays run once for each block, not for each base."""
    held = lambda at: lambda bs: F.exists(bs, lambda b: (at >= b["r_start"]) & (at < b["r_start"] + b["r_len"]))
    counts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(1), F.size(F.filter("all_blocks", held(start + i * step)))))
    return F.when(F.col("all_blocks").isNotNull() & (F.col("n_parts") > 1), counts)


def near_end(q_index: Column, fraction: float) -> Column:
    distance = F.least(q_index - F.col("q_first"), F.col("q_last") - q_index - 1)
    return distance < F.col("seq_len") * F.lit(float(fraction))


def base_observations(blocked: DataFrame, reference: DataFrame, fraction: float = 0.1, large: bool | None = None) -> DataFrame:
    """contig, pos (0-based), ins_idx, ref, allele, fwd, near_end, w100, and the example's
    seq, signed query index, name and id.

    Ambiguous query bases are left out, in insertions they count as N.  The reference's
    bases come with the block, so positions are not joined one by one."""
    if large is None:
        large = (reference.agg(F.sum("length")).first()[0] or 0) > BROADCAST_BASES
    ref = reference.groupBy("name").agg(F.min_by("seq", "ordinal").alias("_seq"), F.first(F.lit(True)).alias("_there"))
    df = blocked.withColumn("b", F.explode("blocks"))
    b = F.col("b")
    span, insertion, deletion = F.greatest(b["q_len"], b["r_len"]), b["r_len"] == 0, b["q_len"] == 0
    if large:
        there = ref.select("name", "_there")
        whole = F.array(F.struct(F.lit(None).cast("int").alias("p"), F.lit(0).alias("lo"), span.alias("hi")))
        cutting = F.transform(F.sequence(F.floor(b["r_start"] / PIECE).cast("int"), F.floor((b["r_start"] + span - 1) / PIECE).cast("int")), lambda p: F.struct(p.alias("p"), F.greatest(F.lit(0), p * PIECE - b["r_start"]).alias("lo"), F.least(span, (p + 1) * PIECE - b["r_start"]).alias("hi")))
        df = df.withColumn("_s", F.explode(F.when(insertion | (span < 1), whole).otherwise(cutting)))
        pieces = reference.select(F.col("name").alias("_c"), "seq", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / PIECE).cast("int"))).alias("_piece")).select("_c", "_piece", F.substring(F.col("seq"), F.col("_piece") * PIECE + 1, F.lit(PIECE)).alias("_bases"))
        df = df.join(there, F.col("contig") == F.col("name"), "left").join(pieces, (F.col("contig") == F.col("_c")) & (F.col("_s.p") == F.col("_piece")), "left")
        df = df.withColumns({"_lo": F.col("_s.lo"), "_hi": F.col("_s.hi"), "_ref": F.substring(F.col("_bases"), b["r_start"] + F.col("_s.lo") - F.col("_s.p") * PIECE + 1, F.col("_s.hi") - F.col("_s.lo"))})
    else:
        df = df.join(F.broadcast(ref), F.col("contig") == F.col("name"), "left")
        df = df.withColumns({"_lo": F.lit(0), "_hi": span, "_ref": F.substring(F.col("_seq"), b["r_start"] + 1, b["r_len"])})
    missing = F.raise_error(F.concat(F.lit("Reference contig named '"), "contig", F.lit("' not found"))).cast("string")
    parts = covering_parts(F.when(insertion, b["r_start"] - 1).otherwise(b["r_start"]), F.when(insertion, 0).otherwise(1), span)
    df = df.select(
        F.when(F.col("_there"), F.col("contig")).otherwise(missing).alias("contig"), "b", "seq", "rev", "weight", "n_parts", "lap_from", "lap_to", "q_first", "q_last", "seq_len", "qname", "ord", "_lo", "_hi", "_ref", parts.alias("_parts"),
    )
    df = df.withColumn("i", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))  # by itself: what stands beside it would run for each base
    i = F.col("i")
    index = F.when(insertion, b["r_start"] - 1).otherwise(b["r_start"] + i)
    base = F.when(deletion, F.lit("-")).otherwise(F.substring(F.col("seq"), b["q_start"] + i + 1, F.lit(1)))
    end_at = F.when(insertion, b["q_start"]).otherwise(b["q_start"] + i)
    q = F.when(deletion, -b["q_start"]).otherwise(b["q_start"] + i)
    plain = base.isin("A", "C", "G", "T", "-")
    covers = F.coalesce(F.get("_parts", i), covering(index))
    return df.select(
        "contig", index.alias("pos"), F.when(insertion, i).alias("ins_idx"), F.when(insertion, F.lit("-")).otherwise(F.substring(F.col("_ref"), i - F.col("_lo") + 1, F.lit(1))).alias("ref"),
        F.when(insertion & ~plain, F.lit("N")).otherwise(base).alias("allele"), (~F.col("rev")).alias("fwd"), near_end(end_at, fraction).alias("near_end"),
        hundredths(f32(F.col("weight") / f32(covers))).alias("w100"), F.col("seq").alias("ex_seq"), q.alias("ex_idx"), deletion.alias("ex_del"), F.col("qname").alias("ex_name"), F.col("ord").alias("ex_id"),
        (insertion | plain).alias("_keep"),
    ).filter("_keep").drop("_keep")
