"""Report tables and their text: VCF summary, mutations, SAM, reads by references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases, cigar, sam_fields
from ..functions.numbers import depth, f32, number_text, text_or_dot
from .filters import BIN
from .grouping import numbered
from .pileup import alt_depth, container_depth, major_alternate


def vcf_rows(filtered: DataFrame, only_mutations: bool = False, support: bool = True) -> DataFrame:
    """CHROM, POS (1-based, negative for insertions after it), REF, ALT, DP, details of
    middle and ends, example reads; ``at`` (0-based) and ``ins_idx`` for the order."""
    ins = F.col("ins_idx").isNotNull()
    rows = filtered.filter(F.when(ins, F.size("alts") > 0).otherwise((container_depth() > 0) & ((F.size("alts") > 0) | F.lit(not only_mutations))))

    def details(kind: str) -> Column:
        pair = lambda f, r: F.concat(number_text(depth(f)), F.lit(","), number_text(depth(r)))
        own = F.array(pair(F.col(f"r_f{kind}"), F.col(f"r_r{kind}")))
        return F.array_join(F.concat(own, F.transform("alts", lambda a: pair(a[f"f{kind}"], a[f"r{kind}"]))), ";")

    text = lambda a: F.when(a["ex"].isNull(), F.lit("")).otherwise(bases.highlight(a["ex"]["seq"], F.abs(a["ex"]["i"]), a["ex"]["gone"]))
    out = rows.select(
        F.col("contig").alias("CHROM"), F.when(ins, -(F.col("pos") + 1)).otherwise(F.col("pos") + 1).alias("POS"), F.col("ref").alias("REF"), text_or_dot(F.array_join(F.transform("alts", lambda a: a["allele"]), ",")).alias("ALT"),
        number_text(container_depth()).alias("DP"), details("m").alias("DETAILS_MIDDLE"), details("e").alias("DETAILS_ENDS"), *([text_or_dot(F.array_join(F.transform("alts", text), ",")).alias("SUPPORT")] if support else []), F.col("pos").alias("at"), "ins_idx",
    )
    return out


def vcf_lines(rows: DataFrame) -> DataFrame:
    """The rows as text in their order: contigs by name, insertions after their anchor."""
    fields = [c for c in rows.columns if c not in ("at", "ins_idx")]
    return rows.orderBy("CHROM", "at", F.col("ins_idx").asc_nulls_first()).select(F.concat_ws("\t", *(F.col(c).cast("string") for c in fields)).alias("value"))


def ordered(rows: DataFrame) -> DataFrame:
    """``place``: from 1, where a row stands among those of its contig in a report."""
    out = numbered(rows, ["contig"], F.floor(F.col("pos") / BIN), ["pos", F.col("ins_idx").asc_nulls_first()], "place")
    return out.withColumn("place", (F.col("place") + 1).cast("int"))


def deletion_runs(filtered: DataFrame) -> DataFrame:
    """Maximal runs of adjacent positions with an admitted deletion: contig, first, last,
    reference bases, least middle depth of the deletion and in all."""
    gone = lambda a: a["allele"] == "-"
    rows = filtered.filter(F.col("ins_idx").isNull() & F.exists("alts", gone)).withColumn("_d", F.element_at(F.filter("alts", gone), 1))
    rows = numbered(rows, ["contig"], F.floor(F.col("pos") / BIN), ["pos"], "_k").withColumn("_run", F.col("pos") - F.col("_k"))
    middle = F.col("_d")["fm"] + F.col("_d")["rm"]
    return rows.groupBy("contig", "_run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]), "").alias("ref"),
        F.min(middle).alias("w100"), F.min("middle").alias("total100"),
    ).drop("_run")


def insertion_runs(filtered: DataFrame) -> DataFrame:
    """Whole insertions: their bases (commonest of each offset), the middle depth of the
    last offset without its absences, the middle depth at the anchor."""
    base = filtered.filter(F.col("ins_idx").isNull() & (container_depth() > 0)).select("contig", "pos", F.col("middle").alias("total100"))
    rows = filtered.filter(F.col("ins_idx").isNotNull()).withColumn("_a", major_alternate(F.col("alts")))
    own = F.col("middle") - F.col("r_fm") - F.col("r_rm")
    runs = rows.groupBy("contig", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ins_idx", "_a"))), lambda x: x["_a"]), "").alias("bases"), F.max_by(own, "ins_idx").alias("w100"))
    return runs.join(base, ["contig", "pos"])


def mutation_rows(filtered: DataFrame) -> DataFrame:
    """CHROM, POS, REF, ALT, DEPTH, TOTAL_DEPTH of SNPs, insertions and deletions, and
    the order in which they are listed (a deletion comes after what stands at the
    position behind it)."""
    snp = filtered.filter(F.col("ins_idx").isNull() & (F.col("ref") != "N")).withColumn("a", F.explode(F.filter("alts", lambda a: a["allele"] != "-")))
    total = container_depth()
    snp = snp.select(F.col("contig").alias("CHROM"), (F.col("pos") + 1).alias("POS"), F.col("ref").alias("REF"), F.col("a.allele").alias("ALT"), number_text(alt_depth(F.col("a"))).alias("DEPTH"), number_text(total).alias("TOTAL_DEPTH"), F.col("pos").alias("at"), F.lit(0).alias("kind"), F.col("a.rank").alias("rank"))
    ins = insertion_runs(filtered).select(F.col("contig").alias("CHROM"), (F.col("pos") + 1).alias("POS"), F.repeat(F.lit("-"), F.length("bases")).alias("REF"), F.col("bases").alias("ALT"), number_text(depth(F.col("w100"))).alias("DEPTH"), number_text(depth(F.col("total100"))).alias("TOTAL_DEPTH"), F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("rank"))
    gone = deletion_runs(filtered).select(F.col("contig").alias("CHROM"), (F.col("first") + 1).alias("POS"), "ref", F.repeat(F.lit("-"), F.length("ref")).alias("ALT"), number_text(depth(F.col("w100"))).alias("DEPTH"), number_text(depth(F.col("total100"))).alias("TOTAL_DEPTH"), (F.col("last") + 1).alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("rank")).withColumnRenamed("ref", "REF")
    return snp.unionByName(ins).unionByName(gone)


def mutation_lines(rows: DataFrame) -> DataFrame:
    fields = ["CHROM", "POS", "REF", "ALT", "DEPTH", "TOTAL_DEPTH"]
    return rows.orderBy("CHROM", "at", "kind", "rank").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in fields)).alias("value"))


def sam_rows(blocked: DataFrame) -> DataFrame:
    """Twelve fields of each line as it was understood: clips as S, no N or H; mate
    fields only for alignments of two parts.  Their order is not defined."""
    aln = Window.partitionBy("input_index", "aln")
    start = F.element_at("blocks", 1)["r_start"] + 1
    rows = blocked.withColumn("_start", start).withColumn("_all", F.collect_list(F.struct("part", "contig", "_start")).over(aln))
    other = F.element_at(F.filter("_all", lambda x: x["part"] != F.col("part")), 1)
    two = F.col("n_parts") == 2
    return rows.select(
        F.col("qname").alias("QNAME"), F.when(F.col("rev"), 16).otherwise(0).alias("FLAG"), F.col("contig").alias("RNAME"), F.col("_start").alias("POS"), F.lit(255).alias("MAPQ"), cigar.from_blocks(F.col("blocks"), F.col("seq_len")).alias("CIGAR"),
        F.when(two, other["contig"]).otherwise("*").alias("RNEXT"), F.when(two, other["_start"]).otherwise(0).alias("PNEXT"), F.col("seq_len").alias("TLEN"), F.col("seq").alias("SEQ"), F.lit("*").alias("QUAL"), F.lit("AS:f:0.0").alias("AS"),
    )


def unaligned_records(parsed: DataFrame, quality: str | None = None) -> DataFrame:
    """``value``: reads without a contig as FASTA records, or as FASTQ with the column
    ``quality`` (unknown qualities are the best, ``I``).  Reads without a sequence have none."""
    rows = parsed.filter((F.col("contig") == "*") & (F.col("seq") != "*"))
    if quality is None:
        return rows.select(F.concat(F.lit(">"), "qname", F.lit("\n"), "seq").alias("value"))
    marks = F.when(F.col(quality).isNull() | (F.col(quality) == "*"), F.repeat(F.lit("I"), F.length("seq"))).otherwise(F.col(quality))
    return rows.select(F.concat(F.lit("@"), "qname", F.lit("\n"), "seq", F.lit("\n+\n"), marks).alias("value"))


def sam_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns)).alias("value"))


def sam_header(reference: DataFrame) -> list[str]:
    """@SQ lines: contigs by length, the longest first, equals in order of the files."""
    rows = reference.orderBy(F.desc("length"), "input_index", "ordinal").select("name", "length").collect()  # the contigs of a genome
    return ["@HD\tVN:1.6\tSO:unsorted", *(f"@SQ\tSN:{r[0]}\tLN:{r[1]}" for r in rows)]


def refs_map_count(grouped: DataFrame, reference: DataFrame) -> DataFrame:
    """Query groups by the set of reference files that any of their placements touches."""
    paths = reference.groupBy("name").agg(F.min_by("path", "ordinal").alias("path"))  # Spark broadcasts them if they are few
    rows = grouped.select("input_index", "qname", "n_parts", "group_no", "contig").join(paths, F.col("contig") == F.col("name"))
    sets = rows.groupBy("input_index", "qname", "n_parts", "group_no").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return sets.groupBy("paths").agg(F.count("*").alias("n")).select(F.concat(F.array_join(F.transform("paths", sam_fields.basename), "-"), F.lit("-")).alias("Genome_set"), F.col("n").alias("No_reads"))


def run_statistics(blocked: DataFrame, positions: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: queries, alignments, aligned bases of first placements, weighted mean and
    deviation of the distance between the parts of pairs, covered part of the contigs."""
    q_len = F.aggregate("blocks", F.lit(0), lambda n, b: n + b["q_len"])
    first = F.col("place") == F.min("place").over(Window.partitionBy("input_index", "qname", "n_parts", "group_no"))
    counts = blocked.withColumn("_q", q_len).withColumn("_first", first).agg(
        F.count_if(F.col("_first") & (F.col("part") == 0)).alias("queries"), F.count_if(F.col("part") == 0).alias("alignments"), F.coalesce(F.sum(F.when(F.col("_first"), F.col("_q"))), F.lit(0)).alias("aligned_bases")
    )
    ends = F.struct(F.element_at("blocks", 1)["r_start"].alias("lo"), (F.element_at("blocks", -1)["r_start"] + F.element_at("blocks", -1)["r_len"]).alias("hi"), "contig")
    pairs = blocked.filter("n_parts = 2").groupBy("input_index", "aln").agg(F.array_sort(F.collect_list(ends)).alias("e"), F.max("weight").alias("w")).filter(F.col("e")[0]["contig"] == F.col("e")[1]["contig"])
    stats = weighted_stats(pairs.select((F.col("e")[1]["lo"] - F.col("e")[0]["hi"]).cast("double").alias("x"), F.col("w").cast("double").alias("w")), "x", "w")
    covered = positions.filter(F.col("ins_idx").isNull() & (container_depth() > 0)).agg(F.count("*").alias("covered"))
    size = reference.agg(F.sum("length").alias("bases"))
    return counts.crossJoin(stats).crossJoin(covered).crossJoin(size)  # one row each


def coverage_by_contig(positions: DataFrame, reference: DataFrame) -> DataFrame:
    """contig, length, covered positions and their per cent, of every contig."""
    covered = positions.filter(F.col("ins_idx").isNull() & (container_depth() > 0)).groupBy("contig").agg(F.count("*").alias("n"))
    contigs = reference.groupBy(F.col("name").alias("contig")).agg(F.max("length").alias("length"))
    n = F.coalesce("n", F.lit(0))
    return contigs.join(covered, "contig", "left").select("contig", "length", n.alias("covered"), F.try_divide(100.0 * n, F.col("length")).alias("percent"))


def weighted_stats(df: DataFrame, x: str, w: str, by: list[str] | None = None) -> DataFrame:
    """Weighted mean and population deviation from three sums."""
    s = df.groupBy(*(by or [])).agg(F.sum(w).alias("_w"), F.sum(F.col(x) * F.col(w)).alias("_x"), F.sum(F.col(x) * F.col(x) * F.col(w)).alias("_xx"))
    mean = F.when(F.col("_w") != 0, F.col("_x") / F.col("_w"))
    spread = F.when(F.col("_w") != 0, F.sqrt(F.greatest(F.lit(0.0), (F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_w")) / F.col("_w"))))
    return s.select(*(by or []), mean.alias("mean"), spread.alias("stddev"))


def coverage_text(covered: int, total: int) -> str:
    """Whole per cent, or ``<1%`` of something."""
    percent = int(100 * covered / total) if total else 0
    return "<1%" if covered and percent < 1 else f"{percent}%"


def alignment_picture(query: Column, ref: Column) -> Column:
    """Marks below two aligned sequences: ``!`` for a mismatch, ``~`` for symbols that
    differ but can match, a space where they are equal."""
    mark = lambda a, b: F.when(a == b, F.lit(" ")).when(bases.can_match(a, b), F.lit("~")).otherwise("!")
    return F.array_join(F.zip_with(F.split(query, ""), F.split(ref, ""), mark), "")
