"""Sequence and alignment files as DataFrames, by Spark's own text reader.

Gzipped files are read by the same paths.  Several files are a union with the
number of each as ``input_index``."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bases, sam_fields
from .local import spooled

#: The kinds of files by their suffixes.
SUFFIXES = {".fasta": "fasta", ".fa": "fasta", ".fna": "fasta", ".fastq": "fastq", ".fq": "fastq", ".ca": "fastq", ".sam": "sam"}
REFERENCE = "name string, seq string, length int, path string, ordinal long, input_index int"
COMPONENT = (
    "input_index int, line_ord struct<block:bigint,row:bigint>, qname string, contig string, pos int, rev boolean, "
    "cigar string, seq string, seq_len int, expect array<struct<contig:string,pos:int,rev:boolean>>"
)


def kind_of(path: str) -> str:
    """File kind by suffix, below a ``.gz``; unknown suffixes are an error."""
    name = path.removesuffix(".gz")
    for suffix, kind in SUFFIXES.items():
        if name.endswith(suffix):
            return kind
    raise ValueError(f"Unrecognized file extension: {path}")


def read_fasta(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    """One row for each record; names end at the first space, bodies lose line ends.

    Records are split at ``>``: the text source needs one whole record, not the file."""
    raw = spark.read.option("lineSep", ">").text(path).select("value", F.monotonically_increasing_id().alias("ordinal"), F.col("_metadata.file_path").alias("path"))
    return parse_fasta(raw, index)


def parse_fasta(raw: DataFrame, index: int = 0) -> DataFrame:
    """Records without their ``>`` (columns value, ordinal, path) as contigs.  ``ordinal`` tells
    the order of the records; it need not be gapless, so nothing is moved to count them."""
    head = F.regexp_replace(F.regexp_extract("value", r"^([^\r\n]*)", 1), "\r$", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    rows = raw.filter(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)
    name = F.when(F.instr(head, " ") > 1, F.substring_index(head, " ", 1)).otherwise(head)
    return rows.select(name.alias("name"), bases.checked(body).alias("seq"), F.length(body).alias("length"), "path", "ordinal", F.lit(index).alias("input_index"))


def read_fastq(spark: SparkSession, path: str, keep_quality: bool = False, index: int = 0) -> DataFrame:
    """One row for each four lines, in one pass over each file's lines in order.

    Lines are numbered by counts of partitions, so no partition holds the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    per = lines.groupBy("path", "_b").agg(F.count("*").alias("_c"))
    per = per.select("path", "_b", F.coalesce(F.sum("_c").over(Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    within = F.row_number().over(Window.partitionBy("path", "_b").orderBy("_m")) - 1
    lines = lines.withColumn("_k", within).join(F.broadcast(per), ["path", "_b"]).withColumn("_k", F.col("_k") + F.col("_from"))
    part = lambda k: F.max(F.when(F.col("_k") % 4 == k, F.col("value")))
    rows = lines.groupBy("path", F.floor(F.col("_k") / 4).alias("_rec")).agg(part(0).alias("h"), part(1).alias("s"), part(3).alias("q"))
    head = F.when(F.col("h").startswith("@"), F.substring("h", 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("Expected a name line, found: "), "h")).cast("string"))
    suffix = F.when(F.instr(head, " ") > 0, F.substring(head, F.instr(head, " "), F.length(head)))
    return rows.select(
        F.substring_index(head, " ", 1).alias("name"), bases.checked(F.col("s")).alias("seq"), F.length("s").alias("length"), "path", F.col("_rec").cast("long").alias("ordinal"), F.lit(index).alias("input_index"),
        suffix.alias("name_suffix"), (F.col("q") if keep_quality else F.lit(None).cast("string")).alias("quality"),
    )


def read_reference(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All contigs of all files, in the order of the files."""
    names = [f.split()[0] for f in REFERENCE.split(", ")]
    parts = [(read_fasta if kind_of(p) == "fasta" else read_fastq)(spark, p, index=i).select(*names) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def parse_sam(lines: DataFrame) -> DataFrame:
    """SAM lines (columns value, input_index, line_ord) as typed rows, kept or not.

    Header lines go; a line that cannot be parsed fails and is quoted.  Lines are split once:
    no filter on a field moves below the generator and splits them again."""
    lines = lines.select("input_index", "line_ord", F.explode(F.array(F.split("value", "\t"))).alias("_f"))
    f = F.col("_f")
    bad = F.raise_error(F.concat(F.lit("Failed to parse sam line: "), F.array_join(f, "\t")))
    number = lambda k: F.when(F.size(f) > k, F.get(f, F.lit(k)).try_cast("int"))
    flags, pos = number(1), number(3)
    ok = (F.size(f) >= 10) & flags.isNotNull() & pos.isNotNull()
    contig = F.when(ok, sam_fields.first_word(F.get(f, F.lit(2)))).otherwise(bad.cast("string"))
    next_contig = F.when(F.get(f, F.lit(6)) == "=", contig).otherwise(F.get(f, F.lit(6)))
    wants_mate = (next_contig != "*") & ~sam_fields.flag(flags, 8)
    mate_pos = F.when(wants_mate, F.coalesce(number(7), bad.cast("int")))
    place = F.struct(next_contig.alias("contig"), mate_pos.alias("pos"), sam_fields.flag(flags, 32).alias("rev"))
    tags = F.when(F.size(f) > 10, F.slice(f, 11, 1 << 20)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast(f"array<{sam_fields.PLACE}>")
    tagged = (F.size(f) > 11) | F.get(f, F.lit(10)).startswith("SA:Z:")  # lines without tags pass by the functions of arrays
    some = F.when(tagged & F.exists(tags, lambda t: t.startswith("SA:Z:")), sam_fields.supplementary(tags)).otherwise(none)
    expect = F.concat(F.when(wants_mate, F.array(place)).otherwise(none), some)
    lines = lines.filter(~f[0].startswith("@") & ((F.size(f) > 1) | (f[0] != "")))
    return lines.select(
        "input_index", "line_ord", F.get(f, F.lit(0)).alias("qname"), contig.alias("contig"), pos.alias("pos"), sam_fields.flag(flags, 16).alias("rev"),
        F.get(f, F.lit(5)).alias("cigar"), F.upper(F.get(f, F.lit(9))).alias("seq"), F.length(F.get(f, F.lit(9))).alias("seq_len"), expect.alias("expect"), sam_fields.bad_supplementary(tags).alias("bad_tags"),
    )


def kept(parsed: DataFrame) -> DataFrame:
    """Lines with a contig, a CIGAR string and a sequence; flags such as secondary or
    duplicate, mapping quality and base quality are not looked at."""
    return parsed.filter((F.col("contig") != "*") & (F.col("cigar") != "*") & (F.col("seq") != "*")).drop("bad_tags")


def dropped_counts(parsed: DataFrame) -> DataFrame:
    """How many lines the filters of ``kept`` leave out, by reason, in one pass."""
    aligned = F.col("contig") != "*"
    return parsed.agg(
        F.count("*").alias("lines"), F.count_if(~aligned).alias("unaligned"), F.count_if(aligned & (F.col("cigar") == "*")).alias("without_cigar"),
        F.count_if(aligned & (F.col("cigar") != "*") & (F.col("seq") == "*")).alias("without_sequence"), F.coalesce(F.sum("bad_tags"), F.lit(0)).alias("bad_tags"),
    )


def read_sam_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with their place: byte offset of the split, then order within it."""
    parts = []
    for i, path in enumerate(paths):
        if path == "-":
            path = spooled(spark, sys.stdin.buffer)
        order = F.struct(F.col("_metadata.file_block_start").cast("long").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
        parts.append(spark.read.text(path).select("value", F.lit(i).alias("input_index"), order.alias("line_ord")))
    return reduce(DataFrame.unionByName, parts)


def read_sam(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return kept(parse_sam(read_sam_lines(spark, paths)))


def read_own_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an alternate of a VCF summary, comments skipped; ``ord`` is their order."""
    names = ["CHR", "POS", "REF", "ALT", "DP", "MIDDLE", "ENDS", "SUPPORT"]
    f = F.split("value", "\t")
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter(~F.col("value").startswith("#") & ~F.col("value").startswith("CHR\t"))
    out = rows.select("ord", *(F.when(F.get(f, F.lit(k)) == ".", "").otherwise(F.get(f, F.lit(k))).alias(n) for k, n in enumerate(names)))
    return out.filter(F.col("MIDDLE").contains(";")).withColumns({"POS": F.col("POS").cast("int"), "DP": F.col("DP").cast("double")})


def read_foreign_vcf(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of another caller's VCF; ``ISO-8859-1`` reads files that are no UTF-8."""
    return parse_foreign_vcf(spark.read.option("encoding", encoding).option("lineSep", "\n").option("sep", "\x01").option("quote", "").schema("value string").csv(path))


def parse_foreign_vcf(lines: DataFrame) -> DataFrame:
    """CHR, POS, REF, ALT, QUAL, and the alleles' depths: what follows the last ``__`` of the
    tenth column.  Depths that are no numbers are null; ``DP`` is the sum of the others."""
    f = F.split("value", "\t")
    field = lambda k: F.get(f, F.lit(k))
    depths = F.transform(F.split(F.element_at(F.split(field(9), "__"), -1), ","), lambda x: x.try_cast("double"))
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    total = F.aggregate(depths, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return rows.select(field(0).alias("CHR"), field(1).cast("int").alias("POS"), field(3).alias("REF"), field(4).alias("ALT"), field(5).try_cast("double").alias("QUAL"), depths.alias("depths"), total.alias("DP"))


#: Columns of truth lists.
SNP_TRUTH = "CHR string, POS int, REF_before string, REF_after string, type string, aa string"
INDEL_TRUTH = "CHR string, POS int, INDEL string, REF string"


def read_truth(spark: SparkSession, path: str, schema: str = SNP_TRUTH) -> DataFrame:
    """Planted mutations, one a line; a line with fewer fields has nulls."""
    return spark.read.option("sep", "\t").option("header", False).schema(schema).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, line_end: str | None = None) -> DataFrame:
    """A tab-separated result or truth table; no-break spaces around values go."""
    reader = spark.read.option("sep", "\t").option("header", header)
    if line_end:
        reader = reader.option("lineSep", line_end)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.select(*(F.trim(F.translate(c, " ", " ")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
