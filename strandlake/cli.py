"""Command line: python -m strandlake.cli --reference r.fa --in-sam reads.sam --out-vcf o.vcf"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from .operators import reports
from .operators.filters import Thresholds
from .plans.variants import Run
from .sources.local import write_text

VERSION = "strandlake 0.1"
#: Names of options, and below the headers of the reports.
USAGE = """\
--reference FILE            FASTA or FASTQ, may be given several times (required)
--in-ordered-sam FILE       reads of one query stand together
--in-unordered-sam FILE, --in-sam FILE
--out-vcf FILE [thresholds] --out-mutations FILE [thresholds]
    --snp-threshold DEPTH FRACTION --indel-start-threshold DEPTH FRACTION
    --indel-continue-threshold DEPTH FRACTION --indel-threshold DEPTH FRACTION
--out-sam FILE --out-refs-map-count FILE
--vcf-exclude-non-mutations --vcf-omit-support-reads
--distinguish-query-ends FRACTION (0 <= FRACTION < 1, default 0.1)
--num-threads N --no-output --help --version -v -vv"""


@dataclass
class Options:
    references: list[str] = field(default_factory=list)
    sams: list[str] = field(default_factory=list)
    ordered: bool = True
    vcf: str | None = None
    vcf_thresholds: Thresholds = Thresholds()
    mutations: str | None = None
    mutation_thresholds: Thresholds = field(default_factory=Thresholds.for_mutations)
    sam: str | None = None
    refs_map_count: str | None = None
    only_mutations: bool = False
    support: bool = True
    end_fraction: float = 0.1
    threads: int = 1
    no_output: bool = False
    verbose: int = 0
    help: bool = False
    version: bool = False


def parse(args: list[str]) -> Options:
    """Threshold options belong to the output that they directly follow."""
    o, rest = Options(), list(args)

    def take(name: str) -> str:
        if not rest:
            raise ValueError(f"{name} needs a value")
        return rest.pop(0)

    def thresholds(t: Thresholds) -> Thresholds:
        while rest and rest[0] in ("--snp-threshold", "--indel-start-threshold", "--indel-continue-threshold", "--indel-threshold"):
            name = rest.pop(0)
            d, f = float(take(name)), float(take(name))
            if name == "--snp-threshold":
                t = replace(t, snp_depth=d, snp_fraction=f)
            if name in ("--indel-start-threshold", "--indel-threshold"):
                t = replace(t, start_depth=d, start_fraction=f)
            if name in ("--indel-continue-threshold", "--indel-threshold"):
                t = replace(t, go_on_depth=d, go_on_fraction=f)
        return t

    while rest:
        a = rest.pop(0)
        if a == "--reference":
            o.references.append(take(a))
        elif a == "--in-ordered-sam":
            o.sams.append(take(a))
        elif a in ("--in-unordered-sam", "--in-sam"):
            o.sams.append(take(a))
            o.ordered = False
        elif a == "--out-vcf":
            o.vcf = take(a)
            o.vcf_thresholds = thresholds(o.vcf_thresholds)
        elif a == "--out-mutations":
            o.mutations = take(a)
            o.mutation_thresholds = thresholds(o.mutation_thresholds)
        elif a == "--out-sam":
            o.sam = take(a)
        elif a == "--out-refs-map-count":
            o.refs_map_count = take(a)
        elif a == "--out-ancestor":
            take(a)  # accepted, without effect
        elif a == "--vcf-exclude-non-mutations":
            o.only_mutations = True
        elif a == "--vcf-omit-support-reads":
            o.support = False
        elif a == "--distinguish-query-ends":
            o.end_fraction = float(take(a))
        elif a == "--num-threads":
            o.threads = int(take(a))
        elif a == "--no-output":
            o.no_output = True
        elif a in ("-v", "--verbose", "--verbose-alignment", "--verbose-reference", "--verbosity-auto"):
            o.verbose = max(o.verbose, 1)
        elif a == "-vv":
            o.verbose = 2
        elif a in ("--help", "--version"):
            setattr(o, a[2:], True)
        else:
            raise ValueError(f"Unrecognized argument: {a}")
    if o.help or o.version:
        return o
    if not o.references or not o.sams:
        raise ValueError("--reference and an input of reads are required")
    if not 0 <= o.end_fraction < 1 or o.threads < 1:
        raise ValueError("--distinguish-query-ends must be in [0, 1) and --num-threads at least 1")
    if not (o.vcf or o.mutations or o.sam or o.refs_map_count or o.no_output):
        raise ValueError("No output specified; --no-output asks for none")
    return o


def main(args: list[str]) -> int:
    try:
        o = parse(args)
    except ValueError as e:
        print(f"{e}\n{USAGE}", file=sys.stderr)
        return 1
    if o.help or o.version:
        print(VERSION if o.version else USAGE)
        return 0
    spark = SparkSession.builder.master(f"local[{o.threads}]").getOrCreate()
    run = Run(spark, o.sams, o.references, o.ordered, o.end_fraction, o.support)
    if o.vcf:
        names = ["#CHROM", "POS", "REF", "ALT", "DP", "DETAILS-MIDDLE", "DETAILS-ENDS"] + ["SUPPORT"] * o.support
        write_text(reports.vcf_lines(run.vcf(o.vcf_thresholds, o.only_mutations)), o.vcf, ['##fileType="Vcf summary of variants"', "", "\t".join(names)])
    if o.mutations:
        write_text(reports.mutation_lines(run.mutations(o.mutation_thresholds)), o.mutations, ["# Version 1", "", "CHROM\tPOS\tREF\tALT\tDEPTH\tTOTAL_DEPTH"])
    if o.sam:
        write_text(reports.sam_lines(run.sam()), o.sam, reports.sam_header(run.reference))
    if o.refs_map_count:
        rows = run.refs_map_count().orderBy("Genome_set")
        write_text(rows.selectExpr("concat_ws('\t', Genome_set, No_reads) AS value"), o.refs_map_count, ["Genome_set\tNo.reads"])
    s = run.statistics().first()
    print(f"Queries: {s['queries']}, alignments: {s['alignments']}, aligned bases: {s['aligned_bases']}")
    print(f"Distance between pairs: {s['mean']} +- {s['stddev']}; coverage: {reports.coverage_text(s['covered'], s['bases'])}")
    errors = run.errors()
    print(f"Errors: {errors}")
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
