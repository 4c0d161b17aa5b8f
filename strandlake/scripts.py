"""Filters over a folder of VCF summaries: python -m strandlake.scripts COMMAND -i FOLDER

    points   FILE.vcf -> FILE.vcf.point_mutation.txt
    indels   FILE.vcf -> FILE.vcf.indel.txt
    final    FILE.vcf -> FILE.vcf.final.vcf (rows), FILE.vcf.final.txt (alternates); without
             the ends of contigs whose names tell their length, and without a baseline's places
    compare  *.final.txt against *.truth.txt -> model.sum.txt (FP, FN and total of each sample)
"""

from __future__ import annotations

import argparse
import glob
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calls, compare
from .sources import files
from .sources.local import write_table

#: Names of the columns of result tables.
POINT_COLUMNS = ["CHR", "POS", "REF", "ALT", "DPall", "DPsnp"]
INDEL_COLUMNS = ["CHR", "POS", "REF", "INDEL", "Depth", "Total_depth"]
SUMMARY_COLUMNS = ["sample", "FP", "FN", "total_refSNP"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake.scripts", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["points", "indels", "final", "compare"])
    p.add_argument("-i", default="test_vcf/", metavar="FOLDER")
    p.add_argument("-af", "-allele-frequency", type=float, default=None, help="least share of the depth (default 0.9, or what the path's data set asks for)")
    p.add_argument("-rd", "-read-depth", type=float, default=None, help="least reads (default 3, or what the path's data set asks for)")
    p.add_argument("-baseline", default=None, metavar="FILE.vcf", help="calls of a run without mutations, whose places do not count")
    return p


def points(vcf: DataFrame, fraction: float, reads: float) -> DataFrame:
    return calls.point_mutations(vcf, fraction, reads).orderBy("ord", "rank").select(*POINT_COLUMNS)


def indels(vcf: DataFrame, fraction: float, reads: float) -> DataFrame:
    return calls.script_indel_runs(calls.indel_rows(vcf, fraction, reads), "ord").orderBy("closed", "insertion").select(*INDEL_COLUMNS)


def final(vcf: DataFrame, fraction: float, reads: float, baseline: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Qualified rows as they were, and their alternates one by one."""
    vcf = calls.away_from_ends(vcf)
    if baseline is not None:
        vcf = compare.without_baseline(vcf, baseline)
    found = calls.point_mutations(vcf, fraction, reads)
    rows = vcf.join(found.select("ord").distinct(), "ord", "left_semi").orderBy("ord").drop("ord")
    return rows, found.orderBy("ord", "rank").select(*POINT_COLUMNS)


def main(args: list[str]) -> int:
    o = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    default = calls.thresholds_for(o.i)
    fraction, reads = default[0] if o.af is None else o.af, default[1] if o.rd is None else o.rd
    if o.command == "compare":
        out = []
        for path in sorted(glob.glob(f"{o.i}/*.final.txt")):
            sample = os.path.basename(path).removesuffix(".final.txt")
            found = files.read_table(spark, path).select("CHR", "POS", F.col("ALT").alias("REF"))
            truth = files.read_truth(spark, f"{o.i}/{sample}.truth.txt").select("CHR", "POS", F.col("REF_after").alias("REF"))
            c = compare.confusion(found, truth).first()
            out.append((sample, c["FP"], c["FN"], c["total"]))
        write_table(spark.createDataFrame(out, "sample string, FP long, FN long, total long").toDF(*SUMMARY_COLUMNS), f"{o.i}/model.sum.txt")
        return 0
    baseline = files.read_own_vcf(spark, o.baseline) if o.baseline else None
    for path in sorted(p for p in glob.glob(f"{o.i}/*.vcf") if not p.endswith(".final.vcf")):
        vcf = files.read_own_vcf(spark, path)
        if o.command == "points":
            write_table(points(vcf, fraction, reads), f"{path}.point_mutation.txt")
        elif o.command == "indels":
            write_table(indels(vcf, fraction, reads), f"{path}.indel.txt")
        else:
            rows, alternates = final(vcf, fraction, reads, baseline)
            write_table(rows, f"{path}.final.vcf")
            write_table(alternates, f"{path}.final.txt")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
