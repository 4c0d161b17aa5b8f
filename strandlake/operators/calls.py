"""Point mutations and indel runs from VCF summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sam_fields


def allele_depths(details: Column) -> Column:
    """``a,b;c,d`` to [a + b, c + d]: reference first, then the alternates."""
    return F.transform(F.split(details, ";"), lambda p: F.aggregate(F.split(p, ","), F.lit(0.0), lambda s, x: s + F.coalesce(x.try_cast("double"), F.lit(0.0))))


def point_mutations(vcf: DataFrame, fraction: float = 0.9, reads: float = 3) -> DataFrame:
    """CHR, POS, REF, ALT, DPall, DPsnp of alternates of bases (no deletions) that have
    ``reads`` reads and ``fraction`` of the depth at least; REF ``N`` does not count.  If rows
    have ``ord``, it stays, with the alternate's ``rank`` in its row."""
    both = F.zip_with(allele_depths(F.col("MIDDLE")), allele_depths(F.col("ENDS")), lambda a, b: a + b)
    rows = vcf.filter((F.col("POS") > 0) & (F.col("REF") != "N") & (F.col("DP") > 0)).withColumn("_d", both)
    place = [c for c in ("ord",) if c in vcf.columns]
    rows = rows.select("CHR", "POS", "REF", "DP", F.posexplode(F.split("ALT", ",")).alias("rank", "ALT"), "_d", *place).withColumn("_n", F.get("_d", F.col("rank") + 1))
    rows = rows.filter((F.col("ALT") != "-") & (F.col("_n") / F.col("DP") >= fraction) & (F.col("_n") >= reads))
    return rows.select("CHR", "POS", "REF", "ALT", F.col("DP").alias("DPall"), F.col("_n").alias("DPsnp"), *([*place, "rank"] if place else []))


def indel_rows(vcf: DataFrame, fraction: float = 0.9, reads: float = 3) -> DataFrame:
    """Rows of insertions (POS < 0) and deletions by their middle depths: enough reads,
    and a ratio of ``max(fraction - 0.1, 0.01)`` at least; ``strict`` where it reaches
    ``fraction``.  The first alternate that passes stands for an insertion row."""
    lenient = max(fraction - 0.1, 0.01)
    d = allele_depths(F.col("MIDDLE"))
    rows = vcf.filter((F.col("POS") < 0) | F.col("ALT").contains("-")).withColumn("_d", d).withColumn("_t", F.aggregate("_d", F.lit(0.0), lambda s, x: s + x))
    alts = F.zip_with(F.split("ALT", ","), F.slice("_d", 2, 1 << 20), lambda a, n: F.struct(a.alias("allele"), n.alias("n")))
    good = F.filter(alts, lambda x: F.when(F.col("POS") > 0, x["allele"] == "-").otherwise(x["allele"] != "-") & (x["n"] >= reads) & (F.col("_t") >= reads) & (x["n"] >= lenient * F.col("_t")))
    rows = rows.withColumn("_a", F.get(good, F.lit(0))).filter(F.col("_a").isNotNull())
    return rows.select("CHR", F.abs("POS").alias("POS"), (F.col("POS") < 0).alias("insertion"), "REF", F.col("_a.allele").alias("allele"), F.col("_a.n").alias("n"), F.col("_t").alias("total"), (F.col("_a.n") >= fraction * F.col("_t")).alias("strict"), *([c for c in ("ord",) if c in vcf.columns]))


def islands(rows: DataFrame, key: Column, sort: list[str], near: int) -> DataFrame:
    """One row for each run of rows that belong together: insertion rows at one position,
    deletion rows within ``near`` of the one before.  A run counts from its first row that
    reaches the strict ratio: before it ``k`` is null.  Means of depths, bases in order."""
    kind = Window.partitionBy("_key", "insertion").orderBy(*sort)
    step = F.when(F.col("insertion"), F.col("POS") != F.lag("POS").over(kind)).otherwise(F.col("POS") - F.lag("POS").over(kind) > near)
    rows = rows.withColumn("_key", key).withColumn("_new", F.coalesce(step, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(kind.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy("_key", "insertion", "_run").orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_open", F.max(F.col("strict").cast("int")).over(run) == 1)
    held = lambda x: F.when(F.col("_open"), x)
    item = F.struct(*(F.col(c).alias(f"p{i}") for i, c in enumerate(sort)), "CHR", "POS", "REF", "allele")
    out = rows.groupBy("_key", "insertion", "_run").agg(
        F.min(F.struct(*sort)).alias("_first"), F.array_sort(F.collect_list(held(item))).alias("_x"), F.avg(held(F.col("n"))).alias("Depth"), F.avg(held(F.col("total"))).alias("Total_depth"), F.sum(held(F.lit(1))).alias("k")
    )
    joined = lambda c: F.array_join(F.transform("_x", lambda x: x[c]), "")
    text = F.when(F.col("insertion"), joined("allele")).otherwise(F.concat(F.lit("-"), joined("REF")))
    first = F.get("_x", F.lit(0))
    return out.select("insertion", "_first", "k", first["CHR"].alias("CHR"), first["POS"].alias("POS"), F.when(F.col("insertion"), F.lit("-")).otherwise(joined("REF")).alias("REF"), text.alias("INDEL"), "Depth", "Total_depth")


def indel_runs(rows: DataFrame, near: int = 10, shortest: int = 2, order: str | None = None) -> DataFrame:
    """CHR, POS, REF, INDEL, Depth, Total_depth of the islands of ``shortest`` rows and more.
    Runs never join contigs."""
    found = islands(rows, F.col("CHR"), ["POS", *([order] if order else [])], near)
    return found.filter(F.col("k") >= shortest).select("CHR", "POS", "REF", "INDEL", "Depth", "Total_depth")


def script_indel_runs(rows: DataFrame, order: str, near: int = 10, shortest: int = 2) -> DataFrame:
    """The same as rows in file order are read by a script that holds one insertion and one
    deletion: positions of insertions are compared across contigs too, a run is written
    (``closed``) when the next of its kind begins, at the end the deletion first.  An insertion
    has no REF there, a deletion no INDEL.

    All insertion rows stand in one order, so they pass one window; they are those that
    passed the filters of ``indel_rows``."""
    found = islands(rows, F.when(F.col("insertion"), F.lit("")).otherwise(F.col("CHR")), [order], near)
    begin = F.col("_first")[order]
    closed = F.coalesce(F.lead(begin).over(Window.partitionBy("insertion").orderBy(begin)), F.lit((1 << 63) - 1))
    found = found.withColumn("closed", closed).filter(F.col("k") >= shortest)
    return found.select("CHR", "POS", F.when(~F.col("insertion"), F.col("REF")).otherwise("").alias("REF"), F.when(F.col("insertion"), F.col("INDEL")).otherwise("").alias("INDEL"), "Depth", "Total_depth", "insertion", "closed")


def away_from_ends(df: DataFrame, margin: int = 10, contig: str = "CHR", pos: str = "POS") -> DataFrame:
    """Without positions within ``margin`` of the ends of contigs whose name tells their
    length; contigs without keep all."""
    n = sam_fields.contig_length(F.col(contig))
    return df.filter((n == 0) | ((F.col(pos) > margin) & (F.col(pos) < n - margin)))


def callable_foreign(vcf: DataFrame, quality: float = 40) -> DataFrame:
    return vcf.filter((F.col("QUAL") >= quality) & (F.col("REF") != "N"))


def before_insertion(df: DataFrame, contig: str = "CHR", pos: str = "POS", order: str = "ord") -> Column:
    """Whether the next row is an insertion."""
    return F.coalesce(F.lead(pos).over(Window.partitionBy(contig).orderBy(order)) < 0, F.lit(False))


#: Thresholds (fraction, reads) of the data sets that paths may name, in order of precedence.
DATASETS = {"covid": (0.5, 3), "human": (0.5, 5), "MGSW": (0.2, 20), "MGBIG": (0.05, 5), "MG": (0.05, 1)}


def dataset_thresholds(path: Column) -> tuple[Column, Column]:
    """Fraction and reads for the data set that a path names."""
    def pick(k: int, default: float) -> Column:
        out = F.lit(None)
        for name, v in reversed(DATASETS.items()):
            out = F.when(path.contains(name), F.lit(v[k])).otherwise(out)
        return F.coalesce(out, F.lit(default))

    return pick(0, 0.9), pick(1, 3)


def thresholds_for(path: str, default: tuple[float, float] = (0.9, 3)) -> tuple[float, float]:
    return next((v for k, v in DATASETS.items() if k in path), default)
