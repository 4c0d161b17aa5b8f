"""Summaries of callers and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import running


def quantiles(df: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Exact interpolated quantiles, mean, population deviation and sample deviation."""
    q = F.percentile(value, F.array(*(F.lit(x) for x in at)))
    out = df.groupBy(*by).agg(q.alias("_q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std_samp"), F.count(value).alias("n"))
    return out.select(*by, *(F.col("_q")[i].alias(f"q{round(x * 100):02d}") for i, x in enumerate(at)), "mean", "std_pop", "std_samp", "n")


def class_counts(df: DataFrame, column: str, ranks: dict[str, int]) -> DataFrame:
    """Counts by class, and the height of the stack up to it, in the order of ``ranks``."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col(column)], F.lit(len(ranks)))
    counts = df.groupBy(column).agg(F.count("*").alias("n"))  # one row for each class
    return counts.withColumn("total", F.sum("n").over(Window.orderBy(rank, column)))


def novel(sample: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a sample that none of the others has."""
    for other in others:
        sample = sample.join(other.select(*keys).distinct(), keys, "left_anti")
    return sample


def slope(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def outcomes_long(df: DataFrame, key: str, tools: list[str], yes: str = "True", no: str = "False") -> DataFrame:
    """A boolean column for each tool to rows (key, Tool, Value)."""
    return df.unpivot(key, tools, "Tool", "_v").select(key, "Tool", F.when(F.col("_v"), yes).otherwise(no).alias("Value"))


def outcome_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, width: float, by: list[str]) -> DataFrame:
    return df.groupBy(*by, (F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def class_ratio(df: DataFrame, label: str, value: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    part = lambda x: F.sum(F.when(F.col(label) == x, F.col(value)))
    return df.groupBy(*(by or [])).agg(F.try_divide(part(a), part(b)).alias("ratio"))


def rebased(df: DataFrame, target: int, near: int = 20, pos: str = "POS") -> DataFrame:
    """Rows around a position, counted from the start of the slice."""
    return df.filter(F.col(pos).between(target - near, target + near)).withColumn(pos, F.col(pos) - (target - near))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided probability of a 2 x 2 table (the driver's counts)."""
    row, col, n = a + b, a + c, a + b + c + d
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    logp = lambda k: lc(row, k) + lc(n - row, col - k) - lc(n, col)
    own = logp(a)
    p = math.fsum(math.exp(logp(k)) for k in range(max(0, col - (n - row)), min(row, col) + 1) if logp(k) <= own + 1e-7)
    odds = math.inf if b * c == 0 and a * d else math.nan if b * c == 0 else a * d / (b * c)
    return odds, min(1.0, p)


def ks_distance(df: DataFrame, value: str, which: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between rows where ``which`` holds and not.

    Values are counted before they are ordered, and ordered within 4,096 steps between
    the least and the greatest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(which)).alias("_a"), F.count_if(~F.col(which)).alias("_b"))
    totals = counts.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    counts = counts.crossJoin(F.broadcast(totals))  # of one row
    block = F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("_lo")) * 4096, F.col("_hi") - F.col("_lo")), F.lit(0)))
    sums = running(counts, [], block, [value], {"_a": (F.col("_a"), "sum"), "_b": (F.col("_b"), "sum")})
    return sums.agg(F.max(F.abs(F.col("_a") / F.col("_ta") - F.col("_b") / F.col("_tb"))).alias("distance"), F.max("_ta").alias("n_a"), F.max("_tb").alias("n_b"))  # one row


def ks_probability(distance: Column, n_a: Column, n_b: Column) -> Column:
    """Probability of such a distance or a larger one between samples of one distribution,
    by Kolmogorov's series (for large samples)."""
    z = distance * F.sqrt(n_a * n_b / (n_a + n_b))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1).otherwise(-1) * F.exp(-2.0 * k * k * z * z))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def among(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(values))


def members(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys another table has."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def merged(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, beside the other table's where it has the keys."""
    return df.join(other, keys, "left")


#: Parts of result files' names and what they say.
MAPPERS = {"bowtie": "bowtie2", "bwa": "bwa", "minimap": "minimap2"}
CALLERS = {"": "bcftools Mul-ALT", ".mappersamtovcf": "own", ".bcfdefault": "bcftools default", ".indel": "bcftools indel"}


def labelled(df: DataFrame, column: str = "sample") -> DataFrame:
    """Adds ``genome``, ``planted`` (mutations in the truth), ``mapper`` and ``caller`` as the
    name of a result file tells them."""
    name = F.col(column)
    stem = F.substring_index(F.substring_index(name, ".flt", 1), ".vcf", 1)
    tool = lambda k: F.regexp_extract(stem, rf"\.({'|'.join(MAPPERS)})(\.[a-z]+)?$", k)
    pick = lambda names, key: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[key]
    planted = F.regexp_extract(name, r"\.(?:fasta|corrected)\.(\d+)\.", 1).try_cast("int")
    return df.withColumns({"genome": F.substring_index(name, ".", 1), "planted": planted, "mapper": pick(MAPPERS, tool(1)), "caller": pick(CALLERS, tool(2))})


def insertion_offset(gapped: str, reference: str) -> Column:
    """Bases from the first aligned base of a gapped read to the first gap of the
    reference's line."""
    return F.instr(reference, "-") - F.regexp_instr(gapped, F.lit("[acgtACGT]"))
