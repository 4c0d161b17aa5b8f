"""The query catalogue: every operator on the provided tables, with its SQL.

The tables hold no reads, so observations are derived from ``lineitem``: an order is a
read, a line one base of it.  Each entry is (function of (spark, sf_dir), SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bases, cigar, sam_fields
from ..functions.numbers import depth, hundredths, number_text
from ..operators import analysis, calls, compare, filters, grouping, pileup, reports
from ..operators.filters import Thresholds
from ..sources.local import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_POSITIONS: dict[tuple, DataFrame] = {}
LIMITS = Thresholds(snp_depth=2, snp_fraction=0.1, start_depth=1, start_fraction=0.2, go_on_depth=1, go_on_fraction=0.1)


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, insertions: bool = True) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.count("*").over(Window.partitionBy("l_orderkey"))
    pick = (F.floor("l_quantity") * 7 + F.col("l_linenumber")) % 6 + 1
    rows = li.select(
        F.col("l_orderkey").alias("read_id"), F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("contig"), F.col("l_partkey").cast("int").alias("pos"),
        F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("ref"), F.substring(F.lit("ACGT-N"), pick.cast("int"), F.lit(1)).alias("allele"), (F.col("l_linestatus") == "O").alias("fwd"),
        (F.col("l_returnflag") == "R").alias("near_end"), hundredths(F.lit(1.0) / k).alias("w100"), F.substring(F.lit("ACGT" * 10), F.lit(1), F.col("l_linenumber") * 2 + 10).alias("ex_seq"),
        F.col("l_linenumber").alias("_i"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("ex_name"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("ex_id"), (F.floor("l_quantity") % 5 == 0).alias("_ins"),
    )
    gone = F.col("allele") == "-"
    base, extra = F.col("allele") != "N", F.col("_ins") & ~gone
    own = F.array(F.lit(None).cast("int"))
    offset = F.array((F.col("_i") % 3).cast("int"))
    kinds = F.when(base & extra, F.concat(own, offset)).when(base, own).when(extra, offset) if insertions else F.when(base, own)
    rows = rows.withColumn("ins_idx", F.explode(kinds))  # one pass: a line is a base, an insertion, or both
    ins = F.col("ins_idx").isNotNull()
    rows = rows.withColumns({"ref": F.when(ins, "-").otherwise(F.col("ref")), "ex_del": gone, "ex_idx": F.when(gone, -F.col("_i")).otherwise(F.col("_i"))})
    return rows.drop("_ins", "_i")


def piled(spark: SparkSession, sf_dir: str, examples: bool = False) -> DataFrame:
    return pileup.with_absences(pileup.pileup(observations(spark, sf_dir), examples))


def position_rows(spark: SparkSession, sf_dir: str, examples: bool = False) -> DataFrame:
    """Many reports read the position table: it is written when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, examples)
    if key not in _POSITIONS:
        _POSITIONS[key] = cut(pileup.positions(piled(spark, sf_dir, examples), examples), "positions")
    return _POSITIONS[key]


RAW = """raw AS (
  SELECT l_orderkey AS read_id, 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS contig, CAST(l_partkey AS INTEGER) AS pos,
    substr('ACGT', CAST(1 + l_partkey % 4 AS INTEGER), 1) AS ref,
    substr('ACGT-N', CAST(1 + (CAST(floor(l_quantity) AS BIGINT) * 7 + l_linenumber) % 6 AS INTEGER), 1) AS allele,
    l_linestatus = 'O' AS fwd, l_returnflag = 'R' AS near_end, l_linenumber AS idx, CAST(floor(l_quantity) AS BIGINT) % 5 = 0 AS ins,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS ex_id,
    CAST(trunc(CAST(1.0 / count(*) OVER (PARTITION BY l_orderkey) AS FLOAT) * CAST(100 AS FLOAT)) AS INTEGER) AS w100
  FROM lineitem
), obs AS (
  SELECT *, CAST(NULL AS INTEGER) AS ins_idx FROM raw WHERE allele <> 'N'
  UNION ALL
  SELECT * REPLACE ('-' AS ref), CAST(idx % 3 AS INTEGER) FROM raw WHERE ins AND allele <> '-'
)"""
PILED = RAW + """, counted AS (
  SELECT contig, pos, ins_idx, ref, allele,
    sum(CASE WHEN fwd AND NOT near_end THEN w100 ELSE 0 END) AS fm, sum(CASE WHEN NOT fwd AND NOT near_end THEN w100 ELSE 0 END) AS rm,
    sum(CASE WHEN fwd AND near_end THEN w100 ELSE 0 END) AS fe, sum(CASE WHEN NOT fwd AND near_end THEN w100 ELSE 0 END) AS re
  FROM obs GROUP BY ALL
), based AS (
  SELECT contig, pos, sum(fm) AS fm, sum(rm) AS rm, sum(fe) AS fe, sum(re) AS re FROM counted WHERE ins_idx IS NULL GROUP BY ALL
), added AS (
  SELECT contig, pos, ins_idx, sum(fm) AS fm, sum(rm) AS rm, sum(fe) AS fe, sum(re) AS re FROM counted WHERE ins_idx IS NOT NULL GROUP BY ALL
), piled AS (
  SELECT * FROM counted
  UNION ALL
  SELECT a.contig, a.pos, a.ins_idx, '-', '-',
    greatest(0, trunc(CAST(coalesce(b.fm, 0) AS FLOAT) / CAST(100 AS FLOAT) * CAST(100 AS FLOAT)) - a.fm), greatest(0, trunc(CAST(coalesce(b.rm, 0) AS FLOAT) / CAST(100 AS FLOAT) * CAST(100 AS FLOAT)) - a.rm),
    greatest(0, trunc(CAST(coalesce(b.fe, 0) AS FLOAT) / CAST(100 AS FLOAT) * CAST(100 AS FLOAT)) - a.fe), greatest(0, trunc(CAST(coalesce(b.re, 0) AS FLOAT) / CAST(100 AS FLOAT) * CAST(100 AS FLOAT)) - a.re)
  FROM added a LEFT JOIN based b ON a.contig = b.contig AND a.pos = b.pos
), alleles AS (
  SELECT contig, pos, ins_idx, ref, allele, instr('ACGTN-', allele) AS rank, CAST(fm AS BIGINT) AS fm, CAST(rm AS BIGINT) AS rm, CAST(fe AS BIGINT) AS fe, CAST(re AS BIGINT) AS re,
    CAST(fm + rm + fe + re AS BIGINT) AS n, allele <> ref AND (CASE WHEN ins_idx IS NULL THEN allele = '-' ELSE allele <> '-' END) AS indel FROM piled
), positions AS (
  SELECT contig, pos, ins_idx, max(ref) AS ref, sum(fm + rm) AS middle, sum(fe + re) AS ends, sum(n) AS total,
    sum(CASE WHEN indel THEN fm + rm ELSE 0 END) AS indel_middle, sum(CASE WHEN indel THEN fe + re ELSE 0 END) AS indel_ends,
    sum(fm) AS t_fm, sum(rm) AS t_rm, sum(fe) AS t_fe, sum(re) AS t_re,
    sum(CASE WHEN allele = ref THEN fm ELSE 0 END) AS r_fm, sum(CASE WHEN allele = ref THEN rm ELSE 0 END) AS r_rm,
    sum(CASE WHEN allele = ref THEN fe ELSE 0 END) AS r_fe, sum(CASE WHEN allele = ref THEN re ELSE 0 END) AS r_re
  FROM alleles GROUP BY contig, pos, ins_idx
), flags AS (
  SELECT *, NOT (middle / 100.0 < 1) AND (indel_middle > 0 OR indel_ends > 0) AND (middle = 0 OR NOT ((CAST(indel_middle AS FLOAT) / CAST(100 AS FLOAT)) / (CAST(middle AS FLOAT) / CAST(100 AS FLOAT)) < CAST(0.2 AS FLOAT))) AS start_ok,
    NOT (middle / 100.0 < 1) AND (indel_middle > 0 OR indel_ends > 0) AND (middle = 0 OR NOT ((CAST(indel_middle AS FLOAT) / CAST(100 AS FLOAT)) / (CAST(middle AS FLOAT) / CAST(100 AS FLOAT)) < CAST(0.1 AS FLOAT))) AS go_ok
  FROM positions
)"""
ADMITTED = PILED + """, gaps AS (
  SELECT *, coalesce(lag(pos) OVER (PARTITION BY contig ORDER BY pos) <> pos - 1, pos > 0) AS gap FROM flags WHERE ins_idx IS NULL
), admitted AS (
  SELECT *, max(CASE WHEN start_ok THEN pos END) OVER w AS s, max(CASE WHEN NOT start_ok AND NOT go_ok THEN pos WHEN gap AND NOT start_ok THEN pos - 1 END) OVER w AS b FROM gaps
  WINDOW w AS (PARTITION BY contig ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), kept AS (
  SELECT a.* FROM alleles a JOIN admitted p ON a.contig = p.contig AND a.pos = p.pos
  WHERE a.ins_idx IS NULL AND a.allele <> a.ref AND a.n > 0 AND CASE WHEN a.allele = '-' THEN p.b IS NULL OR coalesce(p.s, -2) > p.b
    ELSE (CAST(p.t_fm AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_fe AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_rm AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_re AS FLOAT) / CAST(100 AS FLOAT)) >= CAST(2 AS FLOAT) AND NOT ((CAST(a.n AS FLOAT) / CAST(100 AS FLOAT)) / (CAST(p.t_fm AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_fe AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_rm AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_re AS FLOAT) / CAST(100 AS FLOAT)) < CAST(0.1 AS FLOAT)) END
), ins_ok AS (
  SELECT f.*, CASE WHEN ins_idx = 0 THEN start_ok ELSE go_ok END AS ok FROM flags f WHERE ins_idx IS NOT NULL
), ins_run AS (
  SELECT *, row_number() OVER w - 1 AS k, min(CASE WHEN ok AND EXISTS (SELECT 1 FROM alleles a WHERE a.contig = i.contig AND a.pos = i.pos AND a.ins_idx = i.ins_idx AND a.allele <> '-' AND a.n > 0) THEN 1 ELSE 0 END) OVER w AS all_ok
  FROM ins_ok i WINDOW w AS (PARTITION BY contig, pos ORDER BY ins_idx)
), ins_kept AS (SELECT * FROM ins_run WHERE k = ins_idx AND all_ok = 1)"""
NUM = "CASE WHEN {0} % 100 = 0 THEN CAST(CAST({0} // 100 AS BIGINT) AS VARCHAR) ELSE CAST(CAST({0} AS FLOAT) / CAST(100 AS FLOAT) AS VARCHAR) END"


@query(f"WITH {RAW} SELECT contig, CAST(pos AS BIGINT) AS pos, allele, CAST(sum(w100) AS BIGINT) AS w100 FROM obs WHERE ins_idx IS NULL GROUP BY contig, pos, allele")
def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pileup.pileup(observations(spark, sf_dir, insertions=False), examples=False)
    return out.select("contig", F.col("pos").cast("long").alias("pos"), "allele", (F.col("fm") + F.col("rm") + F.col("fe") + F.col("re")).cast("long").alias("w100"))


@query(f"WITH {PILED} SELECT contig, pos, ins_idx, ref, allele, fm, rm, fe, re FROM alleles")
def pileup_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piled(spark, sf_dir).select("contig", "pos", "ins_idx", "ref", "allele", *(F.col(c).cast("long").alias(c) for c in pileup.CONTAINERS))


@query(f"WITH {PILED} SELECT contig, pos, ins_idx, CAST(middle AS BIGINT) AS middle, CAST(ends AS BIGINT) AS ends, CAST(total AS BIGINT) AS total, CAST(r_fm + r_rm + r_fe + r_re AS BIGINT) AS own FROM positions")
def depth_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("r_fm") + F.col("r_rm") + F.col("r_fe") + F.col("r_re")
    return position_rows(spark, sf_dir).select("contig", "pos", "ins_idx", F.col("middle").cast("long").alias("middle"), F.col("ends").cast("long").alias("ends"), (F.col("middle") + F.col("ends")).cast("long").alias("total"), own.cast("long").alias("own"))


def _vcf_sql(only: bool) -> str:
    n = lambda x: NUM.format(x)
    dp = "CAST(p.t_fm AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_fe AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_rm AS FLOAT) / CAST(100 AS FLOAT) + CAST(p.t_re AS FLOAT) / CAST(100 AS FLOAT)"
    return f"""WITH {ADMITTED}, shown AS (
  SELECT contig, pos, CAST(NULL AS INTEGER) AS ins_idx, allele, rank, fm, rm, fe, re FROM kept
  UNION ALL SELECT a.contig, a.pos, a.ins_idx, a.allele, a.rank, a.fm, a.rm, a.fe, a.re FROM alleles a JOIN ins_kept k ON a.contig = k.contig AND a.pos = k.pos AND a.ins_idx = k.ins_idx WHERE a.allele <> '-' AND a.n > 0
), listed AS (
  SELECT contig, pos, ins_idx, string_agg(allele, ',' ORDER BY rank) AS alt,
    string_agg(';' || {n("fm")} || ',' || {n("rm")}, '' ORDER BY rank) AS dm, string_agg(';' || {n("fe")} || ',' || {n("re")}, '' ORDER BY rank) AS de
  FROM shown GROUP BY contig, pos, ins_idx
)
SELECT p.contig AS "CHROM", CASE WHEN p.ins_idx IS NULL THEN p.pos + 1 ELSE -(p.pos + 1) END AS "POS", p.ref AS "REF", coalesce(l.alt, '.') AS "ALT",
  CASE WHEN ({dp}) = trunc({dp}) THEN CAST(CAST({dp} AS BIGINT) AS VARCHAR) ELSE CAST({dp} AS VARCHAR) END AS "DP",
  {n("p.r_fm")} || ',' || {n("p.r_rm")} || coalesce(l.dm, '') AS "DETAILS_MIDDLE", {n("p.r_fe")} || ',' || {n("p.r_re")} || coalesce(l.de, '') AS "DETAILS_ENDS"
FROM positions p LEFT JOIN listed l ON p.contig = l.contig AND p.pos = l.pos AND p.ins_idx IS NOT DISTINCT FROM l.ins_idx
WHERE (p.ins_idx IS NOT NULL AND l.alt IS NOT NULL) OR (p.ins_idx IS NULL AND p.total > 0 {"AND l.alt IS NOT NULL" if only else ""})"""


@query(_vcf_sql(False))
def vcf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.vcf_rows(filters.filtered_positions(position_rows(spark, sf_dir), LIMITS), support=False).drop("at", "ins_idx")


@query(_vcf_sql(True))
def vcf_rows_mutations_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.vcf_rows(filters.filtered_positions(position_rows(spark, sf_dir), LIMITS), only_mutations=True, support=False).drop("at", "ins_idx")


@query(f"""WITH {ADMITTED} SELECT p.contig, p.pos, CAST(p.total AS BIGINT) AS total, coalesce(string_agg(k.allele, ',' ORDER BY k.rank), '') AS alts
FROM positions p LEFT JOIN kept k ON p.contig = k.contig AND p.pos = k.pos WHERE p.ins_idx IS NULL GROUP BY p.contig, p.pos, p.total""")
def depth_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.filtered_positions(position_rows(spark, sf_dir), LIMITS).filter("ins_idx is null")
    return rows.select("contig", "pos", (F.col("middle") + F.col("ends")).cast("long").alias("total"), F.array_join(F.transform("alts", lambda a: a["allele"]), ",").alias("alts"))


@query(f"""WITH {ADMITTED} SELECT k.contig AS "CHROM", k.pos + 1 AS "POS", k.ref AS "REF", k.allele AS "ALT", k.n / 100.0 AS depth FROM kept k WHERE k.allele <> '-' AND k.ref <> 'N'""")
def snp_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.mutation_rows(filters.filtered_positions(position_rows(spark, sf_dir), LIMITS)).filter("kind = 0")
    return rows.select("CHROM", "POS", "REF", "ALT", F.round(F.col("DEPTH").cast("double"), 2).alias("depth"))


@query(f"WITH {PILED} SELECT contig, pos, ins_idx, start_ok FROM flags")
def indel_start_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_rows(spark, sf_dir).select("contig", "pos", "ins_idx", filters.start_passes(LIMITS).alias("start_ok"))


@query(f"WITH {PILED} SELECT contig, pos, ins_idx, go_ok FROM flags")
def indel_continue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_rows(spark, sf_dir).select("contig", "pos", "ins_idx", filters.go_on_passes(LIMITS).alias("go_ok"))


@query(f"WITH {ADMITTED} SELECT contig, pos, (b IS NULL OR coalesce(s, -2) > b) AS admissible FROM admitted")
def deletion_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = position_rows(spark, sf_dir).filter("ins_idx is null")
    return filters.deletion_admissible(rows, filters.start_passes(LIMITS), filters.go_on_passes(LIMITS)).select("contig", "pos", "admissible")


@query(f"""WITH {ADMITTED}, d AS (
  SELECT k.contig, k.pos, k.ref, k.fm + k.rm AS m, p.middle, k.pos - row_number() OVER (PARTITION BY k.contig ORDER BY k.pos) AS run FROM kept k JOIN positions p ON k.contig = p.contig AND k.pos = p.pos AND p.ins_idx IS NULL WHERE k.allele = '-'
) SELECT contig, min(pos) AS "first", max(pos) AS "last", string_agg(ref, '' ORDER BY pos) AS ref, CAST(min(m) AS BIGINT) AS w100, CAST(min(middle) AS BIGINT) AS total100 FROM d GROUP BY contig, run""")
def deletion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.deletion_runs(filters.filtered_positions(position_rows(spark, sf_dir), LIMITS))
    return out.select("contig", "first", "last", "ref", F.col("w100").cast("long").alias("w100"), F.col("total100").cast("long").alias("total100"))


@query(f"WITH {ADMITTED} SELECT contig, pos, ins_idx, CAST(middle AS BIGINT) AS middle FROM ins_kept")
def insertion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filtered_positions(position_rows(spark, sf_dir), LIMITS).filter("ins_idx is not null").select("contig", "pos", "ins_idx", F.col("middle").cast("long").alias("middle"))


@query(f"""WITH {ADMITTED}, best AS (
  SELECT k.contig, k.pos, k.ins_idx, k.middle - k.r_fm - k.r_rm AS own, (SELECT a.allele FROM alleles a WHERE a.contig = k.contig AND a.pos = k.pos AND a.ins_idx = k.ins_idx AND a.allele <> '-' AND a.n > 0 ORDER BY a.n DESC, a.rank LIMIT 1) AS allele FROM ins_kept k
) SELECT b.contig, b.pos, string_agg(b.allele, '' ORDER BY b.ins_idx) AS bases, CAST(arg_max(b.own, b.ins_idx) AS BIGINT) AS w100, CAST(max(p.middle) AS BIGINT) AS total100
FROM best b JOIN positions p ON b.contig = p.contig AND b.pos = p.pos AND p.ins_idx IS NULL AND p.total > 0 GROUP BY b.contig, b.pos""")
def insertion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.insertion_runs(filters.filtered_positions(position_rows(spark, sf_dir), LIMITS))
    return out.select("contig", "pos", "bases", F.col("w100").cast("long").alias("w100"), F.col("total100").cast("long").alias("total100"))


@query(f"""WITH {RAW}, e AS (
  SELECT contig, pos, allele, 2 * idx + 10 AS n, CASE WHEN allele = '-' THEN -idx ELSE idx END AS i, 'r' || read_id AS name, ex_id,
    CASE WHEN fwd AND NOT near_end THEN 1 WHEN NOT fwd AND NOT near_end THEN 2 WHEN fwd THEN 3 ELSE 4 END AS c FROM obs WHERE ins_idx IS NULL AND allele <> ref
), r AS (
  SELECT *, row_number() OVER (PARTITION BY contig, pos, allele ORDER BY c, n DESC, abs(abs(i) - n // 2), i, name DESC, ex_id) AS k FROM e
) SELECT contig, pos, allele, CAST(n AS INTEGER) AS ex_len, CAST(i AS INTEGER) AS ex_index, name AS ex_name FROM r WHERE k = 1""")
def example_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pileup.pileup(observations(spark, sf_dir, insertions=False)).filter("allele != ref").withColumn("ex", pileup.shown_example(F.lit(False)))
    return rows.select("contig", "pos", "allele", F.length("ex.seq").alias("ex_len"), (-F.col("ex.i")).alias("ex_index"), F.col("ex.name").alias("ex_name"))


@query(f"""WITH {PILED}, r AS (
  SELECT a.contig, a.pos, a.ins_idx, a.allele, row_number() OVER (PARTITION BY a.contig, a.pos, a.ins_idx ORDER BY n DESC, rank) AS k FROM alleles a WHERE allele <> ref
) SELECT contig, pos, ins_idx, allele FROM r WHERE k = 1""")
def major_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_rows(spark, sf_dir).filter(F.size("alts") > 0).select("contig", "pos", "ins_idx", pileup.major_alternate(F.col("alts")).alias("allele"))


@query(f"""WITH {PILED}, r AS (
  SELECT p.contig, p.pos, p.ins_idx, p.ref, p.r_fm + p.r_rm + p.r_fe + p.r_re AS own, a.allele, a.n, row_number() OVER (PARTITION BY p.contig, p.pos, p.ins_idx ORDER BY a.n DESC, a.rank) AS k
  FROM positions p LEFT JOIN alleles a ON a.contig = p.contig AND a.pos = p.pos AND a.ins_idx IS NOT DISTINCT FROM p.ins_idx AND a.allele <> a.ref
) SELECT contig, pos, ins_idx, CASE WHEN coalesce(n, -1) > own THEN allele ELSE ref END AS allele FROM r WHERE k = 1""")
def major_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_rows(spark, sf_dir).select("contig", "pos", "ins_idx", pileup.major_allele().alias("allele"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT 'refs/' || l_returnflag || '.fa')) AS p FROM lineitem GROUP BY l_orderkey)
SELECT list_aggregate(list_transform(p, lambda x: replace(x, 'refs/', '')), 'string_agg', '-') || '-' AS "Genome_set", count(*) AS "No_reads" FROM s GROUP BY 1""")
def refs_map_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("input_index"), F.col("l_orderkey").alias("qname"), F.lit(1).alias("n_parts"), F.lit(0).alias("group_no"), F.col("l_returnflag").alias("contig"))
    refs = li.select(F.col("contig").alias("name")).distinct().withColumns({"path": F.concat(F.lit("refs/"), "name", F.lit(".fa")), "ordinal": F.lit(0)})
    return reports.refs_map_count(li, refs)


@query("""WITH p AS (SELECT o.o_orderkey % 10 AS g, CAST(l.l_partkey % 500 AS DOUBLE) AS x, 1.0 / l.l_linenumber AS w FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT g, round(sum(x * w) / sum(w), 6) AS mean, round(sqrt(greatest(0, (sum(x * x * w) - sum(x * w) * sum(x * w) / sum(w)) / sum(w))), 6) AS stddev FROM p GROUP BY g""")
def pair_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    p = li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("o_orderkey") % 10).alias("g"), (F.col("l_partkey") % 500).cast("double").alias("x"), (F.lit(1.0) / F.col("l_linenumber")).alias("w"))
    return reports.weighted_stats(p, "x", "w", ["g"]).select("g", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


CIGAR_SQL = "SELECT *, CAST(l_linenumber AS VARCHAR) || 'S' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || 'M' || CAST(l_linenumber AS VARCHAR) || 'I7M' || CAST(l_partkey % 9 + 1 AS VARCHAR) || 'D5M3N4M2H' AS cigar FROM lineitem"


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("l_linenumber").cast("string"), lambda x: x.cast("string")
    text = F.concat(n, F.lit("S"), s(F.floor("l_quantity")), F.lit("M"), n, F.lit("I7M"), s(F.col("l_partkey") % 9 + 1), F.lit("D5M3N4M2H"))
    return table(spark, sf_dir, "lineitem").withColumn("cigar", text)


@query(f"""WITH c AS ({CIGAR_SQL}), t AS (SELECT unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHPX=])', 1)) AS n, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHPX=])', 2)) AS op FROM c)
SELECT op, CAST(n AS INTEGER) AS n, count(*) AS times FROM t GROUP BY op, n""")
def cigar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cigars(spark, sf_dir).select(F.explode(cigar.tokens(F.col("cigar"))).alias("t"))
    return t.groupBy("t.op", "t.n").agg(F.count("*").alias("times")).select("op", "n", "times")


@query(f"""WITH c AS ({CIGAR_SQL}), p AS (SELECT l_partkey - 1 AS r, CAST(l_linenumber AS BIGINT) AS s, CAST(floor(l_quantity) AS BIGINT) AS m, CAST(l_linenumber AS BIGINT) AS i, l_partkey % 9 + 1 AS d FROM c),
b AS (SELECT unnest([[s, r, m, m], [s + m, r + m, i, 0], [s + m + i, r + m, 7, 7], [s + m + i + 7, r + m + 7, 0, d], [s + m + i + 7, r + m + 7 + d, 5, 5], [s + m + i + 12, r + m + 15 + d, 4, 4]]) AS x FROM p)
SELECT x[1] AS q_start, x[2] AS r_start, x[3] AS q_len, x[4] AS r_len, count(*) AS times FROM b GROUP BY ALL""")
def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cigars(spark, sf_dir).select(F.explode(cigar.blocks(F.col("cigar"), F.col("l_partkey"), F.lit(200))).alias("b"))
    names = ["q_start", "r_start", "q_len", "r_len"]
    return b.groupBy(*(F.col(f"b.{n}").cast("long").alias(n) for n in names)).agg(F.count("*").alias("times"))


@query(f"""WITH c AS ({CIGAR_SQL}) SELECT CAST(l_linenumber AS VARCHAR) || 'S' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || 'M' || CAST(l_linenumber AS VARCHAR) || 'I7M' || CAST(l_partkey % 9 + 1 AS VARCHAR) || 'D5M4M' ||
  CASE WHEN 2 * l_linenumber + floor(l_quantity) + 16 < 200 THEN CAST(CAST(200 - (2 * l_linenumber + floor(l_quantity) + 16) AS BIGINT) AS VARCHAR) || 'S' ELSE '' END AS cigar, count(*) AS times FROM c GROUP BY 1""")
def sam_reemit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGAR strings as they are written again: no hard clips, no skipped reference."""
    c = cigars(spark, sf_dir).select(cigar.from_blocks(cigar.blocks(F.col("cigar"), F.col("l_partkey"), F.lit(200)), F.lit(200)).alias("cigar"))
    return c.groupBy("cigar").agg(F.count("*").alias("times"))


SEQ_SQL = "SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EFIJLOPQUXZ', 'ACGTACGTACG') AS seq FROM documents WHERE text IS NOT NULL"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as sequences of nucleotide symbols."""
    text = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "EFIJLOPQUXZ", "ACGTACGTACG")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.alias("seq"))


@query(f"""WITH s AS ({SEQ_SQL}), b AS (SELECT unnest(string_split(seq, '')) AS base FROM s WHERE seq <> '')
SELECT base, CAST(instr('-ACMGRSVTWYHKDBN', base) - 1 AS INTEGER) AS code, bit_count(CAST(instr('-ACMGRSVTWYHKDBN', base) - 1 AS INTEGER)) > 1 AS ambiguous, translate(base, 'ACGTMRWSYKVHDBN-', 'TGCAKYWSRMBDHVN-') AS complement, count(*) AS n FROM b GROUP BY base""")
def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sequences(spark, sf_dir).filter("seq != ''").select(F.explode(F.split("seq", "")).alias("base")).filter("base != ''").groupBy("base").agg(F.count("*").alias("n"))
    c = F.col("base")
    return b.select("base", bases.code(c).alias("code"), bases.is_ambiguous(c).alias("ambiguous"), bases.complement(c).alias("complement"), "n")


@query(f"WITH s AS ({SEQ_SQL}) SELECT doc_id, md5(reverse(translate(seq, 'ACGTMRWSYKVHDBN-', 'TGCAKYWSRMBDHVN-'))) AS digest, CAST(length(seq) AS INTEGER) AS n FROM s")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("doc_id", F.md5(bases.reverse_complement(F.col("seq")).cast("binary")).alias("digest"), F.length("seq").alias("n"))


IUPAC = "-ACMGRSVTWYHKDBN"


@query("""WITH n AS (SELECT n_nationkey AS a FROM nation WHERE n_nationkey < 16), p AS (SELECT x.a AS a, y.a AS b FROM n x, n y)
SELECT substr('-ACMGRSVTWYHKDBN', CAST(a + 1 AS INTEGER), 1) AS a, substr('-ACMGRSVTWYHKDBN', CAST(b + 1 AS INTEGER), 1) AS b, (CAST(a AS INTEGER) & CAST(b AS INTEGER)) <> 0 AS matches, substr('-ACMGRSVTWYHKDBN', (CAST(a AS INTEGER) | CAST(b AS INTEGER)) + 1, 1) AS joined FROM p""")
def iupac_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the sixteen symbols."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 16").select(F.substring(F.lit(IUPAC), (F.col("n_nationkey") + 1).cast("int"), F.lit(1)).alias("a"))
    p = n.select("a", F.explode(F.array(*(F.lit(x) for x in IUPAC))).alias("b"))
    return p.select("a", "b", bases.can_match(F.col("a"), F.col("b")).alias("matches"), bases.union(F.col("a"), F.col("b")).alias("joined"))


@query(f"WITH s AS ({SEQ_SQL}) SELECT doc_id, CAST(length(seq) AS INTEGER) AS length, row_number() OVER (ORDER BY length(seq) DESC, doc_id) AS place FROM s")
def contig_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs by length, the longest first: ranks by blocks of equal lengths."""
    rows = sequences(spark, sf_dir).select("doc_id", F.length("seq").alias("length")).withColumn("_all", F.lit(0))
    return grouping.numbered(rows, ["_all"], -F.col("length"), ["doc_id"], "place").select("doc_id", "length", (F.col("place") + 1).alias("place"))


@query("""SELECT l_orderkey AS read_id, substr(repeat('ACGT', 10), 1, 2 * l_linenumber + 10) AS seq, l_linenumber AS i, l_returnflag = 'A' AS gone,
  CASE WHEN l_returnflag = 'A' THEN substr(substr(repeat('ACGT', 10), 1, 2 * l_linenumber + 10), 1, l_linenumber) || '[-]' || substr(substr(repeat('ACGT', 10), 1, 2 * l_linenumber + 10), l_linenumber + 1)
  ELSE substr(substr(repeat('ACGT', 10), 1, 2 * l_linenumber + 10), 1, l_linenumber) || '[' || substr(substr(repeat('ACGT', 10), 1, 2 * l_linenumber + 10), l_linenumber + 1, 1) || ']' || substr(substr(repeat('ACGT', 10), 1, 2 * l_linenumber + 10), l_linenumber + 2) END AS shown FROM lineitem""")
def support_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.substring(F.lit("ACGT" * 10), F.lit(1), F.col("l_linenumber") * 2 + 10).alias("seq"), F.col("l_linenumber").alias("i"), (F.col("l_returnflag") == "A").alias("gone"))
    return rows.withColumn("shown", bases.highlight(F.col("seq"), F.col("i"), F.col("gone")))


@query("""SELECT o_orderkey AS read_id, 'c' || CAST(o_custkey % 5 AS VARCHAR) AS contig, CAST(o_custkey AS INTEGER) AS pos, o_orderstatus = 'F' AS rev FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'x', 7, TRUE FROM orders WHERE o_orderkey % 3 <> 0""")
def sa_tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplementary places; every third tag has an entry with a field too few."""
    s = F.when(F.col("o_orderstatus") == "F", "-").otherwise("+")
    tail = F.when(F.col("o_orderkey") % 3 == 0, ",3M").otherwise(",3M,60,0")
    tag = F.concat(F.lit("SA:Z:c"), (F.col("o_custkey") % 5).cast("string"), F.lit(","), F.col("o_custkey").cast("string"), F.lit(","), s, tail, F.lit(";x,7,-,3M,60,0;"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.explode(sam_fields.supplementary(F.array(F.lit("NM:i:1"), tag))).alias("p"))
    return rows.select("read_id", "p.contig", "p.pos", "p.rev")


@query("SELECT l_orderkey AS read_id, l_linenumber * 8 + l_partkey % 8 AS flag, ((l_linenumber * 8 + l_partkey % 8) & 8) <> 0 AS mate_unaligned, ((l_linenumber * 8 + l_partkey % 8) & 16) <> 0 AS reversed, ((l_linenumber * 8 + l_partkey % 8) & 32) <> 0 AS mate_reversed FROM lineitem")
def flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") * 8 + F.col("l_partkey") % 8).alias("flag"))
    f = F.col("flag")
    return rows.select("read_id", "flag", sam_fields.flag(f, 8).alias("mate_unaligned"), sam_fields.flag(f, 16).alias("reversed"), sam_fields.flag(f, 32).alias("mate_reversed"))


def own_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VCF rows as the filter scripts see them, from the derived observations."""
    rows = reports.vcf_rows(filters.filtered_positions(position_rows(spark, sf_dir), Thresholds()), True, False)
    return rows.select(F.col("CHROM").alias("CHR"), "POS", "REF", "ALT", F.col("DP").cast("double").alias("DP"), F.col("DETAILS_MIDDLE").alias("MIDDLE"), F.col("DETAILS_ENDS").alias("ENDS"), "ins_idx")


@query(f"""WITH {PILED} SELECT a.contig AS "CHR", a.pos + 1 AS "POS", a.ref AS "REF", a.allele AS "ALT", round(a.n / 100.0, 2) AS "DPsnp", round(p.total / 100.0, 2) AS "DPall"
FROM alleles a JOIN positions p ON a.contig = p.contig AND a.pos = p.pos AND p.ins_idx IS NULL WHERE a.ins_idx IS NULL AND a.allele NOT IN ('-', a.ref) AND a.ref <> 'N' AND a.n >= 100 AND 10 * a.n >= 3 * p.total""")
def point_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternates with a depth of 1 and three tenths of all (0.2999 leaves room for the
    text's 32-bit sums)."""
    out = calls.point_mutations(own_vcf(spark, sf_dir), fraction=0.2999, reads=0.9999)
    return out.select("CHR", "POS", "REF", "ALT", F.round("DPsnp", 2).alias("DPsnp"), F.round("DPall", 2).alias("DPall"))


@query("""WITH r AS (SELECT 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS "CHR", CAST(l_partkey AS INTEGER) AS "POS", l_returnflag = 'R' AS insertion, substr('ACGT', CAST(1 + l_partkey % 4 AS INTEGER), 1) AS ref, substr('ACGT', CAST(1 + l_linenumber % 4 AS INTEGER), 1) AS allele,
    floor(l_quantity) AS n, 50.0 AS total, floor(l_quantity) >= 40 AS strict, l_orderkey * 1000000 + CAST(round(l_extendedprice) AS BIGINT) AS ord FROM lineitem WHERE floor(l_quantity) >= 35 AND l_discount > 0.05),
w AS (SELECT *, CASE WHEN lag("POS") OVER k IS NULL THEN 1 WHEN insertion THEN CAST("POS" <> lag("POS") OVER k AS INTEGER) ELSE CAST("POS" - lag("POS") OVER k > 10 AS INTEGER) END AS nw FROM r WINDOW k AS (PARTITION BY "CHR", insertion ORDER BY "POS", ord, allele, n)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY "CHR", insertion ORDER BY "POS", ord, allele, n ROWS UNBOUNDED PRECEDING) AS run FROM w),
o AS (SELECT *, max(CAST(strict AS INTEGER)) OVER (PARTITION BY "CHR", insertion, run ORDER BY "POS", ord, allele, n ROWS UNBOUNDED PRECEDING) AS op FROM g)
SELECT "CHR", insertion, min("POS") AS "POS", CAST(count(*) AS BIGINT) AS k, round(avg(n), 6) AS depth FROM o WHERE op = 1 GROUP BY "CHR", insertion, run HAVING count(*) >= 2""")
def indel_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter((F.floor("l_quantity") >= 35) & (F.col("l_discount") > 0.05))
    n = F.floor("l_quantity").cast("double")
    order = F.struct((F.col("l_orderkey") * 1000000 + F.round("l_extendedprice").cast("long")).alias("o"), F.substring(F.lit("ACGT"), (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("a"), n.alias("n"))
    rows = li.select(
        F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("CHR"), F.col("l_partkey").cast("int").alias("POS"), (F.col("l_returnflag") == "R").alias("insertion"), F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("REF"),
        F.substring(F.lit("ACGT"), (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("allele"), n.alias("n"), F.lit(50.0).alias("total"), (n >= 40).alias("strict"), order.alias("ord"),
    )
    out = calls.indel_runs(rows, order="ord")
    return out.select("CHR", (F.col("REF") == "-").alias("insertion"), "POS", (F.length(F.regexp_replace("INDEL", "^-", ""))).cast("long").alias("k"), F.round("Depth", 6).alias("depth"))


@query("""SELECT 'k_length_' || CAST(200 + l_suppkey AS VARCHAR) || '_x' AS "CHR", CAST(l_partkey % 320 AS INTEGER) AS "POS", count(*) AS n FROM lineitem WHERE l_partkey % 320 > 10 AND l_partkey % 320 < 190 + l_suppkey GROUP BY 1, 2""")
def contig_end_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("k_length_"), (F.col("l_suppkey") + 200).cast("string"), F.lit("_x")).alias("CHR"), (F.col("l_partkey") % 320).cast("int").alias("POS"))
    return calls.away_from_ends(rows).groupBy("CHR", "POS").agg(F.count("*").alias("n"))


CALLS_SQL = """called AS (SELECT DISTINCT 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS "CHR", CAST(l_partkey AS INTEGER) AS "POS", substr('ACGT', CAST(1 + l_linenumber % 4 AS INTEGER), 1) AS "REF" FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30),
truth AS (SELECT DISTINCT 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS "CHR", CAST(l_partkey AS INTEGER) AS "POS", substr('ACGT', CAST(1 + l_linenumber % 4 AS INTEGER), 1) AS "REF" FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30)"""


def call_set(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 30))
    return li.select(F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("CHR"), F.col("l_partkey").cast("int").alias("POS"), F.substring(F.lit("ACGT"), (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("REF")).distinct()


@query(f"""WITH {CALLS_SQL} SELECT * FROM called c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t."CHR" = c."CHR" AND t."POS" = c."POS")""")
def baseline_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.without_baseline(call_set(spark, sf_dir, "R"), call_set(spark, sf_dir, "A"))


@query(f"WITH {CALLS_SQL} SELECT * FROM called EXCEPT SELECT * FROM truth")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.false_positives(call_set(spark, sf_dir, "R"), call_set(spark, sf_dir, "A"))


@query(f"WITH {CALLS_SQL} SELECT * FROM truth EXCEPT SELECT * FROM called")
def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.false_negatives(call_set(spark, sf_dir, "R"), call_set(spark, sf_dir, "A"))


@query(f"""WITH {CALLS_SQL} SELECT (SELECT count(*) FROM (SELECT * FROM called EXCEPT SELECT * FROM truth)) AS "FP", (SELECT count(*) FROM (SELECT * FROM truth EXCEPT SELECT * FROM called)) AS "FN",
  (SELECT count(*) FROM (SELECT * FROM called INTERSECT SELECT * FROM truth)) AS "TP", (SELECT count(*) FROM truth) AS total""")
def confusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.confusion(call_set(spark, sf_dir, "R"), call_set(spark, sf_dir, "A"))


INDEL_SQL = """calls AS (SELECT o_orderkey AS id, 'c' || CAST(o_custkey % 7 AS VARCHAR) AS "CHR", CAST(o_orderkey % 40000 AS INTEGER) AS "POS", substr('ACGTTGCAAC', CAST(1 + o_custkey % 5 AS INTEGER), CAST(2 + o_orderkey % 4 AS INTEGER)) AS "INDEL" FROM orders),
truths AS (SELECT c_custkey AS t_id, 'c' || CAST(c_custkey % 7 AS VARCHAR) AS t_chr, CAST((c_custkey * 37) % 40000 AS INTEGER) AS t_pos, substr('ACGTTGCAAC', CAST(1 + c_custkey % 5 AS INTEGER), CAST(2 + c_custkey % 4 AS INTEGER)) AS t_indel, CAST(c_custkey % 7 - 3 AS INTEGER) AS t_len FROM customer)"""
SIMILAR_SQL = """(instr(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END, CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END) > 0 OR
  len(list_filter(range(1, least(length({a}), length({b}))), lambda i: instr(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END, substr(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END, i, 2)) > 0)) >= least(length({a}), length({b})) - 2)"""


def indel_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("CHR"), (F.col("o_orderkey") % 40000).cast("int").alias("POS"), F.substring(F.lit("ACGTTGCAAC"), (F.col("o_custkey") % 5 + 1).cast("int"), (F.col("o_orderkey") % 4 + 2).cast("int")).alias("INDEL"))


def indel_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("T_ID"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("T_CHR"), (k * 37 % 40000).cast("int").alias("T_POS"), F.substring(F.lit("ACGTTGCAAC"), (k % 5 + 1).cast("int"), (k % 4 + 2).cast("int")).alias("T_INDEL"), (k % 7 - 3).cast("int").alias("T_LEN"))


@query(f"""WITH {INDEL_SQL}, m AS (SELECT c.*, t.t_id, t.t_id IS NOT NULL AND {SIMILAR_SQL.format(a='c."INDEL"', b='t.t_indel')} AS s FROM calls c LEFT JOIN truths t ON c."CHR" = t.t_chr AND abs(c."POS" - t.t_pos) <= 10)
SELECT id, "CHR", "POS", "INDEL", CASE WHEN bool_or(s) THEN 'TP' WHEN count(t_id) > 0 THEN 'FP_samePOS' ELSE 'FP_diffPOS' END AS label, CAST(count(DISTINCT CASE WHEN s THEN t_id END) AS BIGINT) AS hits FROM m GROUP BY id, "CHR", "POS", "INDEL" """)
def indel_truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.indel_matches(indel_calls(spark, sf_dir), indel_truths(spark, sf_dir)).drop("hit")


@query(f"""WITH {INDEL_SQL}, m AS (SELECT c.*, t.t_id, t.t_id IS NOT NULL AND {SIMILAR_SQL.format(a='c."INDEL"', b='t.t_indel')} AS s FROM calls c LEFT JOIN truths t ON c."CHR" = t.t_chr AND abs(c."POS" - t.t_pos) <= 10),
g AS (SELECT id, CASE WHEN bool_or(s) THEN 'TP' WHEN count(t_id) > 0 THEN 'FP_samePOS' ELSE 'FP_diffPOS' END AS label FROM m GROUP BY id)
SELECT count(*) FILTER (label = 'TP') AS "TP", count(*) FILTER (label = 'FP_samePOS') AS "FP_samePOS", count(*) FILTER (label = 'FP_diffPOS') AS "FP_diffPOS", (SELECT count(*) FROM truths) - (SELECT count(DISTINCT t_id) FROM m WHERE s) AS "FN" FROM g""")
def indel_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.indel_summary(indel_calls(spark, sf_dir), indel_truths(spark, sf_dir))


@query(f"""WITH {INDEL_SQL} SELECT * FROM calls c WHERE NOT EXISTS (SELECT 1 FROM truths t WHERE t.t_chr = c."CHR" AND abs(c."POS" - t.t_pos) <= 10)""")
def blank_indel_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.without_blanks(indel_calls(spark, sf_dir), indel_truths(spark, sf_dir))


@query(f"""WITH {INDEL_SQL} SELECT t_id AS "T_ID", t_chr AS "T_CHR", t_pos AS "T_POS", CAST(coalesce(sum(t_len) OVER (PARTITION BY t_chr ORDER BY t_pos, t_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM truths""")
def coordinate_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.shift_before(indel_truths(spark, sf_dir)).select("T_ID", "T_CHR", "T_POS", "shift")


@query(f"""WITH {INDEL_SQL}, d AS (SELECT DISTINCT "INDEL" AS a FROM calls), e AS (SELECT DISTINCT t_indel AS b FROM truths) SELECT a, b, {SIMILAR_SQL.format(a='a', b='b')} AS similar FROM d, e""")
def kmer2_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct strings of both sides (at most twenty each)."""
    d = indel_calls(spark, sf_dir).select(F.col("INDEL").alias("a")).distinct()
    e = indel_truths(spark, sf_dir).agg(F.collect_set("T_INDEL").alias("_b"))
    p = d.join(F.broadcast(e)).select("a", F.explode("_b").alias("b"))
    return p.withColumn("similar", bases.shared_pairs_similar(F.col("a"), F.col("b")))


@query(f"""WITH {INDEL_SQL} SELECT length("INDEL") AS len, count(*) AS n FROM calls GROUP BY 1""")
def indel_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.length_histogram(indel_calls(spark, sf_dir)).select(F.col("len").cast("long").alias("len"), "n")


@query("""SELECT l_returnflag AS tool, l_linestatus AS kind, quantile_cont(l_extendedprice, 0.05) AS q05, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.95) AS q95, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std_pop, round(stddev_samp(l_extendedprice), 4) AS std_samp, count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2""")
def caller_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("kind"), "l_extendedprice")
    out = analysis.quantiles(li, ["tool", "kind"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std_pop", "std_samp")})


@query("""WITH c AS (SELECT o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1) SELECT class, n, CAST(sum(n) OVER (ORDER BY CASE class WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, class ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM c""")
def class_counts_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.class_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class")), "class", {"3-MEDIUM": 0, "1-URGENT": 1})


@query(f"""WITH {CALLS_SQL}, other AS (SELECT DISTINCT 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS "CHR", CAST(l_partkey AS INTEGER) AS "POS" FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)
SELECT * FROM called c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t."CHR" = c."CHR" AND t."POS" = c."POS") AND NOT EXISTS (SELECT 1 FROM other t WHERE t."CHR" = c."CHR" AND t."POS" = c."POS")""")
def novel_between_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N' and l_quantity > 45").select(F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("CHR"), F.col("l_partkey").cast("int").alias("POS"))
    return analysis.novel(call_set(spark, sf_dir, "R"), call_set(spark, sf_dir, "A"), li, keys=["CHR", "POS"])


@query("SELECT l_returnflag AS tool, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem GROUP BY 1")
def runtime_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.slope(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "tool"), ["tool"], "l_extendedprice", "l_quantity")
    return out.select("tool", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


TOOLS_SQL = "t AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS a, o_totalprice > 100000 AS b, o_custkey % 2 = 0 AS c FROM orders)"


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 100000).alias("b"), (F.col("o_custkey") % 2 == 0).alias("c"))


@query(f"""WITH {TOOLS_SQL}, u AS (UNPIVOT t ON a, b, c INTO NAME "Tool" VALUE v) SELECT id, "Tool", CASE WHEN v THEN 'Called' ELSE 'Missed' END AS "Value" FROM u""")
def outcome_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.outcomes_long(tools(spark, sf_dir), "id", ["a", "b", "c"], "Called", "Missed")


@query(f"WITH {TOOLS_SQL} SELECT a, b, c, count(*) AS n FROM t GROUP BY a, b, c")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.outcome_counts(tools(spark, sf_dir), ["a", "b", "c"])


@query("SELECT l_linestatus AS outcome, CAST(floor(abs(l_partkey - l_suppkey) / 20.0) * 20 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("outcome"), F.abs(F.col("l_partkey") - F.col("l_suppkey")).alias("d"))
    return analysis.histogram(li, "d", 20, ["outcome"]).select("outcome", F.col("bin").cast("long").alias("bin"), "n")


@query("SELECT l_linestatus AS sample, round(sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) FILTER (l_returnflag = 'A'), 9) AS ratio FROM lineitem GROUP BY 1")
def fp_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "sample")
    return analysis.class_ratio(li, "l_returnflag", "l_quantity", "R", "A", ["sample"]).withColumn("ratio", F.round("ratio", 9))


@query("""WITH v AS (SELECT l_quantity AS x, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (NOT l_returnflag = 'R') AS b FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
s AS (SELECT sum(a) OVER w AS a, sum(b) OVER w AS b FROM v WINDOW w AS (ORDER BY x)), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM v)
SELECT round(max(abs(a / ta - b / tb)), 9) AS distance, CAST(max(ta) AS BIGINT) AS n_a, CAST(max(tb) AS BIGINT) AS n_b FROM s, t""")
def ks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_returnflag") == "R")
    return analysis.ks_distance(li, "l_quantity", "r").withColumn("distance", F.round("distance", 9))


@query("""SELECT l_orderkey AS read_id, CASE WHEN l_suppkey % 2 = l_partkey % 2 THEN CASE WHEN l_partkey % 90 >= l_suppkey % 90 + 5 THEN l_partkey % 90 - (l_suppkey % 90 + 5) ELSE abs(l_partkey % 90 - l_suppkey % 90) END
  ELSE least(l_suppkey % 90, abs(100 - l_suppkey % 90 - 5)) + least(l_partkey % 90, abs(100 - l_partkey % 90 - 5)) END AS distance FROM lineitem""")
def read_pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("k"), (F.col(c) % 2).cast("string"), F.lit("_size100"))
    li = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_suppkey") % 90, F.col("l_partkey") % 90
    return li.select(F.col("l_orderkey").alias("read_id"), sam_fields.pair_distance(name("l_suppkey"), a, F.lit(5), name("l_partkey"), b, F.lit(5)).alias("distance"))


@query("SELECT l_linenumber AS k, CAST(l_partkey % 500 AS INTEGER) AS w, " + NUM.format("(l_partkey % 500)") + " AS text, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 500).cast("int").alias("w"))
    return rows.withColumn("text", number_text(depth(F.col("w")))).groupBy("k", "w", "text").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_partkey - 480 AS INTEGER) AS \"POS\", count(*) AS n FROM lineitem WHERE l_partkey BETWEEN 480 AND 520 GROUP BY 1")
def window_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis.rebased(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("POS")), 500)
    return rows.groupBy("POS").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS ord, o_custkey % 5 AS c, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * (o_orderkey % 1000 + 1) AS p FROM orders)
SELECT ord, coalesce(lead(p) OVER (PARTITION BY c ORDER BY ord) < 0, FALSE) AS before_insertion FROM r""")
def next_is_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(o.alias("ord"), (F.col("o_custkey") % 5).alias("CHR"), (F.when(o % 3 == 0, -1).otherwise(1) * (o % 1000 + 1)).alias("POS"))
    return rows.select("ord", calls.before_insertion(rows).alias("before_insertion"))


@query("""WITH s AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS e FROM lineitem GROUP BY 1 HAVING min(l_linenumber) < max(l_linenumber)),
d AS (SELECT a * 100000 + l_orderkey AS t, 1 AS d FROM s UNION ALL SELECT e * 100000 + l_orderkey, -1 FROM s), r AS (SELECT sum(d) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS r FROM d) SELECT CAST(max(r) AS BIGINT) AS peak FROM r""")
def peak_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most reads waiting for their last line at one time."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("e")).filter("a < e")
    rows = li.select(F.lit(0).alias("input_index"), F.lit(0).alias("part"), (F.col("a") * 100000 + F.col("l_orderkey")).alias("aln"), (F.col("e") * 100000 + F.col("l_orderkey")).alias("emitted"))
    return grouping.peak_pending(rows).select(F.col("peak").cast("long").alias("peak"))
