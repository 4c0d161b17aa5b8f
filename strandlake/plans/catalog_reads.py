"""The query catalogue, second part: from SAM and FASTA text to reports.

Lines of ``lineitem`` are written as SAM text and read back by the library: an order is a
read, each of its lines a placement; or the first lines of an order are a pair of mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sam_fields
from ..functions.numbers import hundredths
from ..operators import analysis, calls, compare, grouping, observations, pileup, reports
from ..sources import files
from ..sources.local import cut
from .catalog import PILED, own_vcf, position_rows, query, sequences, table

CONTIG = "ACGGT" * 480
PATTERN = "ACGTNACGTRACG" * 8


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contigs of 2,400 bases, parsed from FASTA records of two lines."""
    n = F.col("r_regionkey")
    text = F.concat(F.lit("c"), n.cast("string"), F.lit(" a region\n"), F.lit(CONTIG[:1000]), F.lit("\n"), F.lit(CONTIG[1000:]), F.lit("\n"))
    raw = table(spark, sf_dir, "region").filter(n < 3).select(text.alias("value"), n.cast("long").alias("ordinal"), F.concat(F.lit("refs/"), (n % 2).cast("string"), F.lit(".fa")).alias("path"))
    return files.parse_fasta(raw)


def sam_line(*fields: Column) -> Column:
    return F.concat_ws("\t", *(f.cast("string") for f in fields))


def placement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header, and a SAM line for each line item; some lack a contig, CIGAR or sequence."""
    q = F.floor("l_quantity").cast("int")
    text = q.cast("string")
    long = q > 4
    cigar = F.when(long & (F.col("l_returnflag") == "R"), F.concat(F.lit("2M1I"), (q - 3).cast("string"), F.lit("M"))).when(long & (F.col("l_returnflag") == "A"), F.concat(F.lit("2M1D"), (q - 2).cast("string"), F.lit("M"))).otherwise(F.concat(text, F.lit("M")))
    contig = F.when(F.col("l_partkey") % 50 == 7, "*").otherwise(F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")))
    value = sam_line(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")), F.when(F.col("l_linestatus") == "F", 16).otherwise(0), contig, F.col("l_partkey") % 2000 + 1, F.lit(60),
        F.when(F.col("l_partkey") % 50 == 8, "*").otherwise(cigar), F.lit("*"), F.lit(0), F.lit(0), F.when(F.col("l_partkey") % 50 == 9, "*").otherwise(F.substring(F.lit(PATTERN), F.col("l_linenumber"), q)), F.lit("*"),
    )
    place = F.struct(F.col("l_orderkey").alias("block"), (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.round("l_extendedprice")).cast("long").alias("row"))
    lines = table(spark, sf_dir, "lineitem").select(value.alias("value"), F.lit(0).alias("input_index"), place.alias("line_ord"))
    first = F.struct(F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    return lines.unionByName(spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value"), F.lit(0).alias("input_index"), first.alias("line_ord")))


PLACEMENTS = f"""lines AS (
  SELECT l_orderkey AS k, CAST(floor(l_quantity) AS INTEGER) AS q, l_linestatus = 'F' AS rev, 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS contig, CAST(l_partkey % 2000 AS INTEGER) AS p, l_partkey % 50 AS odd,
    substr('{PATTERN}', l_linenumber, CAST(floor(l_quantity) AS INTEGER)) AS seq, CASE WHEN l_quantity >= 5 THEN l_returnflag ELSE 'N' END AS kind FROM lineitem
), placed AS (SELECT *, count(*) OVER (PARTITION BY k) AS size FROM lines WHERE odd NOT IN (7, 8, 9))"""


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.kept(files.parse_sam(placement_lines(spark, sf_dir)))


def grouped_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(grouping.query_groups(cut(grouping.alignments(cut(placements(spark, sf_dir), "components")), "aligned")), "grouped")


@query(f"""WITH {PLACEMENTS} SELECT 'r' || k AS qname, contig, p + 1 AS pos, rev, CASE WHEN kind = 'R' THEN '2M1I' || (q - 3) || 'M' WHEN kind = 'A' THEN '2M1D' || (q - 2) || 'M' ELSE q || 'M' END AS cigar, seq, length(seq) AS seq_len FROM placed""")
def sam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(spark, sf_dir).select("qname", "contig", "pos", "rev", "cigar", "seq", "seq_len")


@query(f"WITH {PLACEMENTS} SELECT count(*) AS lines, count(*) FILTER (odd = 7) AS unaligned, count(*) FILTER (odd = 8) AS without_cigar, count(*) FILTER (odd = 9) AS without_sequence FROM lines")
def sam_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dropped_counts(files.parse_sam(placement_lines(spark, sf_dir))).drop("bad_tags")


@query(f"WITH {PLACEMENTS} SELECT '>r' || k || chr(10) || seq AS fasta, '@r' || k || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq)) AS fastq FROM lines WHERE odd = 7")
def unaligned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads without a contig, as records of both kinds beside one another."""
    parsed = files.parse_sam(placement_lines(spark, sf_dir)).withColumn("quality", F.lit("*"))
    fasta = reports.unaligned_records(parsed).select(F.col("value").alias("fasta"))
    fastq = reports.unaligned_records(parsed, "quality").select(F.col("value").alias("fastq"))
    same = F.col("fasta") == F.concat(F.lit(">"), F.substring_index(F.expr("substr(fastq, 2)"), "\n", 2))
    return fasta.withColumn("_k", F.row_number().over(Window.partitionBy("fasta").orderBy("fasta"))).join(fastq.withColumn("_l", F.row_number().over(Window.partitionBy("fastq").orderBy("fastq"))), same & (F.col("_k") == F.col("_l"))).select("fasta", "fastq")


@query(f"WITH {PLACEMENTS} SELECT 'r' || k AS read, size AS placements, CAST(trunc(CAST(1.0 / size AS FLOAT) * CAST(100 AS FLOAT)) AS INTEGER) AS w100 FROM placed GROUP BY k, size")
def multimap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped_placements(spark, sf_dir)
    return g.select(F.col("qname").alias("read"), F.col("group_size").cast("long").alias("placements"), hundredths(F.col("weight")).alias("w100")).distinct()


OBSERVED = f"""{PLACEMENTS}, parts AS (
  SELECT *, unnest(CASE WHEN kind = 'R' THEN [[0, 0, 2, 2], [2, 2, 1, 0], [3, 2, q - 3, q - 3]] WHEN kind = 'A' THEN [[0, 0, 2, 2], [2, 2, 0, 1], [2, 3, q - 2, q - 2]] ELSE [[0, 0, q, q]] END) AS b FROM placed
), cells AS (SELECT *, unnest(range(0, greatest(b[3], b[4]))) AS i FROM parts), seen AS (
  SELECT contig, CAST(CASE WHEN b[4] = 0 THEN p + b[2] - 1 ELSE p + b[2] + i END AS INTEGER) AS pos, CASE WHEN b[4] = 0 THEN CAST(i AS INTEGER) END AS ins_idx, CASE WHEN b[3] = 0 THEN '-' ELSE substr(seq, CAST(b[1] + i + 1 AS INTEGER), 1) END AS base,
    NOT rev AS fwd, least(b[1] + i, q - b[1] - i - 1) < q * CAST(0.1 AS DOUBLE) AS near_end, CAST(trunc(CAST(CAST(1.0 / size AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT)) AS BIGINT) AS w FROM cells
), observed AS (
  SELECT contig, pos, ins_idx, CASE WHEN ins_idx IS NOT NULL THEN '-' ELSE substr('{CONTIG}', pos + 1, 1) END AS ref, CASE WHEN ins_idx IS NOT NULL AND base NOT IN ('A', 'C', 'G', 'T') THEN 'N' ELSE base END AS allele, fwd, near_end, w
  FROM seen WHERE ins_idx IS NOT NULL OR base IN ('A', 'C', 'G', 'T', '-')
)"""


def placed_observations(spark: SparkSession, sf_dir: str, large: bool = False) -> DataFrame:
    blocked = observations.with_blocks(grouped_placements(spark, sf_dir))
    return observations.base_observations(blocked, reference(spark, sf_dir), 0.1, large)


@query(f"WITH {OBSERVED} SELECT contig, pos, ins_idx, ref, allele, fwd, near_end, count(*) AS n, CAST(sum(w) AS BIGINT) AS w100 FROM observed GROUP BY ALL")
def base_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every base of every placement beside the reference's, the contig broadcast."""
    rows = placed_observations(spark, sf_dir)
    return rows.groupBy("contig", "pos", "ins_idx", "ref", "allele", "fwd", "near_end").agg(F.count("*").alias("n"), F.sum("w100").cast("long").alias("w100"))


@query(f"WITH {OBSERVED} SELECT contig, ref, allele, count(*) AS n FROM observed GROUP BY ALL")
def observations_by_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the reference joined by pieces, as a large one is."""
    return placed_observations(spark, sf_dir, large=True).groupBy("contig", "ref", "allele").agg(F.count("*").alias("n"))


@query(f"WITH {OBSERVED} SELECT contig, pos, ins_idx, allele, CAST(sum(w) AS BIGINT) AS w100 FROM observed WHERE ins_idx IS NOT NULL GROUP BY ALL")
def inserted_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions with ambiguous bases counted as N."""
    return placed_observations(spark, sf_dir).filter("ins_idx is not null").groupBy("contig", "pos", "ins_idx", "allele").agg(F.sum("w100").cast("long").alias("w100"))


@query(f"WITH {OBSERVED}, c AS (SELECT contig, count(DISTINCT pos) AS covered FROM observed WHERE ins_idx IS NULL AND w > 0 GROUP BY contig) SELECT 'c' || r_regionkey AS contig, 2400 AS length, coalesce(covered, 0) AS covered, round(100.0 * coalesce(covered, 0) / 2400, 6) AS percent FROM region LEFT JOIN c ON contig = 'c' || r_regionkey WHERE r_regionkey < 3")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = pileup.positions(pileup.pileup(placed_observations(spark, sf_dir), False), False)
    return reports.coverage_by_contig(positions, reference(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {PLACEMENTS} SELECT 'r' || k AS "QNAME", CASE WHEN rev THEN 16 ELSE 0 END AS "FLAG", contig AS "RNAME", p + 1 AS "POS", CASE WHEN kind = 'R' THEN '2M1I' || (q - 3) || 'M' WHEN kind = 'A' THEN '2M1D' || (q - 2) || 'M' ELSE q || 'M' END AS "CIGAR",
  '*' AS "RNEXT", 0 AS "PNEXT", length(seq) AS "TLEN", seq AS "SEQ" FROM placed""")
def sam_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.sam_rows(observations.with_blocks(grouped_placements(spark, sf_dir)))
    return rows.select("QNAME", "FLAG", "RNAME", "POS", "CIGAR", "RNEXT", "PNEXT", "TLEN", "SEQ")


@query(f"""WITH {PLACEMENTS}, s AS (SELECT k, list_sort(list(DISTINCT CASE WHEN contig = 'c1' THEN '1.fa' ELSE '0.fa' END)) AS paths FROM placed GROUP BY k)
SELECT list_aggregate(paths, 'string_agg', '-') || '-' AS "Genome_set", count(*) AS "No_reads" FROM s GROUP BY 1""")
def reads_by_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.refs_map_count(grouped_placements(spark, sf_dir), reference(spark, sf_dir))


@query("""WITH e AS (SELECT user_id % 2 AS q, event_type, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS p FROM events),
g AS (SELECT *, p - row_number() OVER (PARTITION BY q, event_type ORDER BY p) AS g FROM e) SELECT CAST(q AS INTEGER) AS q, event_type, g AS group_no, count(*) AS group_size, min(p) AS first_place FROM g GROUP BY q, event_type, g""")
def query_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent rows with the same name as islands: events stand for lines, types for names."""
    ev = table(spark, sf_dir, "events")
    place = F.struct(F.floor(F.col("event_id") / 1000).alias("block"), F.col("event_id").alias("row"))
    lines = ev.select((F.col("user_id") % 2).cast("int").alias("input_index"), place.alias("line_ord"), F.col("event_type").alias("qname"), F.lit("c").alias("contig"), F.lit(1).alias("pos"), F.lit(False).alias("rev"), F.array().cast(f"array<{sam_fields.PLACE}>").alias("expect"))
    g = grouping.query_groups(grouping.alignments(lines))
    return g.groupBy(F.col("input_index").alias("q"), F.col("qname").alias("event_type"), "group_no").agg(F.max("group_size").alias("group_size"), F.min("place").alias("first_place"))


def mate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SAM line for each of an order's lines 1 and 2 on one contig; each names the other, or
    where there is none a place that no line has."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct((F.col("l_partkey") % 200 + 1).alias("p"), F.floor("l_quantity").cast("int").alias("q"))).alias("x"))
    both = li.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("x"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("x"))).alias("b"))
    ends = F.array(F.struct(F.lit(1).alias("n"), F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.lit(2).alias("n"), F.col("b").alias("own"), F.col("a").alias("other")))
    rows = both.select("l_orderkey", F.explode(F.filter(ends, lambda e: e["own"].isNotNull())).alias("e"))
    rev = F.col("e.n") == 2  # second mates are reversed
    flags = F.when(rev, 16).otherwise(32)
    value = sam_line(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")), flags, F.lit("c0"), F.col("e.own.p"), F.lit(60), F.concat(F.col("e.own.q").cast("string"), F.lit("M")), F.lit("="), F.coalesce(F.col("e.other.p"), F.lit(5000)), F.lit(0), F.substring(F.lit("A" * 60), F.lit(1), F.col("e.own.q")), F.lit("*"),
    )
    return rows.select(value.alias("value"), F.lit(0).alias("input_index"), F.struct(F.col("l_orderkey").alias("block"), F.col("e.n").cast("long").alias("row")).alias("line_ord"))


MATES = """mates AS (
  SELECT l_orderkey AS k, l_linenumber AS n, min({'p': l_partkey % 200, 'q': CAST(floor(l_quantity) AS INTEGER)}) AS x FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2
), ends AS (SELECT k, n, CAST(x.p AS BIGINT) AS lo, CAST(x.p + x.q AS BIGINT) AS hi, CAST(x.q AS BIGINT) AS q FROM mates), pairs AS (
  SELECT k, count(*) AS parts, sum(q) AS bases, greatest(0, min(hi) - max(lo)) AS lap, min(lo) AS lo, max(lo) AS lo2, min({'lo': lo, 'hi': hi}).hi AS first_hi FROM ends GROUP BY k
)"""


def aligned_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(grouping.alignments(cut(files.kept(files.parse_sam(mate_lines(spark, sf_dir))), "components")), "aligned")


@query(f"WITH {MATES} SELECT 'r' || k AS read, parts, parts < 2 AS incomplete FROM pairs")
def mate_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part of a read finds the place it expects among the other parts."""
    a = aligned_mates(spark, sf_dir).groupBy("input_index", "aln").agg(F.first("qname").alias("read"), F.count("*").alias("parts"), F.max("incomplete").alias("incomplete"))
    return a.select("read", "parts", "incomplete")


@query(f"WITH {MATES} SELECT greatest(0, count(*) FILTER (parts < 2) - CAST(max(k) = max(CASE WHEN parts < 2 THEN k END) AS BIGINT)) AS errors FROM pairs")
def incomplete_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments that end without a part, but for the file's last."""
    return grouping.incomplete_groups(aligned_mates(spark, sf_dir)).select(F.col("errors").cast("long").alias("errors"))


@query(f"WITH {MATES} SELECT 'r' || k AS read, CAST(bases AS BIGINT) AS bases, CAST(CASE WHEN parts < 2 THEN bases * 100 ELSE (bases - lap) * 100 END AS BIGINT) AS w100 FROM pairs")
def pair_overlap_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of reads whose parts overlap: positions under both parts count once."""
    blocked = observations.with_blocks(grouping.query_groups(aligned_mates(spark, sf_dir)))
    rows = observations.base_observations(blocked, reference(spark, sf_dir), 0.1, False)
    return rows.groupBy(F.col("ex_name").alias("read")).agg(F.count("*").alias("bases"), F.sum("w100").cast("long").alias("w100"))


@query(f"""WITH {MATES}, d AS (SELECT CAST(lo2 - first_hi AS DOUBLE) AS x FROM pairs WHERE parts = 2)
SELECT (SELECT count(*) FROM pairs) AS queries, (SELECT count(*) FROM pairs) AS alignments, (SELECT CAST(sum(bases) AS BIGINT) FROM pairs) AS aligned_bases, (SELECT round(avg(x), 6) FROM d) AS mean, (SELECT round(stddev_pop(x), 6) FROM d) AS stddev,
  (SELECT count(DISTINCT p) FROM (SELECT unnest(range(lo, hi)) AS p FROM ends)) AS covered, 7200 AS bases""")
def alignment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked, ref = observations.with_blocks(grouping.query_groups(aligned_mates(spark, sf_dir))), reference(spark, sf_dir)
    positions = pileup.positions(pileup.pileup(observations.base_observations(blocked, ref, 0.1, False), False), False)
    out = reports.run_statistics(blocked, positions, ref)
    return out.select("queries", "alignments", F.col("aligned_bases").cast("long").alias("aligned_bases"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "covered", F.col("bases").cast("int").alias("bases"))


@query("""WITH s AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EFIJLOPQUXZ', 'ACGTACGTACG') AS seq FROM documents WHERE text IS NOT NULL)
SELECT 'd' || doc_id AS name, CAST(length(seq) AS INTEGER) AS length, md5(seq) AS digest FROM s""")
def fasta_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three lines: a name with a remark, and the sequence on two lines."""
    half = F.floor(F.length("seq") / 2).cast("int")
    text = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" a document\r\n"), F.substring("seq", F.lit(1), half), F.lit("\r\n"), F.substring("seq", half + 1, F.length("seq")), F.lit("\r\n"))
    raw = sequences(spark, sf_dir).select(text.alias("value"), F.col("doc_id").alias("ordinal"), F.lit("d.fa").alias("path"))
    return files.parse_fasta(raw).select("name", "length", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"""WITH {PILED}, ins AS (SELECT contig, pos, ins_idx, row_number() OVER (PARTITION BY contig, pos ORDER BY ins_idx) - 1 AS k FROM positions WHERE ins_idx IS NOT NULL), good AS (
  SELECT a.contig, a.pos, a.ins_idx, a.ref, a.allele, a.fm + a.rm AS n, p.middle AS t, row_number() OVER (PARTITION BY a.contig, a.pos, a.ins_idx ORDER BY a.rank) AS r
  FROM alleles a JOIN positions p ON a.contig = p.contig AND a.pos = p.pos AND a.ins_idx IS NOT DISTINCT FROM p.ins_idx LEFT JOIN ins i ON a.contig = i.contig AND a.pos = i.pos AND a.ins_idx = i.ins_idx
  WHERE a.allele <> a.ref AND a.n > 0 AND (a.ins_idx IS NULL OR i.k = a.ins_idx) AND (a.allele = '-') = (a.ins_idx IS NULL) AND a.fm + a.rm >= 49.99 AND p.middle >= 49.99 AND a.fm + a.rm >= 0.3999 * p.middle
) SELECT contig AS "CHR", pos + 1 AS "POS", ins_idx IS NOT NULL AS insertion, ref AS "REF", allele, round(n / 100.0, 2) AS n, round(t / 100.0, 2) AS total, n >= 0.4999 * t AS strict FROM good WHERE r = 1""")
def indel_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls.indel_rows(own_vcf(spark, sf_dir), fraction=0.4999, reads=0.4999)
    return rows.select("CHR", "POS", "insertion", "REF", "allele", F.round("n", 2).alias("n"), F.round("total", 2).alias("total"), "strict")


@query("""WITH t AS (SELECT 'c' || CAST(c_custkey % 7 AS VARCHAR) AS c, list({'p': (c_custkey * 37) % 40000, 'n': c_custkey % 7 - 3} ORDER BY (c_custkey * 37) % 40000, c_custkey % 7 - 3) AS ts FROM customer WHERE c_custkey % 30 = 0 GROUP BY 1),
o AS (SELECT o_orderkey AS id, 'c' || CAST(o_custkey % 8 AS VARCHAR) AS c, o_orderkey % 40000 AS p FROM orders)
SELECT id, o.c AS "CHR", CAST(p AS INTEGER) AS "POS", CAST(CASE WHEN ts IS NULL THEN p ELSE list_reduce(list_prepend({'p': p, 'n': CAST(0 AS BIGINT)}, ts), lambda a, x: {'p': CASE WHEN x.p < a.p THEN a.p - x.n ELSE a.p END, 'n': CAST(0 AS BIGINT)}).p END AS INTEGER) AS "LIFTED" FROM o LEFT JOIN t ON o.c = t.c""")
def coordinate_lift_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact rule: each indel before the place moves what counts as before."""
    k = F.col("c_custkey")
    truth = table(spark, sf_dir, "customer").filter(k % 30 == 0).select(F.concat(F.lit("c"), (k % 7).cast("string")).alias("T_CHR"), (k * 37 % 40000).cast("int").alias("T_POS"), (k % 7 - 3).cast("int").alias("T_LEN"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 8).cast("string")).alias("CHR"), (F.col("o_orderkey") % 40000).cast("int").alias("POS"))
    return compare.lifted(o, truth)


@query("""SELECT 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS "CHR", CAST(l_partkey AS INTEGER) AS "POS", substr('ACGTN', CAST(1 + l_linenumber % 5 AS INTEGER), 1) AS "REF", l_quantity AS "QUAL", count(*) AS n FROM lineitem WHERE l_quantity >= 40 AND l_linenumber % 5 <> 4 GROUP BY ALL""")
def foreign_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("CHR"), F.col("l_partkey").cast("int").alias("POS"), F.substring(F.lit("ACGTN"), F.col("l_linenumber") % 5 + 1, F.lit(1)).alias("REF"), F.col("l_quantity").alias("QUAL"))
    return calls.callable_foreign(li).groupBy("CHR", "POS", "REF", "QUAL").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, '0/1:' || (o_orderkey % 7) || '__' || (o_custkey % 90) || ',' || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_orderkey % 40 AS VARCHAR) END AS s FROM orders)
SELECT 'c' || CAST(o_custkey % 5 AS VARCHAR) AS "CHR", CAST(o_orderkey AS INTEGER) AS "POS", CAST(o_custkey % 90 AS DOUBLE) AS ref_depth, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS alt_depth FROM o""")
def foreign_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another caller: the depths follow the last double underscore."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    sample = F.concat(F.lit("0/1:"), (o % 7).cast("string"), F.lit("__"), (c % 90).cast("string"), F.lit(","), F.when(o % 11 == 0, "x").otherwise((o % 40).cast("string")))
    value = F.concat_ws("\t", F.concat(F.lit("c"), (c % 5).cast("string")), o.cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("50"), F.lit("PASS"), F.lit("DP=1"), F.lit("GT"), sample)
    rows = files.parse_foreign_vcf(table(spark, sf_dir, "orders").select(value.alias("value")))
    return rows.select("CHR", "POS", F.get("depths", F.lit(0)).alias("ref_depth"), F.get("depths", F.lit(1)).alias("alt_depth"))


@query("""SELECT * FROM (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS s FROM orders) o WHERE p IN ('1-URGENT', '5-LOW') AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.id AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.id AND l_tax = 0.08)""")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    rows = analysis.among(rows, "p", ["1-URGENT", "5-LOW"])
    key = F.col("l_orderkey").alias("id")
    return analysis.novel(analysis.members(rows, li.filter("l_quantity > 45").select(key), ["id"]), li.filter("l_tax = 0.08").select(key), keys=["id"])


@query("""WITH s AS (SELECT l_orderkey AS id, sum(l_quantity) AS total FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, o_orderstatus AS status, total FROM orders LEFT JOIN s ON o_orderkey = id""")
def merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("total"))
    return analysis.merged(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), s, ["id"])


@query("""SELECT 'SRR' || o_custkey || '.fasta.' || (o_orderkey % 50) || '.SNP.fasta.' || CASE o_orderstatus WHEN 'F' THEN 'bwa' WHEN 'O' THEN 'minimap' ELSE 'bowtie' END || CASE o_orderkey % 3 WHEN 0 THEN '.mappersamtovcf.vcf' WHEN 1 THEN '.indel.flt.snp.vcf' ELSE '.flt.snp.vcf' END AS sample, 'SRR' || o_custkey AS genome,
  CAST(o_orderkey % 50 AS INTEGER) AS planted, CASE o_orderstatus WHEN 'F' THEN 'bwa' WHEN 'O' THEN 'minimap2' ELSE 'bowtie2' END AS mapper, CASE o_orderkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'bcftools indel' ELSE 'bcftools Mul-ALT' END AS caller, count(*) AS n FROM orders GROUP BY ALL""")
def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, mapper and caller as the names of result files tell them."""
    mapper = F.when(F.col("o_orderstatus") == "F", "bwa").when(F.col("o_orderstatus") == "O", "minimap").otherwise("bowtie")
    o = F.col("o_orderkey")
    tail = F.when(o % 3 == 0, ".mappersamtovcf.vcf").when(o % 3 == 1, ".indel.flt.snp.vcf").otherwise(".flt.snp.vcf")
    name = F.concat(F.lit("SRR"), F.col("o_custkey").cast("string"), F.lit(".fasta."), (o % 50).cast("string"), F.lit(".SNP.fasta."), mapper, tail)
    rows = analysis.labelled(table(spark, sf_dir, "orders").select(name.alias("sample")))
    return rows.groupBy("sample", "genome", "planted", "mapper", "caller").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EFIJLOPQUXZ', 'ACGTACGTACG') AS seq FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, substr(seq, 1, 30) AS a, substr(seq, 2, 30) AS b FROM s WHERE length(seq) > 30)
SELECT doc_id, array_to_string(list_transform(range(1, 31), lambda i: CASE WHEN substr(a, i, 1) = substr(b, i, 1) THEN ' ' WHEN ((instr('-ACMGRSVTWYHKDBN', substr(a, i, 1)) - 1) & (instr('-ACMGRSVTWYHKDBN', substr(b, i, 1)) - 1)) <> 0 THEN '~' ELSE '!' END), '') AS marks FROM p""")
def alignment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir).filter(F.length("seq") > 30)
    return s.select("doc_id", reports.alignment_picture(F.substring("seq", 1, 30), F.substring("seq", 2, 30)).alias("marks"))


@query("""SELECT l_orderkey AS read_id, CAST(l_linenumber + 3 - (l_partkey % 5 + 1) AS INTEGER) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def first_base_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.concat(F.repeat(F.lit("-"), (F.col("l_partkey") % 5).cast("int")), F.lit("ACGTACGT")).alias("gapped"), F.concat(F.repeat(F.lit("A"), F.col("l_linenumber") + 2), F.lit("--CC")).alias("reference")
    )
    return li.select("read_id", analysis.insertion_offset("gapped", "reference").alias("k")).groupBy("read_id", "k").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT l_linestatus AS g, CAST(l_linenumber AS DOUBLE) / 20 AS d, 30 + l_partkey % 40 AS a, 20 + l_suppkey % 30 AS b FROM lineitem), x AS (SELECT g, d, a, b, d * sqrt(CAST(a * b AS DOUBLE) / (a + b)) AS z FROM d)
SELECT g, d, a, b, count(*) AS n, round(greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * z * z))))), 8) AS p FROM x GROUP BY g, d, a, b, z""")
def ks_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), (F.col("l_linenumber").cast("double") / 20).alias("d"), (F.col("l_partkey") % 40 + 30).alias("a"), (F.col("l_suppkey") % 30 + 20).alias("b"))
    rows = li.groupBy("g", "d", "a", "b").agg(F.count("*").alias("n"))
    return rows.withColumn("p", F.round(analysis.ks_probability(F.col("d"), F.col("a"), F.col("b")), 8))


@query(f"""WITH {PILED}, t AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY pos, ins_idx NULLS FIRST) AS place FROM positions) SELECT contig, pos, ins_idx, CAST(place AS INTEGER) AS place FROM t""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of report rows within their contig: insertions after their anchor."""
    return reports.ordered(position_rows(spark, sf_dir)).select("contig", "pos", "ins_idx", "place")


@query("""WITH r AS (SELECT 'SRR' || r_regionkey || CASE r_regionkey WHEN 0 THEN '_covid' WHEN 1 THEN '_human' WHEN 2 THEN '_MGSW' WHEN 3 THEN '_MG' ELSE '' END AS path FROM region)
SELECT path, (CASE WHEN path LIKE '%covid%' OR path LIKE '%human%' THEN 0.5 WHEN path LIKE '%MGSW%' THEN 0.2 WHEN path LIKE '%MG%' THEN 0.05 ELSE 0.9 END)::DOUBLE AS fraction, CASE WHEN path LIKE '%covid%' THEN 3 WHEN path LIKE '%human%' THEN 5 WHEN path LIKE '%MGSW%' THEN 20 WHEN path LIKE '%MG%' THEN 1 ELSE 3 END AS reads FROM r""")
def dataset_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(*(F.lit(x) for x in ("_covid", "_human", "_MGSW", "_MG"))), F.col("r_regionkey").cast("int"))
    rows = table(spark, sf_dir, "region").select(F.concat(F.lit("SRR"), F.col("r_regionkey").cast("string"), F.coalesce(tail, F.lit(""))).alias("path"))
    fraction, reads = calls.dataset_thresholds(F.col("path"))
    return rows.select("path", fraction.alias("fraction"), reads.alias("reads"))
