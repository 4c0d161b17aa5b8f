"""Operators that the reports do not reach, and properties against brute force."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.functions import bases, cigar, sam_fields
from strandlake.operators import analysis, calls, compare, filters, grouping, simulate
from strandlake.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bases(spark):
    assert one(spark, bases.reverse_complement(F.lit("ACGTMRN"))) == "NYKACGT"
    assert one(spark, bases.false_negative_rate(F.lit("N"))) == 1.0
    assert one(spark, bases.union(F.lit("A"), F.lit("C"))) == "M"
    with pytest.raises(Exception, match="nucleotide"):
        one(spark, bases.checked(F.lit("ACZ")))


def test_cigar(spark):
    b = [tuple(x) for x in one(spark, cigar.blocks(F.lit("5S2I10M1D3M"), F.lit(4), F.lit(20)))]
    assert b == [(5, 3, 2, 0), (7, 3, 10, 10), (17, 13, 0, 1), (17, 14, 3, 3)]
    assert [tuple(x) for x in one(spark, cigar.blocks(F.lit("="), F.lit(1), F.lit(7)))] == [(0, 0, 7, 7)]


def test_supplementary_tags(spark):
    tags = F.array(F.lit("SA:Z:a,1,+,4M,60,0;b,2,-,4M,60,0;"), F.lit("SA:Z:a,1,+"), F.lit("NM:i:0"))
    assert [tuple(x) for x in one(spark, sam_fields.supplementary(tags))] == [("a", 1, False), ("b", 2, True)]
    assert one(spark, sam_fields.bad_supplementary(tags)) == 1


@pytest.mark.parametrize("ordered", [True, False])
def test_replay_finds_groups(ordered):
    p = lambda pos, rev=False: ("ref", pos, rev)
    pair = [(0, p(0), [p(0, True)]), (1, p(0, True), [p(0)])]
    assert [x[3] for x in grouping.replay(pair, ordered)] == [False, False]
    three = [(i, p(x), [p(y) for y in (0, 50, 100) if y != x]) for i, x in enumerate((0, 50, 100))]
    found = grouping.replay(three, ordered)
    assert {x[1] for x in found} == {0} and [x[2] for x in found] == [0, 1, 2] and not any(x[3] for x in found)
    assert all(x[3] for x in grouping.replay(three[:2], ordered))
    four = [(0, p(0), [p(100, True), p(150)]), (1, p(100, True), [p(0), p(150, True)]), (2, p(150, True), [p(100, True), p(0)]), (3, p(150), [p(0), p(100, True)])]
    assert len({x[1] for x in grouping.replay(four, ordered)}) == 1 and not grouping.replay(four, ordered)[0][3]


def test_fastq_gzip_and_several_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@r1 x y\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    (tmp_path / "b.fa").write_text(">c one\nAC\nGT\n>d\nTTTT\n")
    rows = files.read_fastq(spark, str(tmp_path / "a.fq.gz"), keep_quality=True).orderBy("ordinal").collect()
    assert [(r["name"], r["seq"], r["name_suffix"], r["quality"]) for r in rows] == [("r1", "ACGT", " x y", "IIII"), ("r2", "GG", None, "II")]
    ref = files.read_reference(spark, [str(tmp_path / "a.fq.gz"), str(tmp_path / "b.fa")]).orderBy("input_index", "ordinal").collect()
    assert [(r["name"], r["seq"], r["input_index"]) for r in ref] == [("r1", "ACGT", 0), ("r2", "GG", 0), ("c", "ACGT", 1), ("d", "TTTT", 1)]
    with pytest.raises(ValueError, match="extension"):
        files.kind_of("x.txt")


def test_lines_that_the_scan_leaves_out(spark, tmp_path):
    line = lambda c, g, s: f"n\t0\t{c}\t1\t0\t{g}\t*\t0\t0\t{s}\t*"
    (tmp_path / "a.sam").write_text("\n".join([line("c", "4M", "ACGT"), line("*", "*", "ACGT"), line("c", "*", "ACGT"), line("c", "4M", "*")]) + "\n")
    parsed = files.parse_sam(files.read_sam_lines(spark, [str(tmp_path / "a.sam")]))
    assert files.kept(parsed).count() == 1
    assert tuple(files.dropped_counts(parsed).first()) == (4, 1, 1, 1, 0)


def test_deletion_admissibility_against_a_walk(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for pos in sorted(rng.sample(range(30), rng.randint(1, 30))):
            rows.append((f"c{c}", pos, rng.random() < 0.25, rng.random() < 0.6))
    df = spark.createDataFrame(rows, "contig string, pos int, s boolean, g boolean")
    got = {(r["contig"], r["pos"]): r["admissible"] for r in filters.deletion_admissible(df, F.col("s"), F.col("g")).collect()}
    at = {(c, p): (s, g) for c, p, s, g in rows}

    def walk(c, p):
        while p >= 0:
            s, g = at.get((c, p), (False, False))
            if s:
                return True
            if not g:
                return False
            p -= 1
        return True

    assert got == {k: walk(*k) for k in at}


def test_point_mutations_and_indels(spark):
    vcf = spark.createDataFrame(
        [("c", 5, "A", "T,G", 10.0, "0,0;5,4;1,0", "0,0;0,0;0,0", 0), ("c", -7, "-", "G", 9.0, "0,0;5,4", "0,0;0,0", 1), ("c", -7, "-", "C", 9.0, "0,0;5,4", "0,0;0,0", 2), ("c", 9, "N", "T", 9.0, "0,0;9,0", "0,0;0,0", 3)],
        "CHR string, POS int, REF string, ALT string, DP double, MIDDLE string, ENDS string, ord int",
    )
    assert [tuple(r) for r in calls.point_mutations(vcf).drop("ord", "rank").collect()] == [("c", 5, "A", "T", 10.0, 9.0)]
    rows = calls.indel_rows(vcf)
    expect = [("c", 7, "-", "GC", 9.0, 9.0)]
    assert [tuple(r) for r in calls.indel_runs(rows, order="ord").collect()] == expect
    assert [tuple(r) for r in calls.script_indel_runs(rows, "ord").drop("insertion", "closed").collect()] == [("c", 7, "", "GC", 9.0, 9.0)]


def test_near_pairs_lose_none(spark):
    rng = random.Random(2)
    a = [(i, "c", rng.randrange(500)) for i in range(200)]
    b = [(i, "c", rng.randrange(500)) for i in range(200)]
    left, right = spark.createDataFrame(a, "id int, CHR string, POS int"), spark.createDataFrame(b, "T_ID int, T_CHR string, T_POS int")
    got = {(r["id"], r["T_ID"]) for r in compare.near_pairs(left, right).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if abs(x[2] - y[2]) <= 10}


def test_lift_follows_each_shift(spark):
    calls_ = spark.createDataFrame([(1, "c", 100), (2, "d", 5)], "id int, CHR string, POS int")
    truth = spark.createDataFrame([("c", 10, 3), ("c", 98, 5), ("c", 96, -2)], "T_CHR string, T_POS int, T_LEN int")
    assert {r["id"]: r["LIFTED"] for r in compare.lifted(calls_, truth).collect()} == {1: 94, 2: 5}


def test_statistics_of_small_tables():
    odds, p = analysis.fisher_exact(3, 1, 1, 3)
    assert odds == 9.0 and abs(p - 0.4857142857) < 1e-9


def test_simulator_is_repeatable(spark):
    seq, found = simulate.random_indels("ACGT" * 200, 10, seed=3)
    assert len(found) == 10 and len(seq) == 800 + sum(len(x) if x[0] != "-" else 1 - len(x) for _, x in found)
    assert sum(simulate.shares({"a": 100, "b": 900}, 50).values()) == 50
    ref = spark.createDataFrame([("c", "ACGTN-ACGT")], "name string, seq string")
    a, b = (sorted(map(tuple, simulate.random_snps(ref, 4, seed=5).collect())) for _ in range(2))
    assert a == b and len(a) == 4 and all(x[2] != x[3] for x in a)


def test_command_line(spark, tmp_path, capsys):
    o = cli.parse("--reference r.fa --in-sam a.sam --out-vcf o --snp-threshold 2 0.5 --out-mutations m --indel-threshold 3 0.4 --num-threads 2".split())
    assert (o.ordered, o.vcf_thresholds.snp_depth, o.mutation_thresholds.go_on_fraction, o.mutation_thresholds.snp_depth) == (False, 2.0, 0.4, 5)
    with pytest.raises(ValueError):
        cli.parse(["--nonsense"])
    assert cli.main(["--version"]) == 0 and cli.main([]) == 1
    (tmp_path / "r.fa").write_text(">c\nACGTACGT\n")
    (tmp_path / "a.sam").write_text("".join(x + "\n" for x in simulate.simulated_reads("ACGTACGT", "c", 5, 6, errors=0)))
    assert cli.main(["--reference", f"{tmp_path}/r.fa", "--in-ordered-sam", f"{tmp_path}/a.sam", "--out-vcf", f"{tmp_path}/o.vcf", "--out-refs-map-count", f"{tmp_path}/n.txt"]) == 0
    assert (tmp_path / "o.vcf").read_text().count("\n") >= 6 and (tmp_path / "n.txt").read_text() == "Genome_set\tNo.reads\nr.fa-\t5\n"


def test_stream_of_mates(spark, tmp_path):
    import json

    from strandlake.streaming.mates import assembled

    row = lambda o, pos, rev, e: {"input_index": 0, "qname": "n", "ord": o, "contig": "c", "pos": pos, "rev": rev, "cigar": "4M", "seq": "ACGT", "expect": json.dumps(e)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(row(0, 1, False, [["c", 9, True]])) + "\n" + json.dumps(row(1, 9, True, [["c", 1, False]])) + "\n")
    stream = spark.readStream.schema("input_index int, qname string, ord long, contig string, pos int, rev boolean, cigar string, seq string, expect string").json(str(tmp_path / "in"))
    q = assembled(stream).writeStream.format("memory").queryName("mates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["ord"], r["aln"], r["part"], r["incomplete"]) for r in spark.table("mates").orderBy("ord").collect()] == [(0, 0, 0, False), (1, 0, 1, False)]
