"""Reads to report rows, small cases with literal results."""

import pytest

from strandlake.operators import reports
from strandlake.operators.filters import Thresholds
from strandlake.plans.variants import Run

LONG = "GTTCAGGACTGGCTCTCCTGTGAGCATCCATTGGCTACGT"  # what is read of it: the first ten bases and those from 21 to 30


def sam(name, flag, pos, cigar, seq, rnext="*", pnext="*", *tags):
    return "\t".join([name, str(flag), "contig1", str(pos), "0", cigar, rnext, str(pnext), "0", seq, "*", *tags])


def pair(name, a, b, first, second):
    n = len(first)
    return [sam(name, 32, a, f"{n}M", first, "contig1", b), sam(name, 16, b, f"{len(second)}M", second, "contig1", a)]


#: name -> (reference, lines); all are read in one run, each on a contig of its own
CASES = {
    "match": ("TGCCATTGCA", [sam("n", 0, 3, "5M", "CCATT")]),
    "snp": ("GATTACAGG", [sam("n", 0, 2, "6M", "ATTCCA")]),
    "snps": ("CCTGATCGTT", [sam("n", 0, 1, "10M", "CCTAGTCGTT")]),
    "pair": (LONG, pair("n", 1, 21, "GTTCAGGACT", "TGAGCATCCA")),
    "twice": ("GGATCTTTTTGGATC", [sam("n", 0, 1, "5M", "GGATC"), sam("n", 0, 11, "5M", "GGATC")]),
    "pairs": ("TCAGTTTTGACCTTTTTCAGTTTTGACC", pair("n", 1, 9, "TCAG", "GACC") + pair("n", 17, 25, "TCAG", "GACC")),
    "mate": ("GACTTTCC" * 8, [sam("m", 32, 1, "4M", "GACT", "contig1", 9), *pair("n", 17, 25, "GACT", "GACT"), *pair("o", 33, 41, "GACT", "GACT")]),
    "parts": ("CTGATTCAGGTCACGATC", [sam("n", 0, 2, "3M", "TGA", "*", "*", "SA:Z:contig1,12,+,3M,60,0;"), sam("n", 0, 12, "3M", "CAC", "*", "*", "SA:Z:contig1,2,+,3M,60,0;")]),
    "overlap": ("CAGTTCCGATAG", pair("n", 1, 4, "CAGTTC", "TTCCGA")),
    "gap": ("CCATGGGGTACA", [sam("n", 0, 2, "2M5N4M", "CATACA")]),
    "insertion": ("TCAGGT", [sam("n", 0, 1, "4M2I2M", "TCAGCTGT")]),
    "deletion": ("GGCATTCAGACT", [sam("n", 0, 1, "5M3D4M", "GGCATGACT")]),
    "two": ("TTGACCAG", [sam("n", 0, 1, "8M", "TTCACAAG")]),
    "short": ("GTCCAAGT", [sam("n", 0, 1, "1M1D6M", "GCCAAGT")]),
    "leading": ("GATC", [sam("n", 0, 1, "2I4M", "CCGATC")]),
    "clipped": ("CCGATC", [sam("n", 0, 3, "1S2I4M", "TAAGATC")]),
    "codes": ("GATCGATC", [sam("n", 0, 1, "4M", "GYNC")]),
    "inserted": ("GATCGATC", [sam("n", 0, 1, "4M1I4M", "GATCYGATC")]),
    "apart": ("TCGATCGATCGATCGA", [sam("n", 0, 1, "2M2D2M", "TCTC"), sam("m", 0, 9, "2M2D2M", "TCTC")]),
    "example": ("GATCGATCGATC", [sam("a", 0, 1, "3M", "GAC"), sam("b", 0, 1, "8M", "GACCGATC"), sam("c", 0, 2, "8M", "ACCGATCG")]),
    **{f"k{k}": ("GATC" * 101, [sam("n", 0, 4 * i + 1, "4M", "GATC") for i in range(k)]) for k in (3, 7, 100, 101)},
}


@pytest.fixture(scope="module")
def all_cases(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cases")
    named = {k: (ref, [x.replace("contig1", k).replace("\t", f"_{k}\t", 1) for x in lines]) for k, (ref, lines) in CASES.items()}
    (folder / "r.fa").write_text("".join(f">{k} some words\n{ref[:7]}\n{ref[7:]}\n" for k, (ref, _) in named.items()))
    (folder / "a.sam").write_text("@HD\tVN:1.6\n" + "".join(x + "\n" for _, lines in named.values() for x in lines))
    r = Run(spark, [str(folder / "a.sam")], [str(folder / "r.fa")], True, 0.0)
    split = lambda rows: {k: [x.value.split("\t")[1:] for x in rows if x.value.split("\t")[0] == k] for k in CASES}
    return split(reports.vcf_lines(r.vcf()).collect()), split(reports.mutation_lines(r.mutations(Thresholds())).collect()), r.errors()


@pytest.fixture
def run(spark, tmp_path):
    def make(reference, lines, ordered=True, fraction=0.0, support=True, **more):
        (tmp_path / "r.fa").write_text(f">contig1 some words\n{reference}\n")
        (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + "".join(x + "\n" for x in lines))
        return Run(spark, [str(tmp_path / "a.sam")], [str(tmp_path / "r.fa")], ordered, fraction, support, **more)

    return make


def vcf(r, *args):
    return [x.value.split("\t")[1:] for x in reports.vcf_lines(r.vcf(*args)).collect()]


def mutations(r, t=Thresholds()):
    return [x.value.split("\t")[1:] for x in reports.mutation_lines(r.mutations(t)).collect()]


def test_vcf_of_simple_reads(all_cases):
    rows = all_cases[0]
    assert rows["match"] == [[str(i + 3), b, ".", "1", "1,0", "0,0", "."] for i, b in enumerate("CCATT")]
    assert rows["snp"][3] == ["5", "A", "C", "1", "0,0;1,0", "0,0;0,0", "ATT[C]CA"]
    assert [r[0] for r in rows["gap"]] == ["2", "3", "9", "10", "11", "12"]
    assert [r[0] for r in rows["codes"]] == ["1", "4"]


def test_weights(all_cases):
    rows = all_cases[0]
    assert [r[3] for r in rows["twice"]] == ["0.5"] * 10 and [r[3] for r in rows["pairs"]] == ["0.5"] * 16
    assert [{r[3] for r in rows[k]} for k in ("k3", "k7", "k100")] == [{"0.33"}, {"0.14"}, {"0.01"}] and rows["k101"] == []
    assert {r[3] for r in rows["overlap"]} == {"1"} and len(rows["overlap"]) == 9


def test_pairs_and_parts(all_cases):
    rows, _, errors = all_cases
    assert [r[0] for r in rows["pair"]] == [str(i) for i in [*range(1, 11), *range(21, 31)]]
    assert {r[4] for r in rows["pair"][:10]} == {"1,0"} and {r[4] for r in rows["pair"][10:]} == {"0,1"}
    assert [(r[0], r[3]) for r in rows["parts"]] == [(str(i), "1") for i in (2, 3, 4, 12, 13, 14)]
    assert errors == 1 and {r[3] for r in rows["mate"]} == {"1"} and len(rows["mate"]) == 20


def test_indels_in_the_summary(all_cases):
    rows = all_cases[0]
    assert [r for r in rows["insertion"] if r[0] == "-4"] == [["-4", "-", "C", "1", "0,0;1,0", "0,0;0,0", "TCAG[C]TGT"], ["-4", "-", "T", "1", "0,0;1,0", "0,0;0,0", "TCAGC[T]GT"]]
    assert [r for r in rows["deletion"] if r[0] == "7"] == [["7", "C", "-", "1", "0,0;1,0", "0,0;0,0", "GGCAT[-]GACT"]]
    assert [r for r in rows["example"] if r[0] == "3"][0][6] == "GA[C]CGATC"


def test_mutations(all_cases):
    found = {k: [tuple(r) for r in v] for k, v in all_cases[1].items()}
    assert found["match"] == found["leading"] == found["clipped"] == []
    assert found["snp"] == [("5", "A", "C", "1", "1")]
    assert found["snps"] == [("4", "G", "A", "1", "1"), ("5", "A", "G", "1", "1")]
    assert found["insertion"] == [("4", "--", "CT", "1", "1")]
    assert found["deletion"] == [("6", "TCA", "---", "1", "1")]
    assert found["two"] == [("3", "G", "C", "1", "1"), ("6", "C", "A", "1", "1")]
    assert found["short"] == [("2", "T", "-", "1", "1")]
    assert found["inserted"] == [("4", "-", "N", "1", "1")]
    assert [m[:2] for m in found["apart"]] == [("3", "GA"), ("11", "GA")]


def test_query_ends(run):
    rows = vcf(run("CATTGACCGATAGGCTTACG", [sam("n", 0, 4, "15M", "TGACCGATAGGCTTA")], fraction=0.2))
    assert [r[0] for r in rows if r[5] == "1,0"] == ["4", "5", "6", "16", "17", "18"] and [r[0] for r in rows if r[4] == "1,0"] == [str(i) for i in range(7, 16)]


def test_unordered_pairs_may_stand_apart(run):
    a, b = pair("n", 1, 9, "GACT", "GACT")
    lines = [a, *(sam(f"x{i}", 0, 17, "4M", "GACT") for i in range(3)), b]
    r = run("GACTTTCC" * 4, lines, ordered=False, support=False)
    assert {x[3] for x in vcf(r, Thresholds(), False)} == {"1", "3"} and r.errors() == 0
    assert run("GACTTTCC" * 4, lines).errors() == 1


def test_thresholds(run):
    lines = [sam(f"n{i}", 0, 1, "2M2D4M", "ACACGT") for i in range(2)] + [sam("m", 0, 1, "2M1D5M", "ACTACGT")] + [sam("o", 0, 9, "8M", "ACGTAACT")]
    r = run("ACGTACGT" * 2, lines)
    assert [x[:3] for x in mutations(r, Thresholds(snp_depth=2, start_depth=1, start_fraction=0.9, go_on_depth=1, go_on_fraction=0.5))] == [["3", "GT", "--"]]
    assert mutations(r, Thresholds(snp_depth=2, start_depth=4)) == []


def test_errors_name_what_is_wrong(run):
    with pytest.raises(Exception, match="no line of reads"):
        run("ACGT", ["no line of reads"]).components.collect()
    with pytest.raises(Exception, match="not found"):
        run("ACGT", [sam("n", 0, 1, "4M", "ACGT").replace("contig1", "other")]).positions().collect()
    with pytest.raises(Exception, match="cigar"):
        run("ACGT", [sam("n", 0, 1, "4P", "ACGT")]).blocked.collect()
    assert run("ACGT", [sam("n", 0, 1, "2=1X1=", "ACTT")], extended_cigar=True).blocked.first()["q_last"] == 4


def test_sam_again_reads_by_reference_and_statistics(run):
    r = run("ACGTACGTACGT", [sam("n", 16, 2, "1H2S4M1D2M", "TTCGTACG")])
    assert [x.value.split("\t")[1:] for x in reports.sam_lines(r.sam()).collect()] == [["16", "contig1", "2", "255", "2S4M1D2M", "*", "0", "8", "TTCGTACG", "*", "AS:f:0.0"]]
    assert [tuple(x) for x in r.refs_map_count().collect()] == [("r.fa-", 1)]
    assert reports.sam_header(r.reference)[1] == "@SQ\tSN:contig1\tLN:12"
    s = run(LONG, pair("n", 1, 21, "GTTCAGGACT", "TGAGCATCCA")).statistics().first()
    assert (s["queries"], s["alignments"], s["mean"], s["stddev"], s["covered"], s["bases"]) == (1, 1, 10.0, 0.0, 20, 40)


def test_empty_input_and_large_references(run):
    from strandlake.operators import observations, pileup

    assert vcf(run("ACGT", [])) == []
    r = run("ACGT" * 30, [sam("n", 0, 3, "20M3I20M2D20M", "GTAC" * 15 + "GTA")])
    rows = [sorted(map(str, pileup.pileup(observations.base_observations(r.blocked, r.reference, 0.1, large), False).collect())) for large in (False, True)]
    assert rows[0] == rows[1]
