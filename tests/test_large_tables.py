"""Steps that met more rows than their input on large tables."""

import random

from strandlake.operators import compare, pileup
from strandlake.sources import files


def test_calls_and_truths_of_one_place_meet_once(spark):
    rng = random.Random(7)
    texts = ["ACGT", "ACG", "TTTT", "GA"]
    a = [(i, "c", rng.choice([5, 9, 400]), rng.choice(texts)) for i in range(300)] + [(300, None, None, None)]
    b = [(i, "c", rng.choice([0, 7, 9]), rng.choice(texts)) for i in range(200)]
    calls_, truth = spark.createDataFrame(a, "id int, CHR string, POS int, INDEL string"), spark.createDataFrame(b, "T_ID int, T_CHR string, T_POS int, T_INDEL string")
    assert compare.similar_kinds(calls_, truth).count() <= 3 * 5 * 3 * 4

    def similar(x, y):
        s, l = sorted((x, y), key=len)
        return s in l or sum(s[k : k + 2] in l for k in range(len(s) - 1)) >= len(s) - 2

    want, hit = {}, set()
    for i, c, p, t in a:
        near = [y for y in b if c == y[1] and abs(p - y[2]) <= 10]
        good = {y[0] for y in near if similar(t, y[3])}
        hit |= good
        want[i] = ("TP" if good else "FP_samePOS" if near else "FP_diffPOS", len(good), sorted(good))
    got = compare.indel_matches(calls_.union(calls_), truth)
    assert {r["id"]: (r["label"], r["hits"], r["hit"]) for r in got.collect()} == want
    labels = [x[0] for x in want.values()]
    counts = [labels.count(x) for x in ("TP", "FP_samePOS", "FP_diffPOS")]
    assert list(compare.indel_summary(calls_, truth).first()) == [*counts, len(b) - len(hit)]


def test_lift_equals_the_fold_of_truths_in_turn(spark):
    rng = random.Random(3)
    truth = [(c, rng.randrange(-5, 400) * s, rng.randrange(-9, 12)) for c in "cde" for s in [1 if c != "e" else 700] for _ in range(150)]
    truth += [("d", 300, None), (None, 4, 2)]
    places = [(i, rng.choice("cdef"), rng.randrange(-20, 500)) for i in range(600)] + [(600 + i, "e", rng.randrange(0, 300_000)) for i in range(300)] + [(900, "c", None), (901, None, 5)]

    def moved(c, p):
        for t, n in sorted(((x[1], x[2]) for x in truth if x[0] is not None and x[0] == c), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            if p is not None and t < p:
                p = None if n is None else p - n
        return p

    rows = spark.createDataFrame(places, "id int, CHR string, POS int")
    out = compare.lifted(rows, spark.createDataFrame(truth, "T_CHR string, T_POS int, T_LEN int"))
    assert {r["id"]: r["LIFTED"] for r in out.collect()} == {i: moved(c, p) for i, c, p in places}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_absences_and_positions_share_one_exchange(spark):
    rows = [("c", p, i, "-" if i is not None else "A", a, f, m, 25) for p in range(40) for i in (None, 0, 1) for a in "ACG" for f in (True, False) for m in (True, False) if (p + (i or 0)) % 3]
    seen = spark.createDataFrame(rows, "contig string, pos int, ins_idx int, ref string, allele string, fwd boolean, near_end boolean, w100 int")
    piled = pileup.pileup(seen, False)
    out = pileup.positions(pileup.with_absences(piled), False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # counts before, by strand and part, and by place
    sums = {(r["pos"], r["ins_idx"]): (r["middle"], r["r_fm"]) for r in out.collect()}
    assert sums[4, None] == (150, 25) and sums[4, 1] == (150, 0) and sums[2, 0] == (150, 0) and sums[3, 1] == (150, 0)


def test_a_line_is_split_once(spark):
    lines = spark.createDataFrame([("r\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tSA:Z:d,7,-,3M,60,0;", 0, (0, 1)), ("@HD", 0, (0, 0)), ("", 0, (0, 2))], "value string, input_index int, line_ord struct<block:bigint,row:bigint>")
    rows = files.kept(files.parse_sam(lines))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1
    assert [(r["qname"], r["pos"], r["seq"], r["expect"][0]["contig"]) for r in rows.collect()] == [("r", 5, "ACGT", "d")]
