"""Calls against truth sets and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import shared_pairs_similar
from .filters import BIN
from .grouping import running

#: Behind every place of a contig.
BEHIND = 1 << 48
SNP_KEY = ["CHR", "POS", "REF"]


def without_baseline(calls: DataFrame, baseline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["CHR", "POS"]
    return calls.join(baseline.select(*keys).distinct(), keys, "left_anti")


def false_positives(calls: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or SNP_KEY
    return calls.select(*keys).distinct().join(truth.select(*keys), keys, "left_anti")


def false_negatives(calls: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return false_positives(truth, calls, keys)


def confusion(calls: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: FP, FN, TP, total of the truth, from one full join of distinct keys."""
    keys = keys or SNP_KEY
    a, b = calls.select(*keys).distinct().withColumn("_c", F.lit(1)), truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    both = a.join(b, keys, "full_outer")
    has = lambda c: F.col(c).isNotNull()
    return both.agg(F.count_if(has("_c") & ~has("_t")).alias("FP"), F.count_if(~has("_c") & has("_t")).alias("FN"), F.count_if(has("_c") & has("_t")).alias("TP"), F.count_if(has("_t")).alias("total"))


def near_pairs(calls: DataFrame, truth: DataFrame, near: int = 10, how: str = "inner", residual: Column | None = None, truth_pos: str = "T_POS") -> DataFrame:
    """Calls with the truths of their contig within ``near`` positions: an equi-join on
    bins one wider than the distance, truths standing in their own and both next bins.

    ``truth`` has T_CHR and ``truth_pos``; calls have CHR and POS."""
    width = near + 1
    bins = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(truth_pos) / width) + d))
    right = truth.withColumn("_bin", bins)
    left = calls.withColumn("_cbin", F.floor(F.col("POS") / width))
    on = (F.col("CHR") == F.col("T_CHR")) & (F.col("_cbin") == F.col("_bin")) & (F.abs(F.col("POS") - F.col(truth_pos)) <= near)
    out = left.join(right, on if residual is None else on & residual, how)
    return out.drop("_bin", "_cbin")


def similar_kinds(calls: DataFrame, truth: DataFrame, near: int = 10) -> DataFrame:
    """Distinct (CHR, POS, INDEL) of the calls beside the distinct (T_CHR, T_POS, T_INDEL)
    near by with ``_n`` and ``_ids`` of their truths, ``_s`` where they are similar.

    Calls and truths that repeat a place and a text meet once, not each with each."""
    places = truth.groupBy("T_CHR", "T_POS", "T_INDEL").agg(F.countDistinct("T_ID").alias("_n"), F.collect_set("T_ID").alias("_ids"))
    similar = shared_pairs_similar(F.col("INDEL"), F.col("T_INDEL"))
    pairs = near_pairs(calls.select("CHR", "POS", "INDEL").distinct(), places, near)
    return pairs.withColumn("_s", F.coalesce(similar, F.lit(False)))


def indel_matches(calls: DataFrame, truth: DataFrame, near: int = 10) -> DataFrame:
    """Each call's label: TP (a truth near by is similar), FP_samePOS (a truth near by),
    FP_diffPOS; the truths hit, and their number ``hits``.  Calls have ``id``, CHR, POS,
    INDEL; truths ``T_ID`` (of one place and text), T_CHR, T_POS, T_INDEL.

    Where ``hit`` is not asked for, no ids are gathered."""
    pairs = similar_kinds(calls, truth, near)
    hit = lambda c: F.when(F.col("_s"), F.col(c))
    kinds = pairs.groupBy(F.col("CHR").alias("_c"), F.col("POS").alias("_p"), F.col("INDEL").alias("_i")).agg(F.max("_s").alias("_tp"), F.sum("_n").alias("_near"), F.sum(hit("_n")).alias("_hits"), F.array_sort(F.flatten(F.collect_list(hit("_ids")))).alias("_hit"))
    same = (F.col("CHR") == F.col("_c")) & (F.col("POS") == F.col("_p")) & F.col("INDEL").eqNullSafe(F.col("_i"))
    out = calls.select("id", "CHR", "POS", "INDEL").distinct().join(kinds, same, "left")
    label = F.when(F.col("_tp"), "TP").when(F.col("_near") > 0, "FP_samePOS").otherwise("FP_diffPOS")
    ids = F.coalesce("_hit", F.array().cast(f"array<{dict(truth.dtypes)['T_ID']}>"))
    return out.select("id", "CHR", "POS", "INDEL", label.alias("label"), F.coalesce("_hits", F.lit(0)).cast("long").alias("hits"), ids.alias("hit"))


def indel_summary(calls: DataFrame, truth: DataFrame, near: int = 10) -> DataFrame:
    """TP, FP_samePOS, FP_diffPOS, and FN: the truths less the distinct ones hit."""
    matches = indel_matches(calls, truth, near)
    counts = matches.agg(*(F.count_if(F.col("label") == x).alias(x) for x in ("TP", "FP_samePOS", "FP_diffPOS")))
    found = similar_kinds(calls, truth, near).filter("_s").select("T_CHR", "T_POS", "T_INDEL").distinct()
    hits = truth.join(found, ["T_CHR", "T_POS", "T_INDEL"], "left_semi").agg(F.countDistinct("T_ID").alias("_h"))
    expected = truth.agg(F.count("*").alias("_all"))
    return counts.crossJoin(hits).crossJoin(expected).select("TP", "FP_samePOS", "FP_diffPOS", (F.col("_all") - F.col("_h")).alias("FN"))  # one row each


def without_blanks(calls: DataFrame, blanks: DataFrame, near: int = 10) -> DataFrame:
    """Calls with no blank-run indel within ``near``; blanks have T_CHR, T_POS."""
    return near_pairs(calls, blanks.select("T_CHR", "T_POS").distinct(), near, "left_anti")


def lifted(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """``LIFTED``: POS on the mutated sequence shifted back by the lengths of the truth's
    indels before it, one after another, as each shift moves what counts as before.

    With the truths of a contig in order, a place that a truth does not reach is reached by no
    later one, and until then it is shifted by the whole sum before: a place goes by the first
    truth with position plus sum before not less than it.  Running maxima of those keys are
    steps; each distinct place looks up its step once, in blocks."""
    over = Window.partitionBy("T_CHR").orderBy("T_POS", "T_LEN")  # equal truths are alike in any order
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    truth = truth.filter("T_POS is not null").select("T_CHR", "T_POS", F.col("T_LEN").cast("long").alias("T_LEN"))
    rows = truth.withColumns({"_k": F.row_number().over(over), "_sum": F.coalesce(F.sum("T_LEN").over(before), F.lit(0)), "_lost": F.count_if(F.col("T_LEN").isNull()).over(before) > 0})
    rows = rows.withColumn("_at", F.max(F.col("T_POS") + F.col("_sum")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shift = F.when(~F.col("_lost"), F.col("_sum"))  # behind a truth of unknown length nothing is known
    steps = rows.groupBy(F.col("T_CHR").alias("_c"), "_at").agg(F.min_by(F.struct(shift.alias("shift")), "_k").alias("_to"))
    last = truth.groupBy(F.col("T_CHR").alias("_c")).agg(F.struct(F.when(F.count_if(F.col("T_LEN").isNull()) == 0, F.sum("T_LEN")).alias("shift")).alias("_to"))
    steps = steps.unionByName(last.withColumn("_at", F.lit(BEHIND)))
    places = calls.select(F.col("CHR").alias("_c"), F.col("POS").cast("long").alias("_at")).distinct().filter("_c is not null and _at is not null")
    both = steps.unionByName(places, allowMissingColumns=True)
    # from the last place to the first: the step met last is the nearest at or behind a place
    step = F.when(F.col("_to").isNotNull(), F.struct((-F.col("_at")).alias("at"), F.col("_to.shift").alias("shift")))
    both = running(both, ["_c"], -F.floor(F.col("_at") / BIN), [F.desc("_at"), F.col("_to").isNull()], {"_s": (step, "max")}).filter("_to is null").select("_c", "_at", "_s")
    moved = F.when(F.col("_s").isNull(), F.col("POS").cast("int")).otherwise((F.col("POS") - F.col("_s.shift")).cast("int"))
    return calls.join(both, (F.col("CHR") == F.col("_c")) & (F.col("POS").cast("long") == F.col("_at")), "left").withColumn("LIFTED", moved).drop("_c", "_at", "_s")


def shift_before(truth: DataFrame) -> DataFrame:
    """Sum of the lengths of a contig's earlier indels: the shift where indels lie apart."""
    w = Window.partitionBy("T_CHR").orderBy("T_POS", "T_ID").rowsBetween(Window.unboundedPreceding, -1)
    return truth.withColumn("shift", F.coalesce(F.sum("T_LEN").over(w), F.lit(0)))


def length_histogram(indels: DataFrame, column: str = "INDEL") -> DataFrame:
    return indels.groupBy(F.length(F.regexp_replace(column, "^-", "")).alias("len")).agg(F.count("*").alias("n"))
