"""Components (SAM lines) to alignments and query groups with weights.

A line may name other places where parts of its read lie (its mate, supplementary
alignments); an alignment is complete when all its parts are there.  Alignments that
follow one another and name the same reads are placements of one query and share its
weight.  Orders are global but never computed in one task: ``numbered`` counts by block
and adds the counts before it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Blocks in one run of ``numbered``.
STEP = 4096


def numbered(df: DataFrame, by: list[str], block: Column, order: list, name: str) -> DataFrame:
    """``name``: 0-based place of each row in the order of (block, order) within ``by``.

    Only the number of rows of each block passes through a window, of ``STEP`` blocks; one of
    all holds a row for each such run of blocks."""
    df = df.withColumn("_block", block)
    counts = df.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_run", F.floor(F.col("_block") / STEP))
    runs = counts.groupBy(*by, "_run").agg(F.sum("_n").alias("_n"))
    before = lambda *keys: Window.partitionBy(*by, *keys).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0))
    runs = runs.select(*by, "_run", earlier(before().orderBy("_run")).alias("_base"))
    starts = counts.withColumn("_in", earlier(before("_run").orderBy("_block"))).join(runs, [*by, "_run"]).select(*by, "_block", (F.col("_in") + F.col("_base")).alias("_from"))
    within = Window.partitionBy(*by, "_block").orderBy(*order)
    df = df.withColumn("_row", F.row_number().over(within) - 1)
    return df.join(starts, [*by, "_block"]).withColumn(name, F.col("_row") + F.col("_from")).drop("_block", "_row", "_from")


def running(df: DataFrame, by: list[str], block: Column, order: list, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds running maxima (``max``) or sums (``sum``) of columns in the order of (block,
    order) within ``by``, the row itself included.

    A window holds one block of rows, or one row for each block: no key is one task."""
    whole = {"max": F.max, "sum": F.sum}
    df = df.withColumn("_block", block).withColumns({f"_v_{n}": c for n, (c, _) in values.items()})
    totals = df.groupBy(*by, "_block").agg(*(whole[how](f"_v_{n}").alias(f"_t_{n}") for n, (_, how) in values.items()))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_block", *(whole[how](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (_, how) in values.items()))
    within = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({f"_v_{n}": whole[how](f"_v_{n}").over(within) for n, (_, how) in values.items()}).join(carried, [*by, "_block"])
    joined = {n: F.greatest(f"_v_{n}", f"_c_{n}") if how == "max" else F.coalesce(F.col(f"_v_{n}") + F.col(f"_c_{n}"), f"_v_{n}", f"_c_{n}") for n, (_, how) in values.items()}
    return df.withColumns(joined).drop("_block", *(f"_{k}_{n}" for k in "vc" for n in values))


def with_ordinals(components: DataFrame) -> DataFrame:
    """``ord``: number of the line among the kept lines of its file."""
    return numbered(components, ["input_index"], F.col("line_ord.block"), ["line_ord"], "ord").drop("line_ord")


def replay(rows: list[tuple], ordered: bool) -> list[tuple[int, int, int, bool, int]]:
    """The grouping of one read's lines (ord, place, expected places) in file order:
    (ord, alignment, part, incomplete, emitted at) for each."""
    out: list[tuple[int, int, int, bool, int]] = []
    held: list[tuple] = []

    def complete() -> bool:
        return bool(held) and all(any(o is not c and o[1] == e for o in held) for c in held for e in c[2])

    def emit(done: bool, at: int) -> None:
        out.extend((c[0], held[0][0], k, not done, at) for k, c in enumerate(held))
        held.clear()

    for row in rows:
        if ordered and held and row[0] != held[-1][0] + 1:
            emit(complete(), held[0][0])
        held.append(row)
        if complete():
            emit(True, held[0][0] if ordered else row[0])
    if held:
        emit(False, held[0][0] if ordered else (1 << 60) + held[0][0])
    return out


def alignments(components: DataFrame, ordered: bool = True) -> DataFrame:
    """Adds ``aln`` (ord of its first part), ``part``, ``incomplete``, ``emitted``, and
    ``n_parts`` of the alignment.

    Reads without any expected place are alignments of one line each; only the names of
    the others are gathered, and only their lines replayed, by file and read name.  If there
    are none, no line is moved."""
    rows = with_ordinals(components) if "ord" not in components.columns else components
    own = ["input_index", "qname"]
    waiting = components.filter(F.size("expect") > 0).select(*own)
    some = not waiting.isEmpty()
    alone = rows.join(waiting.distinct(), own, "left_anti") if some else rows
    alone = alone.select(*[c for c in rows.columns if c != "expect"], F.col("ord").alias("aln"), F.lit(0).alias("part"), F.lit(False).alias("incomplete"), F.col("ord").alias("emitted"), F.lit(1).cast("long").alias("n_parts"))
    if not some:
        return alone

    names = [c for c in rows.columns if c != "expect"]

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        inputs, reads, ords, contigs, positions, revs, expects = (table.column(c).to_pylist() for c in (*own, "ord", "contig", "pos", "rev", "expect"))
        place = lambda p: (p["contig"], p["pos"], p["rev"])
        out: list[tuple] = []
        at = 0
        while at < len(ords):
            end = at + 1
            while end < len(ords) and reads[end] == reads[at] and inputs[end] == inputs[at]:
                end += 1
            lines = [(ords[k], (contigs[k], positions[k], revs[k]), [place(e) for e in expects[k]]) for k in range(at, end)]
            out += [x[1:] for x in sorted(replay(lines, ordered))]  # rows are in the order of ord
            at = end
        sizes = Counter((k, x[0]) for k, x in zip(inputs, out))
        out = [(*x, sizes[k, x[0]]) for k, x in zip(inputs, out)]
        found = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))]
        for name, x in zip(("aln", "part", "incomplete", "emitted", "n_parts"), found):
            table = table.append_column(name, x)
        yield from table.drop_columns(["expect"]).to_batches()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads one after another; the last of a batch waits for the next one."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in own]
            begin = batch.num_rows
            while begin and [batch.column(c)[begin - 1].as_py() for c in own] == last:
                begin -= 1
            if begin or held and [held[0].column(c)[0].as_py() for c in own] != last:
                yield from settled(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from settled(pa.Table.from_batches(held))

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "expect")
    some = rows.select(*names, "expect").join(waiting.distinct(), own, "left_semi").repartition(*own).sortWithinPartitions(*own, "ord")
    some = some.mapInArrow(group, kinds + ", aln long, part int, incomplete boolean, emitted long, n_parts long")
    return alone.unionByName(some)


def query_groups(aligned: DataFrame) -> DataFrame:
    """Adds ``n_parts``, ``group_no`` and ``group_size`` (placements of the query), ``weight``.

    Consecutive alignments of the same names are islands: their place in the order of
    emission less their number among alignments of those names is constant."""
    if "n_parts" not in aligned.columns:
        aligned = aligned.withColumn("n_parts", F.count("*").over(Window.partitionBy("input_index", "aln")))
    heads = aligned.filter("part = 0").select("input_index", "qname", "aln", "n_parts", "emitted")
    heads = numbered(heads, ["input_index"], F.floor(F.col("emitted") / 200_000), ["emitted", "aln"], "place")
    same = Window.partitionBy("input_index", "qname", "n_parts")
    heads = heads.withColumn("group_no", F.col("place") - F.row_number().over(same.orderBy("place")))
    heads = heads.withColumn("group_size", F.count("*").over(Window.partitionBy("input_index", "qname", "n_parts", "group_no")))
    heads = heads.select("input_index", "aln", "group_no", "group_size", "place", (F.lit(1.0) / F.col("group_size")).cast("float").alias("weight"))
    return aligned.join(heads, ["input_index", "aln"])


def incomplete_groups(aligned: DataFrame) -> DataFrame:
    """``errors``: incomplete alignments of each file, without the last one emitted
    (nothing follows it that would report it)."""
    heads = aligned.filter("part = 0")
    last = heads.groupBy("input_index").agg(F.max("emitted").alias("_last"))
    return heads.join(F.broadcast(last), "input_index").groupBy("input_index").agg(F.count_if(F.col("incomplete") & (F.col("emitted") < F.col("_last"))).alias("errors"))


def peak_pending(aligned: DataFrame) -> DataFrame:
    """Most alignments waiting for a part at one time, by file (a running sum of +1 at
    the first part and -1 at emission)."""
    heads = aligned.filter("part = 0 and aln < emitted").select("input_index", F.explode(F.array(F.struct(F.col("aln").alias("at"), F.lit(1).alias("d")), F.struct(F.col("emitted").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    moments = heads.groupBy("input_index", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    out = running(moments, ["input_index"], F.floor(F.col("at") / 200_000), ["at"], {"r": (F.col("d"), "sum")})
    return out.groupBy("input_index").agg(F.max("r").alias("peak"))
