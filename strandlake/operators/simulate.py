"""Seeded mutations of small genomes, for tests and benchmarks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shares(lengths: dict[str, int], total: int, seed: int = 1) -> dict[str, int]:
    """How many of ``total`` mutations each contig gets, in proportion to its length."""
    rng = random.Random(seed)
    out = dict.fromkeys(lengths, 0)
    for name in rng.choices(list(lengths), weights=list(lengths.values()), k=total):
        out[name] += 1
    return out


def random_snps(reference: DataFrame, each: int, seed: int = 1) -> DataFrame:
    """CHR, POS (1-based), REF, ALT of ``each`` positions of every contig, without gaps
    and N; the least hashes win, so it is repeatable and done by contig in parallel."""
    bases = reference.select(F.col("name").alias("CHR"), F.posexplode(F.split("seq", "")).alias("p", "REF")).filter("REF not in ('-', 'N')")
    pick = Window.partitionBy("CHR").orderBy(F.xxhash64(F.lit(seed), "CHR", "p"), "p")
    others = F.filter(F.array(*(F.lit(b) for b in "ACGT")), lambda b: b != F.col("REF"))
    chosen = bases.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= each)
    return chosen.select("CHR", (F.col("p") + 1).alias("POS"), "REF", F.element_at(others, (F.pmod(F.xxhash64(F.lit(seed + 1), "CHR", "p"), F.size(others)) + 1).cast("int")).alias("ALT"))


def random_indels(seq: str, count: int, seed: int = 1, sizes: tuple[int, ...] = (*range(-20, -2), *range(2, 20))) -> tuple[str, list[tuple[int, str]]]:
    """A mutated sequence and its indels (1-based place in the original, inserted bases
    or ``-`` and the deleted ones), in order of position, apart from one another."""
    rng = random.Random(seed)
    places = sorted(rng.sample(range(25, max(26, len(seq) - 25), 50), min(count, max(0, (len(seq) - 50) // 50))))
    out, at, found = [], 0, []
    for p in places:
        out.append(seq[at:p])
        size = rng.choice(sizes)
        if size > 0:
            new = "".join(rng.choices("ACGT", k=size))
            out.append(new)
            found.append((p, new))
            at = p
        else:
            found.append((p, "-" + seq[p : p - size]))
            at = p - size
    return "".join([*out, seq[at:]]), found


def simulated_reads(seq: str, contig: str, count: int, length: int = 100, seed: int = 1, errors: float = 0.01) -> list[str]:
    """SAM lines of unpaired reads at random places, with substitutions."""
    rng = random.Random(seed)
    lines = []
    for k in range(count):
        p = rng.randrange(0, len(seq) - length + 1)
        read = "".join(rng.choice("ACGT") if rng.random() < errors else b for b in seq[p : p + length])
        lines.append(f"read{k}\t{16 * rng.randrange(2)}\t{contig}\t{p + 1}\t60\t{length}M\t*\t0\t0\t{read}\t*")
    return lines
