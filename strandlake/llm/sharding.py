"""A uniform shuffle into shards of exact sizes, by a hypergeometric matrix.

Rows lie in source partitions.  How many rows of each source partition go to each
shard is drawn exactly (a multivariate hypergeometric draw: row sums are the
partitions' counts, column sums the shards' sizes), so any assignment of rows to
shards with these sizes is equally likely.  Each source partition permutes its rows
and deals them out by its row of the matrix; after the exchange each shard permutes
what it got.  Rows, ranks and the exchange are DataFrame operations; the driver
draws only the matrix of partitions times shards.

Texts never move: what is dealt is (id, size, checksum).  Source partitions and the
blocks in which a shard is permuted hold about ``block_rows`` rows each and are made
by hashing the row's place, so no key, source or group of copies makes one large.
"""

from __future__ import annotations

import json
import math
import random
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, shared_dir


def stirling_error(n: int) -> float:
    """log(n!) less Stirling's approximation of it."""
    if n < 16:
        return math.log(math.factorial(n)) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x / 1680))) / n


def deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where they are near."""
    v = (x - mean) / (x + mean)
    if abs(v) >= 0.1:
        return x * math.log(x / mean) + mean - x
    out, power, k = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = out + power / (2 * k + 1)
        if more == out:
            return out
        out, k = more, k + 1


def binomial(x: int, n: int, p: float, q: float) -> float:
    """Probability of x hits in n, by the saddle-point expansion: its relative error stays
    near that of a double however large n is."""
    if x == 0 or x == n:
        return math.exp(n * (math.log1p(-p) if x == 0 else math.log1p(-q)))
    log = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * q)
    return math.exp(log) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, by inversion from the mode
    outwards.  Probabilities have the precision of doubles at any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p, q = draws / (good + bad), (good + bad - draws) / (good + bad)
    p0 = binomial(mode, good, p, q) * binomial(draws - mode, bad, p, q) / binomial(draws, good + bad, p, q)
    u = rng.random() - p0
    if u < 0:
        return mode
    left, right, pl, pr = mode, mode, p0, p0
    while left > low or right < high:
        if right < high:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u < 0:
                return right
        if left > low:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u < 0:
                return left
        if pl + pr < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: source partitions with ``counts``; columns: shards with ``sizes``."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest = [], sum(left)
        for size in left:
            k = hypergeometric(rng, size, rest - size, n) if n else 0
            row.append(k)
            rest -= size
            n -= k
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = 11, block_rows: int = 500_000) -> DataFrame:
    """Each row's shard and its place there; shard counts differ by one at most.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16, ``text_crc32`` the
    unsigned CRC-32 of those bytes (null: of none).  Rows with null or repeated ids,
    repeated rows and equal texts are rows like any other; an empty table gives no
    rows.  Only the two named columns are read."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_place"),
    )
    rows = cut(rows, "shard-rows")  # places are fixed from here on
    total = rows.count()
    blocks = max(8, math.ceil(total / block_rows))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(blocks)).cast("int"))
    counted = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}  # one row for each block
    counts = [counted.get(p, 0) for p in range(blocks)]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    ends = []
    for row in communication_matrix(counts, sizes, seed):
        at, ends_row = 0, []
        for k in row:
            at += k
            ends_row.append(at)
        ends.append(ends_row)
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/shard-matrix-{uuid.uuid4().hex}"
    for at in range(0, len(ends), 2000):  # a table, so that no plan holds more than so many rows of it
        part = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends[at : at + 2000])), "array<array<bigint>>")).alias("_q", "_ends"))
        part.withColumn("_q", F.col("_q") + at).write.mode("append").parquet(path)
    matrix = spark.read.schema("_q int, _ends array<bigint>").parquet(path)
    local = Window.partitionBy("_p").orderBy(F.xxhash64(F.lit(seed + 1), "_place"), "_place")
    dealt = (
        rows.withColumn("_r", F.row_number().over(local) - 1)
        .join(matrix, F.col("_p") == F.col("_q"))
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_r"))))
        .withColumn("_u", F.xxhash64(F.lit(seed + 2), "_place"))
    )
    parts = max(1, math.ceil(blocks / shards))
    # the leading bits of _u choose the block of the shard, so blocks in order are the order of _u
    dealt = cut(dealt.select(id_col, "size", "text_crc32", "_place", "shard", "_u", F.floor((F.col("_u") / F.lit(2.0**64) + 0.5) * parts).cast("int").alias("_b")), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_b").agg(F.count("*").alias("_n")).select(F.col("shard").alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_b").orderBy("_u", "_place")
    return (
        dealt.join(F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col("_b") == F.col("_c")))
        .withColumn("slot", (F.row_number().over(within) - 1 + F.col("_from")).cast("long"))
        .select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
