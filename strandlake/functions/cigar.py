"""CIGAR strings: tokens, and blocks by a fold over the tokens of each distinct string."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<q_start:int,r_start:int,q_len:int,r_len:int>"
TOKEN = re.compile("([0-9]+)([A-Za-z=])")


def tokens(cigar: Column) -> Column:
    """array<struct<n:int,op:string>>; a part that is no token fails."""
    numbers = F.regexp_extract_all(cigar, F.lit("([0-9]+)([A-Za-z=])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([A-Za-z=])"), F.lit(2))
    out = F.zip_with(numbers, ops, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))
    broken = F.regexp_replace(cigar, "[0-9]+[A-Za-z=]", "") != ""
    return F.when(broken, F.raise_error(F.concat(F.lit("Could not parse cigar string "), cigar)).cast("array<struct<n:int,op:string>>")).otherwise(out)


def fold(text: str, extended: bool = False) -> list[tuple[int, int, int, int]]:
    """The blocks of one CIGAR string that begins at reference index 0."""
    match, nothing = ("M=X", "HP") if extended else ("M", "H")
    if TOKEN.sub("", text):
        raise ValueError(f"Could not parse cigar string {text}")
    out, q, r = [], 0, 0
    for number, op in TOKEN.findall(text):
        n = int(number)
        if op in match or op == "D" or op == "I" and q > 0:
            q_len, r_len = n * (op != "D"), n * (op != "I")
            out.append((q, r, q_len, r_len))
            q, r = q + q_len, r + r_len
        elif op in "SI":
            q += n
        elif op == "N":
            r += n
        elif op not in nothing:
            raise ValueError(f"Unrecognized cigar character {op} in {text}")
    return out


def folded(extended: bool):
    """``fold`` over columns (CIGAR string, first reference index): each string once a batch."""

    def run(text: pa.Array, start: pa.Array) -> pa.Array:
        coded = text.dictionary_encode()
        found = [fold(t, extended) for t in coded.dictionary.to_pylist()]
        flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 4)
        sizes = np.array([*map(len, found), 0], np.int64)
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.fill_null(len(found)).to_numpy(zero_copy_only=False)
        n = sizes[which]
        ends = np.cumsum(n)
        cells = flat[np.repeat(begins[which] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
        shift, unknown = np.repeat(start.fill_null(0).to_numpy(zero_copy_only=False), n), np.repeat(start.is_null().to_numpy(zero_copy_only=False), n)
        fields = [pa.array(cells[:, 0]), pa.array(cells[:, 1] + shift, pa.int32(), mask=unknown), pa.array(cells[:, 2]), pa.array(cells[:, 3])]
        values = pa.StructArray.from_arrays(fields, ["q_start", "r_start", "q_len", "r_len"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, mask=text.is_null())

    run.__annotations__ = {"text": pa.Array, "start": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<{BLOCK}>")


def blocks(cigar: Column, pos: Column, seq_len: Column, extended: bool = False) -> Column:
    """Aligned blocks (0-based): matches, insertions (r_len 0), deletions (q_len 0).

    ``pos`` is 1-based.  A lone ``=`` is one match of the whole sequence.  S and an I at
    the first base skip query bases, H skips nothing, N skips reference bases; other
    operations fail unless ``extended`` reads = and X as matches and P as nothing."""
    whole = F.when(cigar == "=", F.concat(seq_len.cast("string"), F.lit("M"))).otherwise(cigar)
    return folded(extended)(whole, (pos - 1).cast("int"))


def has_gap(cigar: Column) -> Column:
    return F.instr(cigar, "N") > 0


def from_blocks(block_list: Column, seq_len: Column) -> Column:
    """A CIGAR string of blocks, with soft clips for what they leave out."""

    def step(acc: Column, b: Column) -> Column:
        clip = F.when(b["q_start"] != acc["q"], F.concat(b["q_start"].cast("string"), F.lit("S"))).otherwise("")
        op = F.when(b["q_len"] == b["r_len"], F.concat(b["q_len"].cast("string"), F.lit("M"))).when(b["q_len"] > b["r_len"], F.concat(b["q_len"].cast("string"), F.lit("I"))).otherwise(F.concat(b["r_len"].cast("string"), F.lit("D")))
        return F.struct((b["q_start"] + b["q_len"]).alias("q"), F.concat(acc["s"], clip, op).alias("s"))

    end = lambda acc: F.concat(acc["s"], F.when(acc["q"] < seq_len, F.concat((seq_len - acc["q"]).cast("string"), F.lit("S"))).otherwise(""))
    return F.aggregate(block_list, F.struct(F.lit(0).alias("q"), F.lit("").alias("s")), step, end)
