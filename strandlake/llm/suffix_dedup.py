"""Removal of repeated byte strings by threshold-bounded interval expansion.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere.
Which windows of that length are repeated is settled exactly, in three steps.

1. Candidates.  The anchor of a window is the least hashed 8-gram among its first
   ``reach`` positions, the leftmost of equals: it depends on the window's bytes
   alone, so equal windows have equal anchors at equal offsets, followed by the same
   ``length - reach + 1`` bytes, whose hash is the key.  Windows with one anchor are
   neighbours; together they are the anchor's context.  Counting keys by partial
   aggregation leaves the anchors whose key occurs twice at least.
2. Copies.  If all contexts of a key are the same bytes, all their windows repeat.
   Only keys with different contexts go on, one context of each kind.
3. Expansion.  Within a key, windows are grouped again by finer offsets from the anchor
   (``fine`` at a time) and by the longer stretch that such windows share; what is alone
   or the same in all copies is settled, what differs is laid end to end in blocks of
   bounded size.  From the block's suffix array come its Burrows-Wheeler transform
   and the mapping from last to first column.  Breadth-first backward extension
   starts at the interval of the empty string: the intervals of all strings cw are
   found from those of w, and a bound of an interval that no shorter string had gets
   |w| as its common-prefix value, so values come up by increasing size.  Intervals
   without a new bound are not extended, and all stops at ``length``: bounds without
   a value then part suffixes with ``length`` bytes or more in common.

A key with over ``most_contexts`` different contexts (a frequent passage in ever new
surroundings) is not laid into one block; the rule of step 3 is applied to it by map-side
sums, at ever finer offsets (``fine``, an eighth of it, one).  Parts that stand twice are
repeated as a whole, and only those that differ among parts of one stretch go on, one of
each kind, so that single windows are counted at the passage's edges alone.  Texts travel
compressed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean

SLICE = 2 << 20
#: Keys with over this part of all anchors are joined by broadcast, so there are no more of them.
HOT_KEYS = 1000


def row_key(doc_id, text: bytes) -> bytes:
    """128 bits for the row; rows equal in id and text share them and their result."""
    return xxhash.xxh3_128_digest(repr(doc_id).encode() + b"\0" + text)


def grams(buf: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 8 bytes from each position on (zeros beyond the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    x = np.lib.stride_tricks.as_strided(padded, (len(buf), 8), (1, 1))
    word = np.ascontiguousarray(x).view(np.uint64).ravel()
    word = word * np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(29)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    return word >> np.uint64(32)


def anchors(buf: np.ndarray, ends: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each context in texts laid end to end.

    ends: where each text ends.  No window crosses an end."""
    n = len(buf)
    starts = np.concatenate(([0], ends[:-1]))
    room = np.maximum(ends - starts - length + 1, 0)  # windows of each text
    total = int(room.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    at = np.repeat(starts - (np.cumsum(room) - room), room) + np.arange(total)
    blocks = -(-n // reach) + 1
    h = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    h[:n] = (grams(buf) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    h = h.reshape(blocks, reach)
    ahead = np.minimum.accumulate(h, axis=1).ravel()
    behind = np.minimum.accumulate(h[:, ::-1], axis=1)[:, ::-1].ravel()
    a = (np.minimum(behind[at], ahead[at + reach - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    return a[first], at[first], at[last]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling.  Keys carry their position in
    the low bits, so that one plain sort of integers orders them."""
    n = len(text)
    bits = max(1, (n + 1).bit_length())
    if 3 * bits > 63:
        raise ValueError(f"a block of {n} symbols is too large")
    symbols, code = np.unique(text, return_inverse=True)
    wide = max(1, len(symbols).bit_length())
    place = np.arange(n, dtype=np.int64)
    h = (63 - bits) // wide
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= wide
        key[: max(0, n - k)] |= code[k:] + 1
    while True:
        both = np.sort((key << bits) | place)
        sa, key = both & ((1 << bits) - 1), both >> bits
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(key[1:] != key[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[sa] = step
        if step[-1] == n - 1:
            return sa, rank
        key = (rank + 1) << bits
        key[: max(0, n - h)] |= rank[h:] + 1
        h *= 2


def expand(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Common-prefix values below ``depth`` between neighbours in the suffix array
    (-1: at least ``depth``), and the inverse suffix array.  0 parts contexts and is
    never extended by; the text ends with one."""
    sa, rank = suffix_array(text)
    n = len(text)
    lf, first = rank[sa - 1], text[sa]
    last = text[sa - 1]
    value = np.full(n + 1, -1, np.int32)
    value[0] = value[n] = 0
    lb, rb = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for level in range(depth):
        size = rb - lb + 1
        total = int(size.sum())
        interval = np.repeat(np.arange(len(lb)), size)
        at = np.arange(total) + np.repeat(lb - (np.cumsum(size) - size), size)
        keep = last[at] != 0
        both = np.sort((lf[at[keep]] << 31) | interval[keep])
        if not len(both):
            break
        to, interval = both >> 31, both & 0x7FFFFFFF
        ch = first[to]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (interval[1:] != interval[:-1]) | (ch[1:] != ch[:-1])
        start = np.flatnonzero(new)
        lb, rb = to[start], to[np.append(start[1:], len(to)) - 1]
        fresh_l, fresh_r = value[lb] < 0, value[rb + 1] < 0
        value[lb[fresh_l]] = level
        value[rb[fresh_r] + 1] = level
        fresh = fresh_l | fresh_r
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
    return value, rank


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, whether the window at each start occurs in another place."""
    text = np.zeros(sum(map(len, contexts)) + len(contexts), np.int64)
    at, bases = 0, []
    for c in contexts:
        text[at : at + len(c)] = np.frombuffer(c, np.uint8)
        text[at : at + len(c)] += 1
        bases.append(at)
        at += len(c) + 1
    value, rank = expand(text, length)
    again = (value[rank] < 0) | (value[rank + 1] < 0)
    return [again[b : b + len(c) - length + 1] for b, c in zip(bases, contexts)]


def settled(groups: list[list[tuple[int, bytes, int]]], length: int, fine: int) -> list[list[np.ndarray]]:
    """For each group (the different contexts of a key, as (times seen, bytes, offset of
    the anchor)) and context: whether the window at each start is repeated."""
    flags = [[np.zeros(len(body) - length + 1, bool) for _, body, _ in group] for group in groups]
    laid: dict[bytes, int] = {}
    open_: list[tuple[bytes, list[tuple[np.ndarray, int]]]] = []
    for group, marks in zip(groups, flags):
        finer: dict[tuple[int, bytes], dict[bytes, list]] = {}
        for (times, body, anchor), mark in zip(group, marks):
            if times > 1:
                mark[:] = True
            last = len(body) - length
            for g in range((anchor - last) // fine, anchor // fine + 1):
                lo, hi = max(0, anchor - g * fine - fine + 1), min(last, anchor - g * fine)
                core = body[anchor - g * fine : anchor - g * fine - fine + 1 + length]
                finer.setdefault((g, core), {}).setdefault(body[lo : hi + length], []).append((times, mark, lo))
        for kinds in finer.values():
            for part, places in kinds.items():
                if len(places) > 1 or places[0][0] > 1:
                    for _, mark, lo in places:
                        mark[lo : lo + len(part) - length + 1] = True
            if len(kinds) > 1:
                for part, places in kinds.items():
                    laid.setdefault(part, len(laid))
                    open_.append((part, [(mark, lo) for _, mark, lo in places]))
    if laid:
        found = repeated_windows(list(laid), length)
        for part, places in open_:
            for mark, lo in places:
                mark[lo : lo + len(part) - length + 1] |= found[laid[part]]
    return flags


def spans_of(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], windows, [False])).astype(np.int8)))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of consecutive rows with about SLICE bytes."""
    texts, first, size = [], 0, 0
    for k in range(batch.num_rows):
        text = (batch.column(text_at)[k].as_py() or "").encode()
        if texts and size + len(text) > SLICE:
            yield first, texts
            texts, first, size = [], k, 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, reach: int | None = None, most_contexts: int = 2000, block_bytes: int = 2 << 20, fine: int = 32, carry: tuple[str, ...] = (), with_text: bool = False
) -> DataFrame:
    """One row for each row: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_sha256``, and ``n_shared``: how many of its anchors are followed by
    ``length - reach + 1`` bytes that stand behind an anchor elsewhere too, so that
    passages too short to be removed are told as well; ``with_text`` adds ``kept_text`` (the remaining
    bytes, without characters that lost some of theirs) and ``spans`` ([from, to)); columns named in ``carry`` come along.

    A null text is empty and stays so.  Ids may be null or repeat; repeated rows are
    copies of one another like any.  Texts under ``length`` bytes lose nothing."""
    reach = reach or max(1, length * 16 // 25)
    core = length - reach + 1
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    @lean
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slices(batch, 1):
                joined = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                if not len(joined):
                    continue
                a, s1, s2 = anchors(np.frombuffer(joined, np.uint8), ends, length, reach)
                doc = np.searchsorted(ends, s1, side="right")
                rks = [row_key(ids[first + k], t) if len(t) >= length else b"" for k, t in enumerate(texts)]
                digest, a, s, e = xxhash.xxh3_64_intdigest, a.tolist(), s1.tolist(), (s2 + length).tolist()
                starts = np.concatenate(([0], ends[:-1]))[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([digest(joined[x : x + core]) for x in a], np.uint64).view(np.int64)),
                        pa.array(np.array([digest(joined[x:y]) for x, y in zip(s, e)], np.uint64).view(np.int64)),
                        pa.array([rks[k] for k in doc.tolist()], pa.binary()),
                        pa.array((s1 - starts).astype(np.int32)), pa.array((s2 - s1).astype(np.int32)), pa.array((np.array(a) - s1).astype(np.int32)),
                    ],
                    ["_key", "_ctx", "_rk", "_s", "_n", "_r"],
                )

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
            data = [pa.array([row_key(i, t or b"") for i, t in zip(ids, texts)], pa.binary()), pa.array([None if t is None else z.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(data + [batch.column(0), *batch.columns[2:]], ["_rk", "_z", *names])

    @lean
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for body, asked in zip(batch.column("_z"), batch.column("_asked")):
                text = z.decompress(body.as_py())
                out += [(x["_key"], x["_ctx"], x["_m"], x["_r"], text[x["_s"] : x["_s"] + x["_n"] + length]) for x in asked.as_py()]
                if len(out) > 4000:
                    yield contexts_batch(out)
                    out = []
            if out:
                yield contexts_batch(out)

    def contexts_batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.binary())], ["_key", "_ctx", "_m", "_r", "_body"])

    found_schema = "_key long, _ctx long, _spans array<struct<a:int,b:int>>"
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def found_batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x] for x in c[2]], span_type)], ["_key", "_ctx", "_spans"])

    @lean
    def expansion(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            groups: dict[int, list[tuple]] = {}
            for key, ctx, m, r, body in held:
                groups.setdefault(key, []).append((ctx, m, body, r))
            flags = settled([[x[1:] for x in g] for g in groups.values()], length, fine)
            out = [(key, x[0], spans_of(w, length)) for (key, g), ws in zip(groups.items(), flags) for x, w in zip(g, ws)]
            return found_batch([x for x in out if x[2]])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_key", "_ctx", "_m", "_r", "_body"))):
                if held and row[:2] == held[-1][:2]:  # a repeated row gives its contexts again
                    continue
                if held and row[0] != held[-1][0] and size > block_bytes:
                    yield settle()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settle()

    def parts_of(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        @lean
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each context, the parts with windows at up to ``width`` offsets from the anchor: a
            hash of what such windows share (_q), and one of the part (_h)."""
            for batch in batches:
                rows: list[tuple] = []
                for key, ctx, m, at, r, body in zip(*(batch.column(c).to_pylist() for c in ("_key", "_ctx", "_m", "_at", "_r", "_body"))):
                    last = len(body) - length
                    for g in range((r - last) // width, r // width + 1):
                        hi = r - g * width
                        lo = max(0, hi - width + 1)
                        part = body[lo : min(last, hi) + length]
                        core = body[hi : hi - width + 1 + length]
                        rows.append((xxhash.xxh3_64_intdigest(b"%d %d " % (key, g) + core) - (1 << 63), xxhash.xxh3_128_digest(part), key, ctx, m, at + lo, r - lo, part))
                    if len(rows) > 4000:
                        yield parts_batch(rows)
                        rows = []
                if rows:
                    yield parts_batch(rows)

        return parts

    def parts_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["_q", "_h", "_key", "_ctx", "_m", "_at", "_r", "_body"])

    @lean
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(x["a"], x["b"]) for x in some]) for some in batch.column("_spans").to_pylist()]
            yield found_batch(list(zip(batch.column("_key").to_pylist(), batch.column("_ctx").to_pylist(), spans)))

    def by_parts(some: DataFrame) -> DataFrame:
        """The repeated windows of contexts, whatever their number in a key."""
        left, marks = some.withColumn("_at", F.lit(0)), []
        for width in sorted({min(length, x) for x in (fine, max(1, fine // 8), 1)}, reverse=True):
            each = cut(left.mapInArrow(parts_of(width), "_q long, _h binary, _key long, _ctx long, _m long, _at int, _r int, _body binary"), "parts")
            one = [F.min(F.struct("_key", "_ctx", "_at", "_r", "_body")).alias("_one")] if width > 1 else []
            unlike = each.groupBy("_q", "_h").agg(F.sum("_m").alias("_m"), *one)
            unlike = cut(unlike, "kinds-of-parts") if width > 1 else unlike  # windows of one stretch are alike
            twice = unlike.filter("_m > 1").select("_q", "_h")
            marks.append(each.join(twice, ["_q", "_h"]).select("_key", "_ctx", F.col("_at").alias("a"), (F.col("_at") + F.octet_length("_body")).alias("b")))
            if width > 1:
                several = unlike.groupBy("_q").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")).filter("_lo != _hi").select("_q")
                left = unlike.join(several, "_q").select("_m", "_one.*")
        spans = functools.reduce(DataFrame.unionByName, marks).groupBy("_key", "_ctx").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
        return spans.mapInArrow(joined, found_schema)

    names = [id_col, *[c for c in carry if c not in (id_col, text_col)]]
    out_names = names + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"] + ["kept_text", "spans"] * with_text

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column("_z"), batch.column("_all")):
                body = body.as_py()
                text = b"" if body is None else z.decompress(body)
                runs = merged([(x["a"], x["b"]) for x in spans.as_py() or ()])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                left = b"".join(kept) + text[at:]
                rows.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), None if body is None else left.decode(errors="ignore"), runs))
            c = list(zip(*rows)) or [()] * 6
            data = [pa.array(x, pa.int64()) for x in c[:3]] + [pa.array(c[3], pa.string()), batch.column("n_shared").fill_null(0)]
            if with_text:
                data += [pa.array(c[4], pa.string()), pa.array(c[5], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + data, out_names)

    texts = df.select(id_col, text_col)
    occ = cut(texts.mapInArrow(occurrences, "_key long, _ctx long, _rk binary, _s int, _n int, _r int"), "anchors")
    keys = occ.groupBy("_key").agg(F.count("*").alias("_m"), F.min("_ctx").alias("_lo"), F.max("_ctx").alias("_hi"))
    keys = cut(keys.filter("_m > 1").select("_key", "_m", (F.col("_lo") != F.col("_hi")).alias("_mixed")), "repeated-keys")
    hot = keys.filter(F.col("_m") > max(1000, occ.count() // HOT_KEYS)).select("_key")  # HOT_KEYS rows at most
    keys = keys.drop("_m")
    spread = occ.join(F.broadcast(keys.join(F.broadcast(hot), "_key")), "_key").unionByName(occ.join(F.broadcast(hot), "_key", "left_anti").join(keys, "_key"))
    hits = cut(spread, "repeated-anchors")
    mixed = hits.filter("_mixed")
    kind = mixed.groupBy("_key", "_ctx").agg(F.count("*").alias("_m"), F.min(F.struct("_rk", "_s", "_n", "_r")).alias("_one"))
    large = kind.groupBy("_key").agg((F.count("*") > most_contexts).alias("_big"))
    kind = cut(kind.join(large, "_key"), "contexts")
    extra = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    docs = df.select(id_col, text_col, *names[1:]).mapInArrow(packed, f"_rk binary, _z binary, {extra}")

    def contexts(some: DataFrame) -> DataFrame:
        asked = some.groupBy(F.col("_one._rk").alias("_rk")).agg(F.collect_list(F.struct("_key", "_ctx", "_m", "_one._s", "_one._n", "_one._r")).alias("_asked"))
        return docs.join(asked, "_rk").select("_rk", "_z", *names, "_asked").mapInArrow(cut_out, "_key long, _ctx long, _m long, _r int, _body binary")

    found = contexts(kind.filter("not _big")).repartition("_key").sortWithinPartitions("_key", "_ctx").mapInArrow(expansion, found_schema)
    many = kind.filter("_big")
    if not many.isEmpty():
        found = found.unionByName(by_parts(contexts(many).dropDuplicates(["_key", "_ctx"])))
    sure = hits.filter("not _mixed").select("_rk", F.col("_s").alias("a"), (F.col("_s") + F.col("_n") + length).alias("b"))
    tried = mixed.join(found, ["_key", "_ctx"]).select("_rk", "_s", F.explode("_spans").alias("x")).select("_rk", (F.col("_s") + F.col("x.a")).alias("a"), (F.col("_s") + F.col("x.b")).alias("b"))
    shared = hits.groupBy("_rk").agg(F.count_distinct("_s").alias("n_shared"))
    spans = sure.unionByName(tried).groupBy("_rk").agg(F.collect_set(F.struct("a", "b")).alias("_all"))
    spans = shared.join(spans, "_rk", "left")
    schema = f"{extra}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", kept_text string, spans array<array<long>>" * with_text
    return docs.join(spans, "_rk", "left").mapInArrow(finish, schema)
