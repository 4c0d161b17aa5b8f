"""Benchmark passages in documents, by fingerprints of item-sized windows.

An item of n words has n - 4 shingles of five words (an item under five words has one
of all its words).  A shingle of an item weighs 1 / (number of different texts of the
whole benchmark that hold it); one that the item lacks weighs the item's mean at most.
Where a document has a shingle of an item, all windows of the item's size over that place get
a 64-bit SimHash of their weighted shingles.  An index over the items' fingerprints in
eight blocks of eight bits lists, for each block and value, the items within two bits
there: two fingerprints within 23 bits differ by two bits or less in some block, so
every item within the radius is met.  Those are verified by the exact weighted Jaccard
similarity of the window's and the item's shingles, with multiplicity.

A window without a shingle of the item has similarity 0, so looking only near shared
shingles loses nothing.  Documents are scanned once for each ``item_bytes`` of
benchmark text, and written between, so that a task holds one index at a time; beside it the broadcast index holds the shingles that several texts of
the whole benchmark share.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .shared import cut, lean

WORD = re.compile(r"[^\W_]+")
MULT = np.uint64(0x9E3779B97F4A7C15)
ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULT
    return h ^ (h >> np.uint64(29))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; the last k - 1 positions have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(31) + hashes[j : j + n])
    return out


def votes(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(mixed(shingle ^ np.uint64(0xD6E8FEB86659FD93)).view(np.uint8).reshape(-1, 8), axis=1)
    return (bits * 2.0 - 1.0) * weight[:, None]


class Index:
    """Items by size: their fingerprints in blocks, their shingles and weights."""

    def __init__(self, items: list[tuple[int, str]], radius: int = 23, times: dict[tuple[int, int], int] | None = None):
        """times: how many different texts hold a shingle, where over one; by default counted here."""
        self.radius = min(radius, 23)
        self.items, df, texts = [], Counter(), set()
        for item_id, text in items:
            words = words_of(text)
            if words:
                k = min(5, len(words))
                s = shingles(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), k)
                self.items.append((item_id, k, s, Counter(s.tolist()), len(words)))
                df.update({(k, x) for x in s.tolist()} if text not in texts else ())
                texts.add(text)
        self.weight = {key: 1.0 / (n if times is None else times.get(key, 1)) for key, n in df.items()} | {key: 1.0 / n for key, n in (times or {}).items()}
        self.orders = sorted({x[1] for x in self.items})
        self.known, self.bitmap, self.sizes_of = {}, {}, {}
        for k in self.orders:
            sizes: dict[int, set[int]] = defaultdict(set)
            for _, kk, s, _, _ in self.items:
                if kk == k:
                    for x in s.tolist():
                        sizes[x].add(len(s))
            self.known[k] = np.array(sorted(sizes), np.uint64)
            self.bitmap[k] = np.zeros(1 << 20, bool)
            self.bitmap[k][(self.known[k] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.sizes_of[k] = {x: sorted(v) for x, v in sizes.items()}
        self.mean = [float(self.weights(x[1], x[2], 1.0).mean()) for x in self.items]
        self.groups: dict[tuple[int, int, float], list[int]] = defaultdict(list)
        for at, x in enumerate(self.items):  # of one size and about one mean, by which windows are printed
            self.groups[x[1], len(x[2]), 2.0 ** (round(4 * np.log2(self.mean[at])) / 4)].append(at)
        self.means: dict[tuple[int, int], list[float]] = defaultdict(list)
        for k, size, mean in self.groups:
            self.means[k, size].append(mean)
        self.prints, self.near = {}, {}
        for key, members in self.groups.items():
            p = np.stack([self.fingerprint(key[0], self.items[m][2], key[2]) for m in members])
            self.prints[key] = p
            self.near[key] = [[np.flatnonzero(ONES[p[:, b] ^ v] <= 2) for v in range(256)] for b in range(8)]

    def weights(self, k: int, s: np.ndarray, other: float) -> np.ndarray:
        return np.array([self.weight.get((k, x), other) for x in s.tolist()])

    def fingerprint(self, k: int, s: np.ndarray, other: float) -> np.ndarray:
        return np.packbits(votes(s, self.weights(k, s, other)).sum(axis=0) > 0)

    def present(self, k: int, s: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item holds."""
        at = np.flatnonzero(self.bitmap[k][(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return at[np.isin(s[at], self.known[k])]

    def hits(self, k: int, s: np.ndarray, at: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window, the first of equals."""
        wanted: dict[int, set[int]] = defaultdict(set)
        for p in at.tolist():
            for size in self.sizes_of[k][int(s[p])]:
                m = min(size, len(s))
                wanted[size].update(range(max(0, p - m + 1), min(p, len(s) - m) + 1))
        best: dict[int, tuple[float, int, int]] = {}
        for size, starts in wanted.items():
            m = min(size, len(s))
            first = np.array(sorted(starts))
            lo, hi = int(first[0]), int(first[-1]) + m
            region = s[lo:hi]
            for mean in self.means[k, size]:
                total = np.concatenate((np.zeros((1, 64)), np.cumsum(votes(region, self.weights(k, region, mean)), axis=0)))
                prints = np.packbits(total[first - lo + m] - total[first - lo] > 1e-9, axis=1)
                table, own = self.near[k, size, mean], self.prints[k, size, mean]
                for f, start in zip(prints, first.tolist()):
                    met = np.unique(np.concatenate([table[b][f[b]] for b in range(8)]))
                    met = met[ONES[own[met] ^ f].sum(axis=1) <= self.radius] if len(met) else met
                    for j in met.tolist():
                        member = self.groups[k, size, mean][j]
                        item_id, _, _, counts, n_words = self.items[member]
                        sim = self.similarity(k, Counter(s[start : start + m].tolist()), counts, self.mean[member])
                        if sim >= threshold and sim > best.get(item_id, (0,))[0]:
                            best[item_id] = (sim, start, m + k - 1)
        return best

    def similarity(self, k: int, a: Counter, b: Counter, mean: float) -> float:
        low = high = 0.0
        for x in a.keys() | b.keys():
            w = self.weight[k, x] if x in b else min(mean, self.weight.get((k, x), mean))
            low += w * min(a[x], b[x])
            high += w * max(a[x], b[x])
        return low / high


def benchmark_hits(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, radius: int = 23, item_bytes: int = 4 << 20, hits_col: str = "hits"
) -> DataFrame:
    """``df`` with ``hits_col``: for each benchmark item found its id, similarity, first
    word and number of words of the best window, in the order of ids.

    Words are runs of letters and digits, lower-cased.  Texts that are null or hold no
    word and items without a word have no hits; an empty benchmark gives none.
    Rows of one id (null is one too) give one hit, the best; ids are of any type that has
    an order.  All columns of ``df`` stay as they are; one named like ``hits_col`` is an error."""
    if hits_col in df.columns:
        raise ValueError(f"the input has a column named {hits_col}; name another in hits_col")
    kind = benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("_item"), F.coalesce(item_text, F.lit("")).alias("_text"))

    @lean
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                k = min(5, len(words))
                s = np.unique(shingles(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), k)) if words else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([text] * len(s), pa.string()), pa.array([k] * len(s), pa.int32()), pa.array(s.view(np.int64))], ["_text", "_k", "_s"])

    holds = items.select("_text").distinct().mapInArrow(held, "_text string, _k int, _s long")
    several = holds.groupBy("_k", "_s").agg(F.count("*").alias("_n")).filter("_n > 1")
    times = {(r["_k"], r["_s"] % 2**64): r["_n"] for r in several.toLocalIterator()}  # only what several texts of the benchmark hold
    block: list[tuple] = []
    size = 0
    for item, text in items.orderBy("_item", "_text").toLocalIterator():
        if size + len(text) > item_bytes and block:
            df = cut(_with_hits(df, block, text_col, threshold, radius, times, kind, hits_col), "benchmark-block")  # one index at a time in a task
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    return _with_hits(df, block, text_col, threshold, radius, times, kind, hits_col)


def _with_hits(df: DataFrame, items: list[tuple], text_col: str, threshold: float, radius: int, times: dict[tuple[int, int], int], kind: DataType, hits_col: str) -> DataFrame:
    index = df.sparkSession.sparkContext.broadcast(Index(items, radius, times))  # at most item_bytes of text and its shingles
    again = hits_col in df.columns
    names = [c for c in df.columns if c != hits_col]
    hit_type = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("similarity", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = index.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if len(cache) > 500_000:
                    cache.clear()
                words = [words_of(t.as_py()) for t in part.column(names.index(text_col))]
                cache.update({w: xxhash.xxh3_64_intdigest(w) for w in set().union(*words) - cache.keys()})
                flat = np.fromiter((h for ws in words for h in map(cache.__getitem__, ws)), np.uint64)
                ends = np.cumsum([len(ws) for ws in words])
                starts = np.concatenate(([0], ends[:-1]))
                found: list[dict] = [{} for _ in words]
                for k in model.orders:
                    s = shingles(flat, k)
                    hit = model.present(k, s)
                    doc = np.searchsorted(ends, hit, side="right")
                    inside = hit + k <= ends[doc] if len(hit) else np.zeros(0, bool)
                    hit, doc = hit[inside], doc[inside]
                    for d in np.unique(doc).tolist():
                        own = s[starts[d] : ends[d] - k + 1]
                        for item, x in model.hits(k, own, hit[doc == d] - starts[d], threshold).items():
                            if x > found[d].get(item, (0,)):
                                found[d][item] = x
                if again:
                    for f, old in zip(found, part.column(len(names)).to_pylist()):
                        for x in old:
                            if x["similarity"] >= f.get(x["item_id"], (0,))[0]:
                                f[x["item_id"]] = (x["similarity"], x["start"], x["words"])
                order = lambda x: (x[0] is not None, 0 if x[0] is None else x[0])
                rows = [[{"item_id": i, "similarity": x[0], "start": x[1], "words": x[2]} for i, x in sorted(f.items(), key=order)] for f in found]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(rows, hit_type)], [*names, hits_col])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{hits_col}` array<struct<item_id:{kind.simpleString()},similarity:double,start:bigint,words:bigint>>"
    return df.select(*names, *([hits_col] if again else [])).mapInArrow(task, schema)


def contaminated(hits_col: str = "hits") -> Column:
    return F.size(hits_col) > 0
