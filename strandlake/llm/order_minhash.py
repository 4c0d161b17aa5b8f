"""Near-duplicates by Order MinHash.

A text's k-mers are its shingles of five words (runs of letters and digits, lower
case), labelled by occurrence.  For each of ``functions`` hash functions the four least
labelled k-mers are kept in the order in which they stand in the text; each two of them,
in that order, are a key.  Texts agree on a key by sharing k-mers in the same order, which
follows edit similarity: of texts of 60 words and more with random edits that leave a
similarity of 0.8, over nine tenths of the pairs agree on a key, and nearly all at 0.85;
of shorter texts such edits can leave no shingle of five words whole.  Candidates are verified by
banded alignment: the edit distance of their word sequences, by bit vectors over a band that is as
wide as the similarity asked for allows.

Equal texts collapse first, by map-side aggregation.  Texts that agree on one key are
candidates, in keys of any size.  Alignment spares pairs whose ends are in one class
already: first each text meets the least text of its keys; then, while there are many pairs
left and that joins classes, each meets a few others of one of its keys; in the end all pairs of a key that are in different classes are compared.  Only what cannot
be near is left out: lengths that differ too much, and counts of words (in 512 classes of
words, which bound the edit distance from below) that do.  A large key is compared by
pairs of its blocks.  A pair is taken up in the least key that its texts share and in no
other, so it is written and aligned once however many keys it agrees on.  Pairs to align
are dealt by a grid of blocks of texts: a cell gets each of its texts once, not once a pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .packing import slabs_of
from .shared import cut, lean

MULT = np.uint64(0x9E3779B97F4A7C15)
CLASSES = 512
#: Least k-mers that are kept of each hash function.
LEAST = 4


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of letters and digits of all texts, lower case, and how many each has."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pN]+", " ")
    split = pc.split_pattern(plain, " ")
    words = split.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return words.filter(some).dictionary_encode(), np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULT
    h = (h ^ (h >> np.uint64(28))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(30))


def sketches(hashes: np.ndarray, sizes: np.ndarray, functions: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of texts whose word hashes lie end to end, text by text, and how many each has.
    sizes: words of each text, at least one.  A text under ``k`` words has one k-mer of all
    its words; a lone k-mer makes a key with itself."""
    n = len(hashes)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(n)
    shingle = np.zeros(n, np.uint64)
    for j in range(k):
        word = np.zeros(n, np.uint64)
        word[: n - j] = hashes[j:]
        word[left <= j] = 0
        shingle = mixed(shingle * np.uint64(31) + word)
    at = np.flatnonzero((left >= k) | ((np.repeat(sizes, sizes) < k) & (np.arange(n) == np.repeat(begin, sizes))))
    s, t = shingle[at], np.repeat(np.arange(len(sizes)), sizes)[at]
    order = np.lexsort((s, t))
    same = np.zeros(len(at), bool)
    same[1:] = (s[order][1:] == s[order][:-1]) & (t[order][1:] == t[order][:-1])
    run = np.arange(len(at))
    run = run - np.maximum.accumulate(np.where(same, 0, run))
    label = np.empty(len(at), np.uint64)
    label[order] = run
    label = mixed(s + label * MULT)
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    count = np.diff(np.append(first, len(at)))
    bits = np.uint64(max(1, int(len(at)).bit_length()))  # of a place in the slab
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(at), dtype=np.uint64)
    keys, owners = [], []
    for i in range(functions):
        h = (mixed(label ^ mixed(np.array([i + 1], np.uint64))) & ~low) | place
        kept = np.full((len(sizes), LEAST), len(at))
        for j in range(LEAST):
            some = count > j
            if some.any():
                x = (np.minimum.reduceat(h, first)[some] & low).astype(np.int64)
                kept[some, j] = x
                h[x] = np.uint64(0xFFFFFFFFFFFFFFFF)
        kept.sort(axis=1)
        for x in range(LEAST):
            for y in range(x + 1, LEAST):
                some = np.flatnonzero(count > y)
                keys.append(mixed(mixed(s[kept[some, x]] + np.uint64(i)) * np.uint64(31) + s[kept[some, y]]))
                owners.append(some)
        some = np.flatnonzero(count == 1)
        keys.append(mixed(mixed(s[kept[some, 0]] + np.uint64(i)) * np.uint64(31) + s[kept[some, 0]]))
        owners.append(some)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)  # equal k-mers can make one key twice
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], np.bincount(owners[new], minlength=len(sizes))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Levenshtein distance of two sequences of numbers if it is ``most`` or less."""
    if abs(len(a) - len(b)) > most:
        return None
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    start = int(differ[0]) if len(differ) else m
    a, b = a[start:], b[start:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    end = int(differ[0]) if len(differ) else m
    a, b = a[: len(a) - end], b[: len(b) - end]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)  # what is left of one text, no more than the lengths differ
    symbols, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    surplus = np.bincount(code[:n], minlength=len(symbols)) - np.bincount(code[n:], minlength=len(symbols))
    if max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()) > most:
        return None
    return aligned(code[:n].tolist(), code[n:].tolist(), most)


def aligned(a: list[int], b: list[int], most: int) -> int | None:
    """The same column by column, differences of neighbouring cells held as bits of one
    integer; rows that the band of ``most`` has not reached yet are added as it moves on.
    Ends as soon as the last cell cannot come back into the band."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    rows = min(len(a), most)  # of the first column that lie in the band
    full = (1 << rows) - 1
    up, down, score = full, 0, rows
    for j, y in enumerate(b):
        if rows < len(a):  # the next row enters, its cell one more than the one above
            up |= 1 << rows
            rows += 1
            score += 1
            full = full << 1 | 1
        here = places.get(y, 0) & full
        across = (((here & up) + up) ^ up) | here
        along = here | down
        plus = (down | ~(across | up)) & full
        minus = up & across
        last = 1 << rows - 1
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up = (minus | ~(along | plus)) & full
        down = plus & along
        if score - (len(b) - j - 1) - (len(a) - rows) > most and rows == len(a):
            return None
    return score if score <= most else None


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words beside each other, and how often each stands there."""
    return np.unique(words[:-1] * MULT + mixed(words[1:]), return_counts=True)


def alike(a: np.ndarray, b: np.ndarray, similarity: float, beside: tuple | None = None) -> bool:
    """Whether two sequences of word hashes have that edit similarity; ``beside``: the
    neighbours of both, where they are known."""
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    (pa_, ca), (pb, cb) = beside or (neighbours(a), neighbours(b))
    _, i, j = np.intersect1d(pa_, pb, assume_unique=True, return_indices=True)
    if np.minimum(ca[i], cb[j]).sum() < longest - 1 - 2 * most:  # an edit takes two pairs of neighbours at most
        return False
    return edit_distance(a, b, most) is not None


def word_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of each text by class of word, 255 at most: (texts, CLASSES)."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = np.bincount(text * CLASSES + (hashes % np.uint64(CLASSES)).astype(np.int64), minlength=len(sizes) * CLASSES)
    return np.minimum(n, 255).astype(np.uint8).reshape(-1, CLASSES)


def may_be_near(counts: np.ndarray, sizes: np.ndarray, own: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Which texts can be near to one text: each edit changes how far one text's counts
    exceed the other's by one at most, in all classes and in sums of eight of them."""
    most = ((1 - similarity) * np.maximum(sizes, size) + 1e-9).astype(np.int64)
    out = np.abs(sizes - size) <= most
    for fold in (8, 1):
        at = np.flatnonzero(out)
        if not len(at):
            break
        some, one = counts[at], own
        if fold > 1:
            some, one = some.reshape(len(at), -1, fold).sum(axis=2, dtype=np.uint16), own.reshape(-1, fold).sum(axis=1, dtype=np.uint16)
        both = np.minimum(some, one).sum(axis=1, dtype=np.int64)
        out[at] = np.maximum(some.sum(axis=1, dtype=np.int64), int(one.sum(dtype=np.int64))) - both <= most[at]
    return out


def shares_less(keys: np.ndarray, own: np.ndarray, key: int) -> np.ndarray:
    """Which rows of keys hold one of ``own`` that is less than ``key``."""
    less = own[own < key]  # ascending
    if not len(less) or not len(keys):
        return np.zeros(len(keys), bool)
    return (less[np.searchsorted(less, keys).clip(max=len(less) - 1)] == keys).any(axis=1)


def joined(links: Iterator[tuple], batch: int = 50_000) -> Iterator[list[tuple]]:
    """Pairs (node, least node of its component) of all links, by union and find."""
    up: dict = {}

    def root(x: object) -> object:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
        up[max(a, b)] = min(a, b)
    names = list(up)
    for at in range(0, len(names), batch):
        yield [(x, root(x)) for x in names[at : at + batch]]


def components(links: DataFrame, one_task: int = 1 << 18) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for links (a, b), a < b.

    Up to ``one_task`` links, some megabytes, are joined in one task without a shuffle.
    More alternate large stars (greater neighbours move to the least) and small stars
    (lesser neighbours move to the least) until only stars are left; each round is
    written to the shared folder, and nothing but that answer reaches the driver."""
    kinds = ", ".join(f"{x} {links.schema['a'].dataType.simpleString()}" for x in ("node", "root"))
    if links.count() <= one_task:

        @lean
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for some in joined(ends):
                node, root = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(node, batch_type), pa.array(root, batch_type)], ["node", "root"])

        batch_type = to_arrow_type(links.schema["a"].dataType)
        return links.select("a", "b").coalesce(1).mapInArrow(join, kinds)
    edges = cut(links.select("a", "b").distinct(), "links")
    while True:
        ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("n"), F.lit(1).alias("leaf")))
        ends = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("only"))
        if ends.filter("leaf > 1 or (leaf = 1 and only = 0)").isEmpty():  # every greater node hangs on one root alone
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a != b").distinct()
        large = large.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("x"), "_m").unionByName(small.select(F.col("a").alias("x"), "_m")).filter("x != _m").select(F.col("_m").alias("a"), F.col("x").alias("b")).distinct()
        edges = cut(small, "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, functions: int = 9, k: int = 5, most: int = 1000, look: int = 8, few: int = 8, rounds: int = 3) -> DataFrame:
    """One row for each row with its class: id, ``class_id`` (the least id in it),
    ``n_links`` (texts other than its own that alignment linked it with, as far as
    links were needed to find the class), ``text_hash``.

    Two texts are linked if their word sequences have an edit similarity (1 - distance
    / longer length) of ``similarity`` at least; classes are connected components.
    Equal texts are one class.  A null text is in a class of its own; texts without a
    word are near only to equal texts.  Ids may be null (least) or repeat; an empty table
    gives no rows.  Other columns are not read.  ``look``: pairs a row that are looked
    through in the last step; while there would be more, and while that joins classes, each
    text first meets ``few`` others of one of its keys, in ``rounds`` rounds at most."""
    text = F.col(text_col)
    own = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.md5(text.cast("binary"))).alias("_h"))

    def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, sizes = words_of(texts)
        each = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
        return each[words.indices.to_numpy()] if len(each) else np.zeros(0, np.uint64), sizes

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slabs_of(batch.column(1)):
                flat, sizes = hashes_of(some)
                has = np.flatnonzero(sizes)
                keys: list = [None] * len(some)
                counts: list = [None] * len(some)
                if len(has):
                    found, n = sketches(flat, sizes[has], functions, k)
                    for i, row, c in zip(has.tolist(), np.split(found, np.cumsum(n)[:-1]), word_counts(flat, sizes[has])):
                        keys[i], counts[i] = row.tobytes(), c.tobytes()
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary())], ["_id", "_h", "_keys", "_words", "_counts"])

    id_sql = df.schema[id_col].dataType.simpleString()
    rows = cut(own.mapInArrow(sketch, f"_id {id_sql}, _h binary, _keys binary, _words int, _counts binary"), "sketches")
    texts = rows.filter("_h is not null").groupBy("_h").agg(F.min("_id").alias("_rep"), F.first("_keys").alias("_keys"), F.first("_words").alias("_words"), F.first("_counts").alias("_counts"), F.max(F.col("_id").isNull()).alias("_null"))
    texts = cut(texts, "distinct-texts")

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            n = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            which = pa.array(np.repeat(np.arange(len(n)), n))
            flat = np.frombuffer(b"".join(keys.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(which), batch.column(2).take(which)], ["_key", "_h", "_words"])

    member = texts.filter("_keys is not null").select("_h", "_keys", "_words").mapInArrow(spread, "_key long, _h binary, _words int")
    counted = member.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    shared = cut(member.join(counted, "_key"), "shared-keys")
    asked = shared.select("_h").distinct()

    @lean
    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of different classes that may be near, of one block or of two, where the
        key is the least that both have: texts of different classes meet in all they share."""
        held: list[tuple] = []

        def settle() -> set[tuple[bytes, bytes]]:
            ids, (_, i, j) = [x[1] for x in held], held[0][0]
            blocks, sizes = np.array([x[2] for x in held]), np.array([x[3] for x in held])
            number = {r: n for n, r in enumerate({x[4] for x in held})}
            roots = np.array([number[x[4]] for x in held])
            counts = np.frombuffer(b"".join(x[5] for x in held), np.uint8).reshape(-1, CLASSES)
            own = [np.sort(np.frombuffer(x[6], np.int64)) for x in held]
            widest = max(map(len, own))
            keys = np.array([np.append(x, np.repeat(x[-1], widest - len(x))) for x in own])
            out = set()
            for x in range(len(held) - 1):
                at = x + 1 + np.flatnonzero((roots[x + 1 :] != roots[x]) & ((blocks[x + 1 :] != blocks[x]) | (i == j)))
                if len(at):
                    at = at[may_be_near(counts[at], sizes[at], counts[x], int(sizes[x]), similarity)]
                    for y in at[~shares_less(keys[at], own[x], held[x][0][0])].tolist():
                        out.add((min(ids[x], ids[y]), max(ids[x], ids[y])))
            return out

        out: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("_key", "_i", "_j", "_h", "_block", "_words", "_root", "_counts", "_keys"))):
                if held and (key, i, j) != held[0][0]:
                    out |= settle()
                    held = []
                    if len(out) > 20_000:
                        yield pairs_batch(list(out))
                        out = set()
                held.append(((key, i, j), *row))
        yield pairs_batch(list(out | settle() if held else out))

    @lean
    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("_h", "_lh"))
            wa, wb = (batch.column(c).to_numpy() for c in ("_words", "_lwords"))
            ca, cb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES) for c in ("_counts", "_lcounts"))
            keep = [bool(may_be_near(ca[i : i + 1], wa[i : i + 1], cb[i], int(wb[i]), similarity)[0]) for i in range(len(a))]
            yield pairs_batch([(min(x, y), max(x, y)) for x, y, z in zip(a, b, keep) if z])

    def pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([z.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["_h", "_z"])

    bodies = own.filter("_text is not null").mapInArrow(packed, "_h binary, _z binary").join(asked, "_h", "left_semi").groupBy("_h").agg(F.first("_z").alias("_z"))
    bodies = cut(bodies, "texts")

    @lean
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell: its texts (``_z``), then its pairs."""
        z = zstandard.ZstdDecompressor()
        bodies: dict[bytes, bytes] = {}
        words: dict[bytes, tuple] = {}
        cell, waiting, links = None, [], []

        def settle() -> None:
            for at in range(0, len(waiting), 200):
                some = waiting[at : at + 200]
                if sum(x.nbytes for x, _ in words.values()) > 32 << 20:
                    words.clear()
                names = list({x for pair in some for x in pair} - words.keys())
                texts = pa.array([z.decompress(bodies[x]).decode() for x in names], pa.large_string())
                for first, part in slabs_of(texts):
                    flat, sizes = hashes_of(part)
                    words.update((x, (w, neighbours(w))) for x, w in zip(names[first : first + len(part)], np.split(flat, np.cumsum(sizes)[:-1])))
                for x, y in some:
                    (wx, nx), (wy, ny) = words[x], words[y]
                    if alike(wx, wy, similarity, (nx, ny)):
                        links.append((x, y))
            waiting.clear()

        for batch in batches:
            for c, a, b, body in zip(*(batch.column(k).to_pylist() for k in ("_cell", "a", "b", "_z"))):
                if c != cell:
                    settle()
                    bodies.clear()
                    words.clear()
                    cell = c
                if body is None:
                    waiting.append((a, b))
                else:
                    bodies[a] = body
            if len(links) > 20_000:
                yield pairs_batch(links)
                links.clear()
        settle()
        yield pairs_batch(links)

    def verified(some: DataFrame, n: int) -> DataFrame:
        """Which of ``n`` pairs are alike: about 500 in a cell of a grid over texts."""
        side = math.ceil(math.sqrt(max(1, n) / 500))
        block = lambda x: F.pmod(F.xxhash64(F.lit(41), x), F.lit(side))
        celled = some.select((block("a") * side + block("b")).alias("_cell"), "a", "b")
        asked = celled.select("_cell", "a").unionByName(celled.select("_cell", F.col("b").alias("a"))).distinct()
        held = asked.join(bodies.select(F.col("_h").alias("a"), "_z"), "a").select("_cell", "a", F.lit(None).cast("binary").alias("b"), "_z")
        dealt = held.unionByName(celled.withColumn("_z", F.lit(None).cast("binary"))).withColumn("_last", F.col("_z").isNull())
        dealt = dealt.repartition(min(4096, max(8, n // 1000)), "_cell").sortWithinPartitions("_cell", "_last")
        return dealt.select("_cell", "a", "b", "_z").mapInArrow(align, "a binary, b binary")

    pair_sql = "a binary, b binary"
    similar = F.least("_words", "_least._words") >= F.greatest("_words", "_least._words") * similarity - 1e-9
    least = shared.groupBy("_key").agg(F.min(F.struct("_h", "_words")).alias("_least"))
    first = shared.join(least, "_key").filter(similar & (F.col("_h") != F.col("_least._h"))).groupBy(F.col("_h").alias("b")).agg(F.min("_least._h").alias("a")).select("a", "b")
    known = texts.select("_h", "_words", "_counts")
    own_counts = known.select(F.col("_h").alias("b"), "_words", "_counts")
    least_counts = known.select(F.col("_h").alias("a"), F.col("_words").alias("_lwords"), F.col("_counts").alias("_lcounts"))
    first = first.join(own_counts, "b").join(least_counts, "a").select(F.col("b").alias("_h"), F.col("a").alias("_lh"), "_words", "_lwords", "_counts", "_lcounts")
    tried = cut(first.mapInArrow(led, pair_sql).distinct(), "pairs")
    links = cut(verified(tried, tried.count()), "aligned")
    roots = cut(components(links), "roots")
    left = shared
    turn, yielded = 0, True
    while True:
        left = left.drop("_root").join(roots.select(F.col("node").alias("_h"), F.col("root").alias("_root")), "_h", "left").withColumn("_root", F.coalesce("_root", "_h"))
        mixed = left.groupBy("_key").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count("*").alias("_n")).filter("_lo != _hi").select("_key", "_n")
        left = cut(left.drop("_n").join(mixed, "_key"), "open-keys")
        sizes = left.groupBy("_key", "_root").agg(F.count("*").cast("double").alias("c")).groupBy("_key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
        rows_left, open_pairs = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("q")) / 2).first()
        if not open_pairs:
            break
        # meeting a few only joins classes that the last step would compare in full; it leaves out no pair
        last = open_pairs <= look * rows_left or not yielded or turn == rounds
        if last:
            blocks = F.ceil(F.col("_n") / most).cast("int")
            dealt = left.join(texts.select("_h", "_counts", "_keys"), "_h").withColumn("_block", F.pmod(F.xxhash64("_h"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.select("_key", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_h", "_block", "_words", "_root", "_counts", "_keys")
            pairs = dealt.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j").mapInArrow(crossed, pair_sql)
        else:
            body = F.struct("_h", "_root", "_words", "_counts")
            chosen = left.groupBy("_h").agg(F.max(F.struct(F.col("_n") if turn == 0 else F.xxhash64(F.lit(turn), "_key"), "_key", F.col("_n").alias("n"))).alias("_p"), F.first("_root").alias("_root"), F.first("_words").alias("_words"))
            chosen = chosen.join(texts.select("_h", "_counts"), "_h").withColumn("_x", body).select(F.col("_p._key").alias("_key"), F.pmod(F.xxhash64(F.lit(turn), "_h"), F.ceil(F.col("_p.n") / most)).alias("_b"), "_x")
            ahead = Window.partitionBy("_key", "_b").orderBy(F.xxhash64(F.lit(turn + 1), "_x._h")).rowsBetween(1, few)
            met = chosen.withColumn("_ys", F.collect_list("_x").over(ahead)).select("_x", F.explode("_ys").alias("_y")).filter("_x._root != _y._root")
            met = met.select("_x._h", "_x._words", "_x._counts", F.col("_y._h").alias("_lh"), F.col("_y._words").alias("_lwords"), F.col("_y._counts").alias("_lcounts"))
            pairs = met.mapInArrow(led, pair_sql)
        pairs = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        n_pairs = pairs.count()
        more = cut(verified(pairs, n_pairs), "aligned")
        found = more.count()
        links = links.unionByName(more)
        if found:
            roots = cut(components(links), "roots")
        if last:
            break
        yielded = found > 0.05 * n_pairs
        tried, turn = tried.unionByName(pairs), turn + 1
    degree = links.select(F.col("a").alias("_h")).unionByName(links.select(F.col("b").alias("_h"))).groupBy("_h").agg(F.count("*").alias("n_links"))
    known = texts.select("_h", "_rep", "_null").join(roots.withColumnRenamed("node", "_h"), "_h", "left").withColumn("_root", F.coalesce("root", "_h"))
    classes = known.groupBy("_root").agg(F.min("_rep").alias("class_id"), F.max("_null").alias("_null")).withColumn("class_id", F.when(~F.col("_null"), F.col("class_id")))
    by_text = known.select("_h", "_root").join(classes.select("_root", "class_id"), "_root").join(degree, "_h", "left").select("_h", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    labelled = rows.select("_id", "_h").filter("_h is not null").join(by_text, "_h")
    alone = rows.filter("_h is null").select("_h", "_id", F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return labelled.select("_h", "_id", "class_id", "n_links").unionByName(alone).select(F.col("_id").alias(id_col), "class_id", "n_links", F.col("_h").alias("text_hash"))
