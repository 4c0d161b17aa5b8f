"""Packing of token ids into sequences by minimum bin slack.

A document longer than the capacity gives full sequences of its own and a rest; a
document that fits is one piece.  Rests and whole documents wait in a window of at
most ``window`` pieces.  For each sequence a subset-sum dynamic programme over
bitsets (bit t: some multiset of waiting lengths sums to t) finds the fill nearest
to the capacity, and backtracking over the bitsets gives how many pieces of each
length make it; the same multiset is used again as long as its counts last.  If
even the best fill leaves slack, a further piece is cut to close it.  What is left
at the end of a partition is cut into sequences whose lengths are powers of two,
which need no padding.

Each task packs its own partition, so nothing is shuffled and memory is bounded by
the window, whatever the keys or sources are.  A task that is run again gives its
sequences again as a whole: ids hold the partition's number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import lean

SLAB = 3 << 20
_LOADED: dict[str, "WordIds"] = {}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, ..., start + size - 1 of each run, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(total)
    return out


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] end to end."""
    return flat.take(spread(starts, sizes))


def ascii_lowered(texts: pa.Array) -> pa.Array:
    """Large strings without nulls with A to Z lowered, byte by byte."""
    if not len(texts):
        return texts
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    low = data | (((data - np.uint8(65)) < 26).view(np.uint8) << 5)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(low))


class WordIds:
    """Ids of many texts at a time, each distinct word encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its chunks between spaces, in order.  Most chunks are letters and a tail
    of punctuation, which it takes apart as well; ASCII letters it lowers.  The distinct
    words of a slab are encoded many at a time: the id that ends a word tells them apart
    again.  Words and their ids are kept in flat arrays of ``most`` bytes together, and
    begun anew beyond that; nothing else outlives a slab."""

    TAIL = ".,;:!?*%&$#()\"-"

    def __init__(self, path: str, most: int = 16 << 20):
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.most = path, Tokenizer.from_file(path), most
        self.forget()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def learned(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those kept, to which new ones are added."""
        if self.words.nbytes + self.flat.nbytes + self.sizes.nbytes > self.most:
            self.forget()
        at = pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False)
        new = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        fresh = words.filter(pa.array(new))
        out = np.where(new, 0, at).astype(np.int64)
        out[new] = len(self.words) + np.arange(len(fresh))
        if len(fresh):
            flat, sizes = self.joined(fresh.to_pylist())
            self.words = pa.concat_arrays([self.words, fresh])
            self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, sizes.astype(np.int32)))
        return out

    def single(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each by itself, end to end, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def joined(self, words: list[str], many: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, ``many`` in one line; lines that do not come
        out as one run with one end for each word are encoded word by word."""
        groups = [words[k : k + many] for k in range(0, len(words), many)]
        flat, sizes = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group):
                n = np.diff(last, prepend=0)
            else:
                ids, n = self.single(group)
            flat.append(ids)
            sizes.append(n)
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts (nulls are empty): ids of their distinct chunks end to end, how many
        each chunk has, the chunks of all texts in order, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(texts, " ")
        held = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = split.flatten().dictionary_encode()
        which, chunks = chunks.indices.to_numpy(), chunks.dictionary
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), held
        words = pc.utf8_rtrim(chunks, characters=self.TAIL)
        plain = pc.utf8_is_alpha(words)
        words = pc.if_else(plain, pc.if_else(pc.string_is_ascii(words), ascii_lowered(words), words), None).dictionary_encode()
        plain = plain.to_numpy(zero_copy_only=False)
        tails = pc.if_else(pa.array(plain), pc.replace_substring_regex(chunks, r"^[^" + re.escape(self.TAIL) + "]*", ""), chunks).dictionary_encode()
        places = np.append(self.learned(words.dictionary), -1)
        flat_t, size_t = self.single(tails.dictionary.to_pylist())
        flat = np.concatenate((self.flat, flat_t))
        size = np.concatenate((self.sizes, size_t, [0]))
        start = np.cumsum(size) - size
        first = places[words.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
        second = tails.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(self.sizes)
        parts = np.stack((first, second), axis=1).ravel()
        return gathered(flat, start[parts], size[parts]), size[first] + size[second], which, held

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        flat, size, which, held = self.chunked(texts)
        each = size[which]
        ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum(held)]
        return gathered(flat, (np.cumsum(size) - size)[which], each), np.diff(ends, prepend=0)

    def slabs(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of each text with the end id) for runs of rows of about SLAB bytes."""
        for a, part in slabs_of(texts):
            flat, n = self.encode(part)
            ends = np.cumsum(n)
            if end_id is not None:
                flat, ends = np.insert(flat, ends, end_id), ends + np.arange(1, len(n) + 1)
            yield a, np.split(flat, ends[:-1])


def slabs_of(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for runs of rows of about SLAB bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    slab = (np.cumsum(sizes) - 1).clip(0) // SLAB
    edges = np.concatenate(([0], np.flatnonzero(np.diff(slab)) + 1, [len(sizes)])) if len(sizes) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(a), texts.slice(a, b - a)


def word_ids(path: str | None) -> WordIds:
    """One tokenizer for each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is nearest to
    ``capacity`` from below: {length: how many}.  Longer lengths are tried first."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        steps.append((length, reach))
        left = min(counts[length], capacity // length)
        part = 1
        while left > 0:  # 1, 2, 4, ... copies at a time give every count up to the last
            part = min(part, left)
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
        if used:
            chosen[length] = used
    return chosen


class Packer:
    """The waiting pieces of one partition."""

    def __init__(self, capacity: int, window: int, first: int):
        self.capacity, self.window, self.sequence = capacity, window, first
        self.waiting: dict[int, list] = {}
        self.n, self.out = 0, []

    def emit(self, piece: tuple, offset: int) -> None:
        doc_id, start, ids, doc_tokens = piece
        self.out.append((doc_id, start, len(ids), zlib.crc32(ids.data), doc_tokens, self.sequence, offset, ids))

    def add(self, doc_id, ids: np.ndarray) -> None:
        """ids: of unsigned 32-bit numbers, little-endian."""
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self.emit((doc_id, at, ids[at : at + self.capacity], total), 0)
            self.sequence += 1
            at += self.capacity
        if at < total:
            self.wait((doc_id, at, ids[at:].copy(), total))
        if self.n >= self.window:
            while self.n > self.window // 2:
                self.fill()

    def wait(self, piece: tuple) -> None:
        self.waiting.setdefault(len(piece[2]), []).append(piece)
        self.n += 1

    def take(self, length: int) -> tuple:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
        self.n -= 1
        return piece

    def fill(self) -> None:
        chosen = best_fill({k: len(v) for k, v in self.waiting.items()}, self.capacity)
        exact = sum(k * used for k, used in chosen.items()) == self.capacity
        for _ in range(min(len(self.waiting[k]) // used for k, used in chosen.items()) if exact else 1):
            offset = 0
            for length, used in chosen.items():
                for _ in range(used):
                    self.emit(self.take(length), offset)
                    offset += length
            self.close(offset)

    def close(self, offset: int) -> None:
        """Fills the slack with the start of a further piece, if any waits."""
        while offset < self.capacity and self.n:
            doc_id, start, ids, total = self.take(max(self.waiting))
            room = self.capacity - offset
            self.emit((doc_id, start, ids[:room], total), offset)
            offset += min(room, len(ids))
            if len(ids) > room:
                self.wait((doc_id, start + room, ids[room:], total))
        self.sequence += 1

    def finish(self) -> None:
        while sum(k * len(v) for k, v in self.waiting.items()) >= self.capacity:
            self.fill()
        rest = [self.take(k) for k in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[k]))]
        left = sum(len(p[2]) for p in rest)
        while left:  # its binary digits, the largest first
            size = 1 << (left.bit_length() - 1)
            offset = 0
            while offset < size:
                doc_id, start, ids, total = rest.pop()
                room = size - offset
                self.emit((doc_id, start, ids[:room], total), offset)
                offset += min(room, len(ids))
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], total))
            self.sequence += 1
            left -= size


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, window: int = 4096, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: where it lies in its document and in which sequence.

    A null text counts as empty, and an empty text is the end id alone; ids may be
    null or repeat, each row is packed on its own; an empty table gives no rows.
    Only the two named columns are read, so other columns cannot clash.  ``with_ids``
    adds the piece's token ids as ``ids``."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 40)

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.out)) or [()] * 8
            data = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                data.append(pa.array([x.astype(np.int64) for x in cols[7]], pa.list_(pa.int64())))
                names.append("ids")
            packer.out = []
            return pa.RecordBatch.from_arrays(data, names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for first, texts in words.slabs(batch.column(1), end_id):
                for key, ids in zip(keys[first : first + len(texts)], texts):
                    packer.add(key, ids)
                yield rows()
        packer.finish()
        yield rows()

    return df.select(id_col, text_col).mapInArrow(task, schema)
