"""Scores of texts by a causal self-attention model, beside a unigram base.

The model reads subword ids of a public tokenizer.  One masked self-attention layer
over a window of ids predicts the next id in three steps, a group of classes, a class of
the group and the id of the class, the last by its count in all training texts:

    A(id | earlier ids) = softmax(U h + a)[group] * softmax(U_group h + a')[class] * (n(id) + 1/2) / sum over the class,

where a and a' are the log shares of groups and classes after the last id, counted over
all neighbours in all training texts, across words too.  Within words this is joined
with what a tree of the commonest words says, by absolute discounting:

    P(id | earlier ids) = max(n(word so far, id) - D, 0) / n(word so far) + left(word so far) * A(id | earlier ids),

where ``left`` is the mass that the discount D frees there; where the word so far is not in
the tree, it is one.

Windows of a text overlap: each starts ``stride`` ids after the last one, and scores
the ids that no window before it did, each with at least ``window - stride`` ids of
context (the first window with what there is).  Windows of many texts are computed
as one batch of masked attention.  Every text ends with an end id, which is scored.

Everything the model holds is learned from all training texts, whole.  Their ids are
written once; passes over them count ids, then the commonest ids beside each other id, by
which ids are grouped in classes, then neighbours by class.  Last, trainers read every
window of every text, and the mean of their weights, by windows read, is the model.  They
all go on from weights fitted to a few runs (``fit_rows`` texts of least hash, at most
``fit_ids`` ids of each): a mean of weights makes sense only from one start.

Word counts for the base are needed by every text.  At most ``frequent`` words, the
commonest, are broadcast; all other words of a text, the rare ones, leave the scoring pass
with it and are joined with their counts as rows of (text, word, times).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import WordIds, ascii_lowered, gathered, slabs_of, spread, word_ids
from .shared import cut, freed, lean, least_hashed
from .suffix_dedup import row_key

GROUP = 16
#: The commonest ids, by which the neighbourhoods of others are told.
MARKS = 96
#: Windows of a step of the trainers.
BATCH = 128
#: Ids that are scored at a time, but for longer texts: a worker's memory grows with them.
RUN = 1 << 17


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A to Z lowered, of all texts, and the text of each."""
    texts = ascii_lowered(pc.fill_null(texts.cast(pa.large_string()), ""))
    for space in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, space, " ")
    split = pc.split_pattern(texts, " ")
    words = split.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), text[some.to_numpy(zero_copy_only=False)]


class WordTree:
    """Subword ids of known words as a tree: from the root, the ids of a word lead from
    node to node; an id that ends a word leads nowhere.  Of a word's first id it says nothing."""

    def __init__(self, flat: np.ndarray, times: np.ndarray, ends: np.ndarray, discount: float = 0.75):
        """flat: words' ids end to end, each ending with one of ``ends`` (by id); times: how
        often the word of each id was seen."""
        self.ends = ends
        n = len(ends)
        node = np.full(len(flat), -1)
        node[np.flatnonzero(np.append(True, ends[flat[:-1]]))[: len(flat)]] = 0
        keys, counts, children, known = [], [], [], 1
        live = np.flatnonzero(node == 0)
        while len(live):
            key, where = np.unique(node[live] * n + flat[live], return_inverse=True)
            keys.append(key)
            counts.append(np.bincount(where, times[live]))
            children.append(known + np.arange(len(key)))
            known += len(key)
            on = live[~ends[flat[live]] & (live + 1 < len(flat))]
            node[on + 1] = children[-1][where[np.isin(live, on, assume_unique=True)]]
            live = on + 1
        key, count, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts, children))
        order = np.argsort(key)
        self.key, count, self.child = key[order], count[order], child[order]
        parent = self.key // n
        whole = np.bincount(parent, count, known)
        kept = np.where(parent > 0, np.maximum(count - discount, 0), 0)
        self.share = (kept / whole[parent].clip(1e-9)).astype(np.float32)
        held = np.bincount(parent, kept, known)
        self.left = np.where(whole > 0, 1 - held / whole.clip(1e-9), 1).clip(1e-9, 1).astype(np.float32)

    def read(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ids end to end (``first``: where texts begin): what the tree gives each, and
        the mass it leaves to others there."""
        share, left = np.zeros(len(flat), np.float32), np.ones(len(flat), np.float32)
        if not len(flat) or not len(self.key):
            return share, left
        begin = np.append(True, self.ends[flat[:-1]])
        begin[first] = True
        live, node = np.flatnonzero(begin), np.zeros(int(begin.sum()), np.int64)
        while len(live):
            left[live] = self.left[node]
            want = node * len(self.ends) + flat[live]
            at = np.searchsorted(self.key, want).clip(0, len(self.key) - 1)
            hit = self.key[at] == want
            share[live[hit]] = self.share[at[hit]]
            on = hit & (live + 1 < len(flat))
            live, node = live[on] + 1, self.child[at[on]]
            go = ~begin[live]
            live, node = live[go], node[go]
        return share, left


class AttentionModel:
    """Weights are float32; at most (inputs + classes) * width and some small matrices."""

    def __init__(
        self, counts: np.ndarray, runs: list[np.ndarray], classes: int = 256, inputs: int = 2048, width: int = 24, window: int = 32, stride: int = 24, seed: int = 9, beside: np.ndarray | None = None
    ):
        """counts: of the ids; the last id is the end; beside: cells of ``cells_beside``
        with their counts, taken from ``runs`` where it is not given."""
        self.window, self.stride, self.seed, self.width = window, stride, seed, width
        n = len(counts)
        rng = np.random.default_rng(seed)
        self.groups = -(-classes // GROUP)
        if beside is None:
            flat, sizes = np.concatenate([*runs, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(r) for r in runs], np.int64)
            beside = np.stack(np.unique(cells_beside(flat, sizes, *marked(counts, classes)), return_counts=True))
        self.class_of = self.classify(counts, beside, classes)
        self.classes = self.groups * GROUP
        order = np.argsort(-counts, kind="stable")
        self.input_of = inputs + self.class_of
        self.input_of[order[:inputs]] = np.arange(min(inputs, n))
        self.begin = inputs + self.classes
        self.inputs = self.begin + 1
        shape = {"E": (self.inputs, width), "P": (window, width), "QKV": (width, 3 * width), "O": (width, width), "U": (width, self.groups), "b": (self.groups,), "V": (self.groups, width, GROUP), "c": (self.groups, GROUP)}
        self.w = {x: (rng.normal(0, 0.3 if x in "EP" else 0.3 / math.sqrt(width), s)).astype(np.float32) for x, s in shape.items()}
        self.w["b"][:] = 0
        self.w["c"][:] = 0
        self.mask = np.tri(window, dtype=np.float32)
        self.fused: np.ndarray | None = None
        self.follow(counts, np.zeros(self.inputs * self.classes))

    def follow(self, counts: np.ndarray, pairs: np.ndarray, strength: float = 20.0) -> None:
        """Takes counts of ids, and of neighbours as (input, class): sets the shares of ids
        in their class and what attention adds to, the log shares of groups and classes
        after each input, drawn to those overall."""
        weight = counts + 0.5
        each = np.bincount(self.class_of, weight, self.classes) + 1e-9
        self.within = np.log(weight / each[self.class_of]).astype(np.float32)
        share = each / each.sum()
        n = pairs.reshape(self.inputs, self.classes) + strength * share
        by_group = n.reshape(self.inputs, self.groups, GROUP).sum(axis=2)
        self.after = np.log(by_group / by_group.sum(axis=1, keepdims=True)).astype(np.float32)
        self.inside = np.log(n.reshape(self.inputs, self.groups, GROUP) / by_group[:, :, None]).astype(np.float32).reshape(-1, GROUP)

    @staticmethod
    def classify(counts: np.ndarray, beside: np.ndarray, classes: int) -> np.ndarray:
        """Half of the classes hold one of the commonest ids each; the rest are means of
        neighbourhoods, by which the other ids are grouped; ids that were seen less than
        three times are in the last but one; the end is in the last."""
        n, single = len(counts), classes // 2
        out = np.full(n, classes - 2)
        out[-1] = classes - 1
        order = np.argsort(-counts[:-1], kind="stable")
        out[order[:single]] = np.arange(len(order[:single]))
        rest = np.flatnonzero((counts >= 3) & (out == classes - 2))
        m = min(classes - single - 2, len(rest))
        if m > 0:
            row = np.full(n, -1)
            row[rest] = np.arange(len(rest))
            f = np.zeros((len(rest), 2 * (MARKS + 1)), np.float32)
            at, cell = row[beside[0] // (2 * MARKS)], beside[0] % (2 * MARKS)
            f[at[at >= 0], (cell + cell // MARKS)[at >= 0]] = beside[1][at >= 0]
            for k in (0, MARKS + 1):  # neighbours that are no marks
                f[:, k + MARKS] = (counts[rest] - f[:, k : k + MARKS].sum(axis=1)).clip(0)
            f /= f.sum(axis=1, keepdims=True).clip(1)
            np.sqrt(f, out=f)
            centre = f[np.argsort(-counts[rest], kind="stable")[:m]].copy()
            for _ in range(10):
                near = (f @ centre.T * 2 - (centre**2).sum(axis=1)).argmax(axis=1)
                for c in range(m):
                    if (near == c).any():
                        centre[c] = np.average(f[near == c], axis=0, weights=counts[rest][near == c])
            out[rest] = single + near
        return out

    def read(self, ids: np.ndarray, skip: int = 0) -> tuple:
        """Of windows of inputs: what stands at the places from ``skip`` on, queries there,
        and keys and values of all places.  Each is linear in the sum of an input's and
        a place's vector, so products with the weights are taken once by input."""
        d, w = self.width, self.w
        table = np.concatenate((w["E"], w["E"] @ w["QKV"]), axis=1) if self.fused is None else self.fused
        y = table.take(ids, axis=0)
        y += np.concatenate((w["P"], w["P"] @ w["QKV"]), axis=1)[: ids.shape[1]]
        return y[:, skip:, :d], y[:, skip:, d : 2 * d], y[:, :, 2 * d : 3 * d], y[:, :, 3 * d :]

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unscaled weights of the keys, their sums, and the means of values; queries are
        the last of the places."""
        s = np.matmul(q, k.transpose(0, 2, 1))
        s *= 1 / math.sqrt(self.width)
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        n = s.shape[2]
        s *= self.mask[n - s.shape[1] : n, :n]
        total = (s.reshape(-1, n) @ np.ones(n, s.dtype)).reshape(*s.shape[:2], 1)
        c = np.matmul(s, v)
        c /= total
        return s, total, c

    def groups_of(self, h: np.ndarray, ins: np.ndarray) -> np.ndarray:
        z = h @ self.w["U"]
        np.clip(z, -30, 30, out=z)  # beside log shares no sum vanishes or overflows
        z += self.after.take(ins, axis=0)
        z += self.w["b"]
        return z

    def classes_in(self, h: np.ndarray, ins: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in the order of their groups, where each group begins there, and their
        logits for the classes of their group."""
        order = np.argsort(group, kind="stable")  # by counting, groups are bytes
        edges = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=self.groups))))
        h = h.take(order, axis=0)
        z = np.empty((len(h), GROUP), h.dtype)
        for g in range(self.groups):
            np.matmul(h[edges[g] : edges[g + 1]], self.w["V"][g], out=z[edges[g] : edges[g + 1]])
        np.clip(z, -30, 30, out=z)
        z += self.inside.take((ins * self.groups + group).take(order), axis=0)
        z += self.w["c"].take(group.take(order), axis=0)
        return order, edges, z

    def windows_of(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Inputs, gold classes and whether a place is held, of the windows, end to end, of
        texts whose ids lie end to end."""
        ends = np.cumsum(sizes)
        begin = ends - sizes
        ins = np.empty(len(flat), np.int64)
        ins[1:] = self.input_of.take(flat[:-1])
        ins[begin[sizes > 0]] = self.begin
        many = -(-sizes // self.window)
        first = spread(np.zeros(len(sizes), np.int64), many) * self.window + np.repeat(begin, many)
        ids = first[:, None] + np.arange(self.window)
        held = ids < np.repeat(ends, many)[:, None]
        ids[~held] = 0
        return ins.take(ids), self.class_of.take(flat).take(ids), held.astype(np.float32)

    def fit(self, runs: list[np.ndarray], steps: int = 500, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the mean log loss of windows of the runs."""
        if not any(len(r) for r in runs):
            return
        rng = np.random.default_rng(self.seed)
        xs, ys, ms = self.windows_of(np.concatenate(runs), np.array([len(r) for r in runs]))
        learner = Adam(self, rate)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(xs), batch)
            learner.step(xs[pick], ys[pick], ms[pick], min(1.0, step / 20) * (1 - 0.9 * step / steps))

    def gradient(self, ids: np.ndarray, gold: np.ndarray, held: np.ndarray) -> dict[str, np.ndarray]:
        w, n, d = self.w, held.sum(), self.width
        flat = lambda a: a.reshape(-1, a.shape[-1])
        x, q, k, v = self.read(ids)
        s, total, c = self.attend(q, k, v)
        s /= total
        h, ins, group, place = flat(x) + flat(c) @ w["O"], ids.reshape(-1), (gold.reshape(-1) // GROUP).astype(np.uint8), gold.reshape(-1) % GROUP
        weight = (held / n).reshape(-1)[:, None]
        g = {name: np.zeros_like(w[name]) for name in ("V", "c", "P", "E")}

        def surplus(p: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
            np.exp(p, out=p)
            p /= (p @ np.ones(p.shape[1], p.dtype))[:, None]
            p.reshape(-1)[np.arange(len(p)) * p.shape[1] + at] -= 1
            p *= weight
            return p

        p = surplus(self.groups_of(h, ins), group, weight)
        g["U"], g["b"] = h.T @ p, np.ones(len(p), p.dtype) @ p
        dh = p @ w["U"].T
        order, edges, z = self.classes_in(h, ins, group)
        p = surplus(z, place.take(order), weight.take(order, axis=0))
        h, back = h.take(order, axis=0), np.empty_like(dh)
        for j in range(self.groups):
            at = slice(edges[j], edges[j + 1])
            g["V"][j], g["c"][j] = h[at].T @ p[at], p[at].sum(axis=0)
            np.matmul(p[at], w["V"][j].T, out=back[at])
        dh[order] += back
        dh = dh.reshape(x.shape)
        g["O"] = flat(c).T @ flat(dh)
        dc = dh @ w["O"].T
        ds = np.matmul(dc, v.transpose(0, 2, 1))
        dv = np.matmul(s.transpose(0, 2, 1), dc)
        ds -= ((dc * c) @ np.ones(d, c.dtype))[:, :, None]
        ds *= s
        ds *= 1 / math.sqrt(d)
        three = np.concatenate((np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), dv), axis=2)
        g["QKV"] = flat(x).T @ flat(three)
        dx = dh + three @ w["QKV"].T
        g["P"][: ids.shape[1]] = dx.sum(axis=0)
        order = np.argsort(ins, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(ins[order])))
        g["E"][ins[order[first]]] = np.add.reduceat(flat(dx).take(order, axis=0), first)
        return g

    def scores(self, flat: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
        """Log probability of each id of texts end to end; each text ends with the end id."""
        ends = np.cumsum(sizes)
        begin = ends - sizes
        ins = np.empty(len(flat), np.int64)
        ins[1:] = self.input_of[flat[:-1]]
        ins[begin] = self.begin
        gold = self.class_of.astype(np.uint16)[flat]
        out = self.within[flat]
        self.fused = np.concatenate((self.w["E"], self.w["E"] @ self.w["QKV"]), axis=1)
        later = np.maximum(0, -(-(sizes - self.window) // self.stride))
        text = np.repeat(np.arange(len(sizes)), later)
        at = np.arange(len(text)) - np.repeat(np.cumsum(later) - later, later) + 1
        for first, last, skip in ((begin, ends, 0), (begin[text] + at * self.stride, ends[text], self.window - self.stride)):
            for k in range(0, len(first), batch):
                ids = first[k : k + batch, None] + np.arange(self.window)
                inside = ids < last[k : k + batch, None]
                ids[~inside] = 0
                x, q, key, v = self.read(ins.take(ids), skip)
                c = self.attend(q, key, v)[-1]
                h = (c.reshape(-1, self.width) @ self.w["O"]).reshape(c.shape)
                h += x
                h, places = h.reshape(-1, self.width), ids[:, skip:].reshape(-1)
                if not inside.all():
                    fresh = np.flatnonzero(inside[:, skip:])
                    h, places = h.take(fresh, axis=0), places.take(fresh)
                out[places] += self.log_classes(h, ins.take(places), gold.take(places))
        self.fused = None
        return out

    def log_classes(self, h: np.ndarray, ins: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """Log probabilities of the gold classes."""

        def log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
            own = z.ravel().take(np.arange(len(z)) * z.shape[1] + at)
            np.exp(z, out=z)
            return own - np.log(z @ np.ones(z.shape[1], z.dtype))

        group = (gold // GROUP).astype(np.uint8)
        out = log_share(self.groups_of(h, ins), group)
        order, _, z = self.classes_in(h, ins, group)
        out[order] += log_share(z, (gold % GROUP).take(order))
        return out


class Adam:
    def __init__(self, model: AttentionModel, rate: float):
        self.model, self.rate, self.n = model, rate, 0
        self.m1, self.m2 = ({x: np.zeros_like(v) for x, v in model.w.items()} for _ in range(2))

    def step(self, ids: np.ndarray, gold: np.ndarray, held: np.ndarray, part: float) -> None:
        g = self.model.gradient(ids, gold, held)
        self.n += 1
        for name, v in self.model.w.items():
            self.m1[name] += 0.1 * (g[name] - self.m1[name])
            self.m2[name] += 0.02 * (g[name] ** 2 - self.m2[name])
            v -= self.rate * part * (self.m1[name] / (1 - 0.9**self.n)) / (np.sqrt(self.m2[name] / (1 - 0.98**self.n)) + 1e-8)


def marked(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each id its place among the marks (MARKS: none), and whether it has no class of its own."""
    order = np.argsort(-counts[:-1], kind="stable")
    mark, rest = np.full(len(counts), MARKS), np.ones(len(counts), bool)
    mark[order[:MARKS]] = np.arange(len(order[:MARKS]))
    rest[order[: classes // 2]] = rest[-1] = False
    return mark, rest


def cells_beside(flat: np.ndarray, sizes: np.ndarray, mark: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """A cell for each mark before (id, mark) or after (id, MARKS + mark) an id without a
    class of its own, in texts whose ids lie end to end."""
    a, b = flat[:-1], flat[1:]
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes)[sizes > 0] - 1] = False
    inside = inside[:-1]
    ma, mb = mark[a], mark[b]
    before, after = inside & (ma < MARKS) & rest[b], inside & (mb < MARKS) & rest[a]
    return np.concatenate((b[before] * (2 * MARKS) + ma[before], a[after] * (2 * MARKS) + MARKS + mb[after]))


def with_end(flat: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(flat.astype(np.int64), np.cumsum(sizes), end), sizes + 1


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows of bytes end to end, and how many each row has."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (ends[-1] - ends[0]) // width, ends[0]).astype(np.int64), np.diff(ends) // width


def base_of(texts: pa.Array, top: pa.Array, log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of each text: how many words it has, how many of them are in ``top``, the sum of the
    ``log`` of those, its other words, and how often it has each."""
    rows = len(texts)
    tokens, text = tokens_of(texts)
    tokens = tokens.dictionary_encode()
    place = pc.fill_null(pc.index_in(tokens.dictionary, value_set=top), -1).to_numpy(zero_copy_only=False)
    which = tokens.indices.to_numpy()
    place = place[which] if len(which) else np.zeros(0, np.int64)
    found = place >= 0
    pair, times = np.unique(text[~found] * (len(tokens.dictionary) + 1) + which[~found], return_counts=True)
    at_rare = pa.array(np.searchsorted(pair, np.arange(rows + 1) * (len(tokens.dictionary) + 1)), pa.int32())
    rare = pa.ListArray.from_arrays(at_rare, tokens.dictionary.take(pa.array(pair % (len(tokens.dictionary) + 1))).cast(pa.string()))
    return np.bincount(text, minlength=rows), np.bincount(text[found], minlength=rows), np.bincount(text[found], log[place[found]], rows), rare, pa.ListArray.from_arrays(at_rare, pa.array(times, pa.int64()))


def log_scores(texts: pa.Array, words: WordIds, model: AttentionModel, tree: WordTree | None, end: int) -> np.ndarray:
    """log10 probability of each text, end included.  Ids of a slab are told by distinct
    chunk; those of whole texts lie end to end for runs of texts with about RUN ids."""
    flat, size, chunk, held = words.chunked(texts)
    begin, last = np.cumsum(size) - size, np.cumsum(held)
    share, left = (np.zeros(len(flat), np.float32), np.ones(len(flat), np.float32)) if tree is None else tree.read(flat, begin[size > 0])
    run = (np.append(0, np.cumsum(size[chunk]))[last] - 1).clip(0) // RUN
    edges = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1, [len(run)]))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        some = chunk[last[a] - held[a] : last[b - 1]]
        length = size[some]
        at, ends = spread(begin[some], length), np.append(0, np.cumsum(length))[np.cumsum(held[a:b])]
        ids, sizes = with_end(flat.take(at), np.diff(ends, prepend=0), end)
        each = model.scores(ids, sizes).astype(float)  # in 32 bits the least probabilities are zero
        np.exp(each, out=each)
        each *= np.insert(left.take(at), ends, 1)
        each += np.insert(share.take(at), ends, 0)
        out.append(np.add.reduceat(np.log(each), np.cumsum(sizes) - sizes, dtype=float) / math.log(10))
    return np.concatenate(out)


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the greatest counts, at most ``most`` and whole steps of 1/64 of a power of
    two; a histogram of 4,096 steps at most says where they begin, so nothing is ordered."""
    stepped = counts.withColumn("_step", F.floor(F.log2("_c") * 64))
    total, least = 0, None
    for r in sorted(stepped.groupBy("_step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["_step"]):
        total += r["n"]
        if total > most:
            break
        least = r["_step"]
    return stepped.filter(F.lit(False) if least is None else F.col("_step") >= least).drop("_step")


def score_texts(
    df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, frequent: int = 400_000, fit_rows: int = 1500, fit_ids: int = 384
) -> DataFrame:
    """One row for each row: id, ``held_out`` (``train`` does not hold), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 probabilities).

    Tokens are words between ASCII white space, A to Z lowered, and one end.  A null
    text is empty: an end alone.  Where ``train`` is null the row is held out.  Ids
    may be null or repeat; repeated rows are rows like any other.  Without training
    rows the base gives each token probability one and the model's weights are as
    drawn.  Only the id and text columns are read."""
    train = F.coalesce(train, F.lit(False))
    kinds = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), train.alias("_train"))
    taught = own.filter("_train").select("_id", "_text")
    context = df.sparkSession.sparkContext
    words = word_ids(tokenizer)
    end = words.tokenizer.get_vocab_size()

    @lean
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            us, out = batch.column("_u").to_pylist(), []
            for first, ids in words.slabs(batch.column("_text"), end):
                for x, u in zip(ids, us[first : first + len(ids)]):
                    at = u % max(1, len(x) - fit_ids + 1)
                    out.append(x[at : at + fit_ids].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column("_u")], ["_ids", "_u"])

    few = least_hashed(taught, F.xxhash64(F.lit(17), "_id", "_text"), fit_rows)
    sample = sorted((r[1], r[0]) for r in few.repartition(16).mapInArrow(runs, "_ids array<int>, _u long").collect())  # fit_rows at most
    lines = [np.array(x) for _, x in sample]
    kind = np.uint16 if end < 1 << 16 else np.uint32

    @lean
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            for _, texts in slabs_of(batch.column(0)):
                flat, sizes = with_end(*words.encode(texts), end)
                at = np.append(0, np.cumsum(sizes)) * np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat.astype(kind))])], ["_ids"])

    ids = cut(taught.select("_text").mapInArrow(encoded, "_ids binary"), "ids")

    def tally(size: int, cells: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cells that the ids of all training texts fall in, and how often."""

        @lean
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(size, np.int64)
            for batch in batches:
                for _, part in slabs_of(batch.column(0)):
                    np.add.at(n, cells(*unpacked(part, kind)), 1)
            some = np.flatnonzero(n)
            for k in range(0, len(some), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(some[k : k + (1 << 18)], pa.int32()), pa.array(n[some[k : k + (1 << 18)]])], ["_cell", "_c"])

        got = ids.mapInArrow(task, "_cell int, _c long").groupBy("_cell").agg(F.sum("_c").alias("_c")).toArrow()  # one row a cell at most
        return got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy()

    def dense(size: int, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        out[cell] = n
        return out

    seen = dense(end + 1, *tally(end + 1, lambda flat, sizes: flat))
    texts, marks = int(seen[end]), marked(seen, 256)
    beside = tally((end + 1) * 2 * MARKS, lambda flat, sizes: cells_beside(flat, sizes, *marks))
    model = AttentionModel(seen, [], classes=256, beside=np.stack(beside))
    input_of, class_of, begin_id, classes = model.input_of, model.class_of, model.begin, model.classes

    def after(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        before = np.append(begin_id, input_of[flat[:-1]])
        before[np.cumsum(sizes) - sizes] = begin_id
        return before * classes + class_of[flat]

    model.follow(seen, dense(model.inputs * classes, *tally(model.inputs * classes, after)))
    model.fit(lines)
    started = context.broadcast(model)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slabs_of(batch.column(0)):
                found = pc.value_counts(tokens_of(texts)[0])
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())], ["_word", "_c"])

    counts = cut(taught.select("_text").mapInArrow(count, "_word string, _c long").groupBy("_word").agg(F.sum("_c").alias("_c")), "counts")
    total, kinds_of_word = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + texts, kinds_of_word + (texts > 0)
    got = commonest(counts, frequent).toArrow()
    top, top_c = got.column(0).combine_chunks().cast(pa.large_string()), got.column(1).to_numpy().astype(float)

    @lean
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = started.value
        start = model.w
        model.w = {k: v.copy() for k, v in start.items()}
        learner, n, held = Adam(model, 0.001), 0, []

        def learn() -> int:
            xs, ys, ms = (np.concatenate(x) for x in zip(*held))
            for at in np.array_split(np.random.default_rng(n).permutation(len(xs)), -(-len(xs) // BATCH)):
                learner.step(xs[at], ys[at], ms[at], 1.0)
            return len(xs)

        for batch in batches:
            for _, part in slabs_of(batch.column(0)):
                held.append(model.windows_of(*unpacked(part, kind)))
                if sum(len(x[0]) for x in held) >= BATCH:
                    n += learn()
                    held = []
        if held:  # the last windows, fewer than a batch
            n += learn()
        body, model.w = np.concatenate([model.w[k].ravel() for k in sorted(model.w)]).tobytes(), start
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([body], pa.binary()), pa.array([n], pa.int64())], ["_slot", "_w", "_n"])

    def mean(df: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, np.float32).astype(float) * n for w, n in zip(df["_w"], df["_n"])) / df["_n"].sum()
        return pd.DataFrame({"_slot": df["_slot"].iloc[:1], "_w": [total.astype(np.float32).tobytes()], "_n": [df["_n"].sum()]})

    trainers = max(1, min(4096, -(-texts // 8000)))
    learned = ids.coalesce(trainers).mapInArrow(trained, "_slot int, _w binary, _n long").groupBy("_slot").applyInPandas(mean, "_slot int, _w binary, _n long").collect()  # 16 rows at most
    started.unpersist()
    if learned:
        flat = sum(np.frombuffer(r["_w"], np.float32).astype(float) * r["_n"] for r in sorted(learned)) / sum(r["_n"] for r in learned)
        for name in sorted(model.w):
            size = model.w[name].size
            model.w[name], flat = flat[:size].reshape(model.w[name].shape).astype(np.float32), flat[size:]

    ends = np.append(words.ends, True)
    flat, sizes, which, held = words.chunked(top)
    order = np.repeat(np.arange(len(top)), held)
    tree = WordTree(np.append(gathered(flat, (np.cumsum(sizes) - sizes)[which], sizes[which]), end).astype(np.int64), np.append(np.repeat(top_c[order], sizes[which]), texts), ends) if len(top) else None
    shared = context.broadcast((model, tree, top, np.log10(top_c + 0.5)))

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tree, top, log = shared.value
        words = word_ids(tokenizer)
        for batch in batches:
            for at, texts_of in slabs_of(batch.column(1)):
                part = batch.slice(at, len(texts_of))
                keys = [row_key(i, (t or "").encode()) for i, t in zip(part.column(0).to_pylist(), texts_of.to_pylist())]
                n, known, base, *lists = base_of(texts_of, top, log)
                n, known, base = n + 1, known + (texts > 0), base + math.log10(texts + 0.5)
                freed()
                scores = log_scores(texts_of, words, model, tree, end)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(scores), *lists],
                    ["_id", "_train", "_rk", "_n", "_known", "_base", "score", "_rare", "_times"],
                )

    scored = cut(own.mapInArrow(score, f"_id {kinds}, _train boolean, _rk binary, _n long, _known long, _base double, score double, _rare array<string>, _times array<long>"), "scored")
    # a row repeated gives its words again: its copies are counted, and the sums shared
    copies = scored.filter(F.size("_rare") > 0).groupBy("_rk").agg(F.count("*").alias("_copies"))
    words_of_rows = scored.select("_rk", F.explode(F.arrays_zip(F.col("_rare").alias("w"), F.col("_times").alias("t"))).alias("x")).select("_rk", F.col("x.w").alias("_word"), F.col("x.t").alias("_times"))
    added = words_of_rows.join(counts, "_word", "left").groupBy("_rk").agg(
        F.sum(F.col("_times") * F.log10(F.coalesce("_c", F.lit(0)) + 0.5)).alias("_more"), F.sum(F.when(F.col("_c").isNotNull(), F.col("_times")).otherwise(0)).alias("_too")
    )
    added = added.join(copies, "_rk").select("_rk", (F.col("_more") / F.col("_copies")).alias("_more"), (F.col("_too") / F.col("_copies")).cast("long").alias("_too"))
    shift = math.log10(total + 0.5 * (distinct + 1))
    return scored.drop("_rare", "_times").join(added, "_rk", "left").select(
        F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce("_too", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_more", F.lit(0.0)) - F.col("_n") * F.lit(shift)).alias("base_score"), "score",
    )
