"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label (a language): features of the word (itself, affixes,
character n-grams, membership in the languages' lexicons) score its labels, learned
transition weights score neighbouring labels, and forward-backward gives each word's
label probabilities in its text, so texts that switch language are labelled word by
word.  A text's language is the one with the largest mean probability.

The field is fitted on the driver on a bounded sample of labelled rows: whole texts of
about ``fit_rows`` rows (least hashes of id and text), as many of each language as there
are, so that rare ones are learned too.  Pieces of different rows are strung together, so
that transitions see both staying and switching.  Prediction covers every row and every
word, in slabs of bounded size; a word's features are computed once a worker, as long as
the words that it keeps stay below a number of bytes.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import gathered, slabs_of
from .shared import lean

SPACE = 1 << 17
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Of each Python worker: the field that it used last, its words and their scores.
_WORDS: dict = {"field": None, "words": None, "table": None}
KEPT_BYTES = 24 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters (Unicode category L) of all texts, lower case, and how many each has."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"\PL+", " ")
    split = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    words = split.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return words.filter(some), np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULT
    return h ^ (h >> np.uint64(29))


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of distinct words end to end, and how many each has: the word, its affixes
    of one to four letters, and its bigrams and trigrams with its ends."""
    n = np.array([len(w) for w in words], np.int64)
    size = n + 2
    ends = np.cumsum(size)
    begin = ends - size
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - begin[word]
    rolled, grams = np.zeros(len(code), np.uint64), {}
    for k in range(1, 6):  # hashes of k symbols from each place on
        ahead = np.zeros_like(code)
        ahead[: max(0, len(code) - k + 1)] = code[k - 1 :]
        rolled = mixed(rolled + ahead * (MULT + np.uint64(2 * k)))
        grams[k] = rolled
    whole = np.add.reduceat(mixed(code + place.astype(np.uint64) * MULT), begin)
    cells, owners = [mixed(whole + np.uint64(1))], [np.arange(len(words))]

    def add(kind: int, values: np.ndarray, owner: np.ndarray) -> None:
        cells.append(mixed(values + np.uint64(kind)))
        owners.append(owner)

    for k in (1, 2, 3, 4):
        some = np.flatnonzero(n >= k)
        add(10 + k, grams[k + 1][begin[some]], some)
        add(20 + k, grams[k + 1][ends[some] - k - 1], some)
    for k in (2, 3):
        at = np.flatnonzero(place + k <= size[word])
        add(30 + k, grams[k][at], word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(cells)[order] % np.uint64(SPACE)).astype(np.int64), np.bincount(owner, minlength=len(words))


class Field:
    """Weights, lexicons and labels; picklable, some megabytes at most."""

    def __init__(self, labels: list[str], lexicon: dict[str, tuple[int, ...]]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((SPACE + len(labels), len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of the words with the languages in whose lexicon they are."""
        cells, size = hashed(words)
        listed = [(k, SPACE + j) for k, w in enumerate(words) if w in self.lexicon for j in self.lexicon[w]]
        if listed:
            at, more = np.array(listed).T
            cells = np.insert(cells, np.cumsum(size)[at], more)
            size = size + np.bincount(at, minlength=len(words))
        return cells, size

    def emissions(self, words: list[str]) -> np.ndarray:
        cells, size = self.features(words)
        return np.add.reduceat(self.weights[cells], np.cumsum(size) - size, axis=0) / np.sqrt(size)[:, None]

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """scores: (texts, words, labels), -> probabilities of the same shape."""
        return self._sweep(scores)[0]

    def _sweep(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        ahead, back = np.empty_like(e), np.empty_like(e)
        ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, e.shape[1]):
            a = (ahead[:, t - 1] @ move) * e[:, t]
            ahead[:, t] = a / a.sum(axis=1, keepdims=True)
        back[:, -1] = 1
        for t in range(e.shape[1] - 2, -1, -1):
            b = (back[:, t + 1] * e[:, t + 1]) @ move.T
            back[:, t] = b / b.sum(axis=1, keepdims=True)
        p = ahead * back
        return p / p.sum(axis=2, keepdims=True), ahead, back * e

    def fit(self, runs: list[tuple[list[str], int]], length: int = 24, rounds: int = 2, rate: float = 0.5, seed: int = 5) -> "Field":
        """AdaGrad on the log-likelihood of strings of runs, ``length`` words each."""
        rng, k = np.random.default_rng(seed), len(self.labels)
        vocab: dict[str, int] = {}
        pieces = []
        for words, label in runs:
            ids = [vocab.setdefault(w, len(vocab)) for w in words]
            at = 0
            while at < len(ids):
                step = int(rng.integers(3, length + 1))
                pieces.append((ids[at : at + step], label))
                at += step
        flat, size = self.features(list(vocab))
        begin = np.cumsum(size) - size
        scale = 1 / np.sqrt(size)
        g2, m2 = np.full_like(self.weights, 1e-3), np.full((k, k), 1e-3)
        for _ in range(rounds):
            order = rng.permutation(len(pieces))
            ids = [i for p in order for i in pieces[p][0]]
            gold = np.array([y for p in order for y in [pieces[p][1]] * len(pieces[p][0])], np.int64)
            n = len(ids) // length
            if n == 0:
                ids, gold = (ids * length)[:length], np.resize(gold, length)
                n = 1
            ids, gold = np.array(ids[: n * length]).reshape(n, length), gold[: n * length].reshape(n, length)
            for at in range(0, n, 32):
                x, y = ids[at : at + 32], gold[at : at + 32]
                used, back = np.unique(x, return_inverse=True)
                cells = gathered(flat, begin[used], size[used])
                owner = np.repeat(np.arange(len(used)), size[used])
                em = np.zeros((len(used), k))
                np.add.at(em, owner, self.weights[cells] * scale[used][owner][:, None])
                p, ahead, behind = self._sweep(em[back].reshape(*x.shape, k))
                want = np.eye(k)[y]
                step = np.zeros((len(used), k))
                np.add.at(step, back.ravel(), (want - p).reshape(-1, k))
                hit, where = np.unique(cells, return_inverse=True)
                grad = np.zeros((len(hit), k))
                np.add.at(grad, where, step[owner] * scale[used][owner][:, None])
                grad = grad / len(x) - 1e-5 * self.weights[hit]
                g2[hit] += grad**2
                self.weights[hit] += rate * grad / np.sqrt(g2[hit])
                pair = ahead[:, :-1, :, None] * np.exp(self.moves - self.moves.max()) * behind[:, 1:, None, :]
                pair /= pair.sum(axis=(2, 3), keepdims=True)
                mg = (np.einsum("bti,btj->ij", want[:, :-1], want[:, 1:]) - pair.sum(axis=(0, 1))) / len(x) - 1e-4 * self.moves
                m2 += mg**2
                self.moves += rate * 0.2 * mg / np.sqrt(m2)
        return self


def fit_field(df: DataFrame, id_col: str, text_col: str, lang_col: str, fit_rows: int, lexicon_words: int) -> Field | None:
    """A field from the rows of ``df`` with text and language; None if there are none."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\pL")).select(
        F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.lit(3), id_col, text_col).alias("_u")
    )
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()  # one row a language
    quota = max(20, fit_rows // max(1, len(sizes)))
    least = df.sparkSession.createDataFrame([(r["_lang"], int(-(2**63) + 2**64 * min(1.0, quota / r["n"])) - (quota >= r["n"])) for r in sizes], "_lang string, _most long")
    few = rows.join(F.broadcast(least), "_lang").filter("_u <= _most")

    got = sorted((r["_u"], r["_lang"], r["_text"]) for r in few.select("_u", "_lang", "_text").collect())  # about quota rows a language
    if not got:
        return None
    words, size = words_of(pa.array([x[2] for x in got]))
    split = np.split(np.array(words.to_pylist(), object), np.cumsum(size)[:-1])
    got = [(u, lang, x.tolist()) for (u, lang, _), x in zip(got, split)]
    labels = sorted({x[1] for x in got})
    at = {x: k for k, x in enumerate(labels)}
    seen: dict[str, Counter] = defaultdict(Counter)
    for _, lang, text in got:
        seen[lang].update(set(text))
    lexicon: dict[str, list[int]] = defaultdict(list)
    for lang in labels:
        for word, n in seen[lang].most_common(lexicon_words):
            if n > 1:
                lexicon[word].append(at[lang])
    field = Field(labels, {w: tuple(v) for w, v in lexicon.items()})
    return field.fit([(text, at[lang]) for _, lang, text in got]) if len(labels) > 1 else field


def predict_languages(
    df: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 1000, lexicon_words: int = 2000, carry: tuple[str, ...] = (), with_words: bool = False
) -> DataFrame:
    """One row for each row: id, ``lang_pred``, ``score``, and the columns in ``carry``.

    Learns from rows where ``train`` holds (default: all) with text and language;
    predicts from the text alone.  ``und`` with score 1 where the text is null or has
    no letter, and with score 0 everywhere if nothing can be learned.  Null or
    repeated ids and repeated rows are rows like any other; equal means go to the
    smaller label.  An empty table gives no rows.  Columns of the input that are not
    carried cannot clash; a carried one named like a column of the result is an error.
    ``with_words`` adds each word's label as ``word_langs``."""
    clash = {"lang_pred", "score", "word_langs"} & {id_col, *carry}
    if clash:
        raise ValueError(f"columns of the input have names of the result: {sorted(clash)}")
    field = fit_field(df if train is None else df.filter(train), id_col, text_col, lang_col, fit_rows, lexicon_words)
    names = [id_col, *[c for c in carry if c != id_col]]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    token = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(field)  # SPACE x labels weights, lexicon_words x labels words
    text_at = names.index(text_col) if text_col in names else len(names)  # a text that is carried is sent once

    def places(model: Field, words: pa.Array) -> np.ndarray:
        """Rows of distinct words in the worker's table of scores."""
        if _WORDS["field"] != token or _WORDS["words"].nbytes + _WORDS["table"].nbytes > KEPT_BYTES:
            _WORDS.update(field=token, words=pa.array([], pa.large_string()), table=np.zeros((0, len(model.labels)), np.float32))
        at = pc.index_in(words, value_set=_WORDS["words"])
        new = at.is_null().to_numpy(zero_copy_only=False)
        fresh = words.filter(pa.array(new))
        out = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out[new] = len(_WORDS["words"]) + np.arange(len(fresh))
        if len(fresh):
            _WORDS["words"] = pa.concat_arrays([_WORDS["words"], fresh])
            fresh = fresh.to_pylist()
            parts = [model.emissions(fresh[k : k + 20_000]).astype(np.float32) for k in range(0, len(fresh), 20_000)]
            _WORDS["table"] = np.concatenate((_WORDS["table"], *parts))
        return out

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in slabs_of(batch.column(text_at)):
                part = batch.slice(at, len(texts))
                results = [("und", 1.0 if model else 0.0, [])] * len(texts)
                words, sizes = words_of(texts) if model else (pa.array([], pa.large_string()), np.zeros(len(texts), np.int64))
                if len(words):
                    words = words.dictionary_encode()
                    ids = places(model, words.dictionary)[words.indices.to_numpy()]
                    begin = np.cumsum(sizes) - sizes
                    order = [k for k in np.argsort(sizes, kind="stable").tolist() if sizes[k]]
                    while order:
                        longest = int(sizes[order[-1]])
                        group = order[-max(1, 200_000 // longest) :]
                        group = [k for k in group if sizes[k] * 2 >= longest] or group[-1:]
                        del order[-len(group) :]
                        held = np.arange(longest) < sizes[group][:, None]
                        scores = _WORDS["table"][ids[np.where(held, begin[group][:, None] + np.arange(longest), 0)]]
                        scores[~held] = 0
                        p = masked(model, scores, held)
                        mean = p.sum(axis=1) / held.sum(axis=1)[:, None]
                        for row, k in enumerate(group):
                            best = int(mean[row].argmax())
                            each = [model.labels[j] for j in p[row, : sizes[k]].argmax(axis=1)] if with_words else []
                            results[k] = (model.labels[best], min(1.0, max(0.0, float(mean[row, best]))), each)
                data = part.columns[: len(names)] + [pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.float64())]
                if with_words:
                    data.append(pa.array([r[2] for r in results], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(data, names + ["lang_pred", "score"] + ["word_langs"] * with_words)

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", lang_pred string, score double" + ", word_langs array<string>" * with_words
    return df.select(*names, *[text_col] * (text_col not in names)).mapInArrow(task, schema)


def masked(model: Field, scores: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Marginals where texts differ in length: the end of a text is not followed by
    any move, so padding behind it counts as evidence for nothing."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(model.moves - model.moves.max()).astype(np.float32)
    ahead = np.empty_like(e)
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, e.shape[1]):
        a = (ahead[:, t - 1] @ move) * e[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((e.shape[0], e.shape[2]), np.float32)
    out = np.zeros_like(e)
    for t in range(e.shape[1] - 1, -1, -1):
        p = ahead[:, t] * back
        out[:, t] = p / p.sum(axis=1, keepdims=True) * held[:, t, None]
        b = (back * e[:, t]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        back = np.where(held[:, t, None], b, 1).astype(np.float32)
    return out
