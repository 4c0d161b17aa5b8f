"""The kernels of the operators against brute force, without Spark."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import anisotropic, decontaminate, html_extract, language_id, lm_score, order_minhash, packing, sharding, suffix_dedup


def test_best_fill_is_best():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        cap = rng.randint(1, 60)
        got = packing.best_fill(counts, cap)
        assert all(v <= counts[k] for k, v in got.items())
        all_ = [sum(k * n for k, n in zip(counts, c)) for c in itertools.product(*(range(v + 1) for v in counts.values()))]
        assert sum(k * v for k, v in got.items()) == max(x for x in all_ if x <= cap)


def test_packer_keeps_every_id_once_without_padding():
    rng = random.Random(2)
    p = packing.Packer(64, 50, 0)
    docs = [np.arange(rng.randint(1, 300), dtype="<u4") for _ in range(300)]
    for i, d in enumerate(docs):
        p.add(i, d)
    p.finish()
    by_doc, by_seq = {}, {}
    for d, start, n, crc, total, seq, offset, ids in p.out:
        assert zlib.crc32(ids.tobytes()) == crc and total == len(docs[d]) and (ids == docs[d][start : start + n]).all()
        by_doc.setdefault(d, []).append((start, n))
        by_seq.setdefault(seq, []).append((offset, n))
    gapless = lambda xs: all(a == sum(m for _, m in sorted(xs)[:i]) for i, (a, _) in enumerate(sorted(xs)))
    assert all(gapless(v) and sum(n for _, n in v) == len(docs[d]) for d, v in by_doc.items()) and len(by_doc) == 300
    sizes = [sum(n for _, n in v) for v in by_seq.values()]
    assert all(gapless(v) for v in by_seq.values()) and all(s == 64 or s & (s - 1) == 0 for s in sizes) and max(sizes) == 64


def test_ids_by_word_are_the_tokenizers(monkeypatch):
    texts = ["Don't áb 3x²½ <|endoftext|> Å,, İstanbul!! ΣΑΣ. a\x1cb x\x0by\x0c 'tis we've... l'été", "", None, "  ", "a" * 3000 + " b", "ﬁ Ⅷ ǅ, Å.", "LYING,!! the### of%%%", "u\u0308.\u00a0x\u2028 --", "中文 字。"]
    for most in (40 << 20, 1):  # 1: the words are begun anew with every slab
        words = packing.WordIds(packing.word_ids(None).path, most)
        for slab in (packing.SLAB, 40):
            monkeypatch.setattr(packing, "SLAB", slab)
            got = [x.tolist() for _, part in words.slabs(pa.array(texts), 1) for x in part]
            assert got == [words.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert list(words.slabs(pa.array([], pa.string()))) == []


def test_matrix_has_its_sums_and_the_law():
    m = sharding.communication_matrix([10, 0, 25, 7], [14, 14, 14], seed=3)
    assert [sum(r) for r in m] == [10, 0, 25, 7] and [sum(c) for c in zip(*m)] == [14, 14, 14]
    rng = random.Random(5)
    seen = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20000))
    from math import comb

    assert all(abs(seen[k] / 20000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.02 for k in range(5))


def test_expansion_against_all_windows():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(3, 12)
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(n, 40))) for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        assert [list(map(bool, x)) for x in suffix_dedup.repeated_windows(texts, n)] == [[seen[t[i : i + n]] > 1 for i in range(len(t) - n + 1)] for t in texts]


def test_common_prefix_values_are_exact_below_the_depth():
    text = np.array([*b"banana\0bandana\0"], np.int64)
    value, rank = suffix_dedup.expand(text, 4)
    raw = bytes(text.astype(np.uint8))
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert list(np.argsort(rank)) == order
    for r in range(1, len(order)):
        a, b = raw[order[r - 1] :].split(b"\0")[0], raw[order[r] :].split(b"\0")[0]
        lcp = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if a != b and lcp < 4 and len(b) > lcp:
            assert value[r] == lcp


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 101, 3000).astype(np.uint8)
    buf[2000:2500] = buf[100:600]
    a, s, e = suffix_dedup.anchors(buf, np.array([1500, 3000]), 60, 30)
    of = {p: x for x, i, j in zip(a.tolist(), s.tolist(), e.tolist()) for p in range(i, j + 1)}
    assert sorted(of) == [p for p in range(3000) if p + 60 <= (1500 if p < 1500 else 3000)]
    assert all(0 <= x - p < 30 for p, x in of.items())
    assert all(of[2000 + k] - 1900 == of[100 + k] for k in range(440))


def test_edit_distance_against_the_table():
    def table(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.choice((1, 2, 3)) for _ in range(rng.randint(0, 12))]
        b = [c for c in a if rng.random() < 0.8] if rng.random() < 0.5 else [rng.choice((1, 2, 3)) for _ in range(rng.randint(0, 12))]
        most, d = rng.randint(0, 8), table(a, b)
        assert order_minhash.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == (d if d <= most else None)
    for _ in range(300):
        a = [rng.choice(range(6)) for _ in range(rng.randint(1, 60))]
        b = [rng.choice(range(6)) if rng.random() < 0.2 else c for c in a if rng.random() < 0.9]
        most, d = rng.randint(1, 30), table(a, b)
        assert order_minhash.aligned(a, b, most) == (d if d <= most else None) or abs(len(a) - len(b)) > most


def test_sketches_agree_on_copies_and_follow_order():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**60, 200).astype(np.uint64)
    b = a.copy()
    b[50] += np.uint64(1)
    def keys(*texts, functions=9):
        flat, n = order_minhash.sketches(np.concatenate(texts), np.array([len(t) for t in texts]), functions, 5)
        return [set(x.tolist()) for x in np.split(flat, np.cumsum(n)[:-1])]

    ka, kb, kc, kd, ke, kf = keys(a, b, a, a[:3], a[:6], a[:7])
    assert ka == kc and len(ka & kb) > 20 and [len(k) for k in (ka, kd, ke, kf)] == [54, 9, 9, 27]
    assert keys(a[:6]) == [ke] and keys(np.tile(a[:1], 40)) == keys(np.tile(a[:1], 40))
    ka, kb = keys(a, np.concatenate((a[100:], a[:100])), functions=20)
    assert 5 < len(ka & kb) < 100  # the same k-mers in another order


@pytest.mark.parametrize("words", [60, 150, 500])
def test_sketches_find_nine_of_ten_pairs_at_the_threshold(words):
    rng = np.random.default_rng(words)
    found = 0
    for _ in range(300):
        a = rng.integers(1, 2**60, words).astype(np.uint64)
        b = a.tolist()
        for at in sorted(rng.choice(words, words // 5, replace=False).tolist(), reverse=True):
            b[at : at + 1] = [[int(rng.integers(1, 2**60))], [], [b[at], int(rng.integers(1, 2**60))]][rng.integers(3)]
        keys, n = order_minhash.sketches(np.concatenate((a, np.array(b, np.uint64))), np.array([words, len(b)]), 9, 5)
        found += len(np.intersect1d(keys[: n[0]], keys[n[0] :])) > 0
    assert found / 300 >= 0.9


def test_cut_is_a_minimum():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 7)
        z = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.random() * 2) for i in range(n) for j in range(i) if rng.random() < 0.6]
        cost = lambda l: sum(abs(x) for x, k in zip(z, l) if (x > 0) != k) + sum(w for a, b, w in edges if l[a] != l[b])
        got = html_extract.min_cut([max(0, x) for x in z], [max(0, -x) for x in z], edges)
        assert abs(cost(got) - min(cost(c) for c in itertools.product((False, True), repeat=n))) < 1e-6


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("no markup at all, but a sentence.", "no markup at all, but a sentence."),
        ('<nav><a href="/x">X</a></nav><article><h1>T</h1><p>Hello <b>wor</b>ld &amp;\n more.<p>Two<br>lines.</article><div class="ad">Buy</div><footer>&copy; y</footer>', "T Hello world & more. Two lines."),
        ('<article><p>Said.</p><!-- <p>no</p> --><script>var t="</p>";</script><section class="comments"><p>A reader says a lot of things here.</p></section>', "Said."),
        ("<article><p>open <i>never closed", "open never closed"), ("<script>", ""), ("<article><p>a</p><!-- unclosed <p>b</p>", "a"),
    ],
)
def test_pages(page, text):
    assert " ".join(html_extract.content_blocks(page)) == text


def test_hamming_index_meets_everything_within_its_radius():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("abcdefghijklmnop", k=30))) for i in range(40)]
    index = decontaminate.Index(items)
    for key, members in index.groups.items():
        prints, near = index.prints[key], index.near[key]
        for p in prints:
            f = np.unpackbits(p)
            f[rng.sample(range(64), 23)] ^= 1
            f = np.packbits(f)
            met = set(np.concatenate([near[b][f[b]] for b in range(8)]).tolist())
            assert {j for j in range(len(members)) if decontaminate.ONES[prints[j] ^ f].sum() <= 23} <= met


def test_words_are_runs_of_letters():
    words, sizes = language_id.words_of(pa.array(["½ ² Ⅷ ① 12 _", None, "L'Été—Ωσ 中文x1y", "", "a" * 300]))
    assert words.to_pylist() == ["l", "été", "ωσ", "中文x", "y", "a" * 300] and sizes.tolist() == [0, 0, 5, 0, 1]


def test_features_do_not_depend_on_the_other_words():
    words = ["a", "the", "abcd", "x" * 90, "été", "the" * 3]
    cells, size = language_id.hashed(words)
    each = np.split(cells, np.cumsum(size)[:-1])
    assert [len(x) for x in each] == [1 + 2 * min(len(w), 4) + 2 * len(w) + 1 for w in words]
    assert all(np.array_equal(x, language_id.hashed([w])[0]) for x, w in zip(each, words))


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    field = language_id.Field(["a", "b", "c"], {})
    field.moves = rng.normal(size=(3, 3))
    scores = rng.normal(size=(1, 5, 3)).astype(np.float32)
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(sum(scores[0, t, y] for t, y in enumerate(path)) + sum(field.moves[x, y] for x, y in zip(path, path[1:])))
        for t, y in enumerate(path):
            want[t, y] += p
    want /= want.sum(axis=1, keepdims=True)
    padded = np.concatenate((scores, np.zeros((1, 2, 3), np.float32)), axis=1)
    got = language_id.masked(field, padded, np.array([[True] * 5 + [False] * 2]))[0]
    assert np.allclose(field.marginals(scores)[0], want, atol=1e-5) and np.allclose(got[:5], want, atol=1e-4)


def test_field_learns_and_follows_switches():
    rng = random.Random(1)
    word = {0: lambda: "".join(rng.choices(["th", "er", "on"], k=3)), 1: lambda: "".join(rng.choices(["eau", "ch", "ou"], k=3))}
    runs = [([word[k % 2]() for _ in range(20)], k % 2) for k in range(200)]
    field = language_id.Field(["a", "b"], {}).fit(runs)
    mixed = [word[0]() for _ in range(10)] + [word[1]() for _ in range(10)]
    p = language_id.masked(field, field.emissions(mixed)[None].astype(np.float32), np.ones((1, 20), bool))[0]
    assert (p.argmax(axis=1) == np.array([0] * 10 + [1] * 10)).mean() > 0.9
    assert np.allclose(p, field.marginals(field.emissions(mixed)[None])[0], atol=1e-4)


def test_gradient_of_attention_and_sum_of_windows():
    rng = np.random.default_rng(4)
    runs = [rng.integers(0, 39, 40) for _ in range(5)]
    counts = np.bincount(np.concatenate(runs), minlength=40).astype(float)
    m = lm_score.AttentionModel(counts, runs, classes=32, inputs=10, width=6, window=8, stride=5)
    ids, gold = rng.integers(0, 10, (2, 8)), rng.integers(0, m.classes, (2, 8))
    held = np.ones((2, 8), np.float32)
    for k in m.w:
        m.w[k] = m.w[k].astype(np.float64)

    def loss():
        x, q, k, v = m.read(ids)
        h = x + m.attend(q, k, v)[-1] @ m.w["O"]
        return -m.log_classes(h.reshape(-1, 6), ids.ravel(), gold.ravel()).mean()

    g = m.gradient(ids, gold, held)
    for name in m.w:
        at = tuple(rng.integers(0, s) for s in m.w[name].shape)
        if name == "E":
            at = (ids[0, 3], at[1])
        if name in "Vc":
            at = (gold[1, 2] // lm_score.GROUP, *at[1:])
        old = m.w[name][at]
        m.w[name][at] = old + 1e-5
        up = loss()
        m.w[name][at] = old - 1e-5
        down = loss()
        m.w[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name
    m.fit(runs, steps=30)
    texts = [np.append(rng.integers(0, 39, n), 39) for n in (0, 3, 7, 8, 30)]
    sizes = np.array([len(t) for t in texts])
    together, alone = m.scores(np.concatenate(texts), sizes, batch=3), np.concatenate([m.scores(t, np.array([len(t)])) for t in texts])
    assert np.allclose(together, alone, atol=1e-4) and (together < 0).all()
    pairs = np.array([[i, j] for i in range(40) for j in range(40)])
    total = np.exp(m.scores(pairs.ravel(), np.full(1600, 2)).reshape(-1, 2).sum(axis=1)).sum()
    assert abs(total - 1) < 1e-3  # all texts of two ids


def test_word_tree_against_its_definition():
    ends = np.array([False, False, True, True, True])  # ids 2, 3 and the last, 4, end a word
    words = {(0, 2): 5, (0, 1, 2): 2, (0, 1, 3): 4, (3,): 6, (4,): 3}
    flat = np.array([i for w in words for i in w])
    tree = lm_score.WordTree(flat, np.array([c for w, c in words.items() for _ in w], float), ends, 0.75)
    count = lambda p: sum(c for w, c in words.items() if w[: len(p)] == p)
    for text in ([0, 1, 3, 0, 2, 4], [1, 0, 2, 3, 4], [0, 0, 2, 0, 1, 1, 4], [4]):
        share, left = tree.read(np.array(text), np.array([0]))
        so_far: tuple = ()
        for k, i in enumerate(text):
            whole = count(so_far) if so_far else 0
            kept = {j: max(count((*so_far, j)) - 0.75, 0) / whole for j in range(5)} if whole else dict.fromkeys(range(5), 0)
            assert abs(share[k] - kept[i]) < 1e-6 and abs(left[k] - (1 - sum(kept.values()))) < 1e-6
            so_far = () if ends[i] else (*so_far, i)


def test_scan_breaks_ties_by_the_smaller_id():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x[100:300] = x[7] * 2
    book = anisotropic.Codebook(x)
    got = anisotropic.scan(book, np.arange(400), x, book.pairs(x), 7, x[7], 5, 20)
    assert [i for i, _ in got] == [100, 101, 102, 103, 104] and len({s for _, s in got}) == 1


def test_tasks_leave_no_unused_memory():
    import resource

    import pyarrow as pa
    from strandlake.llm.shared import lean

    page = resource.getpagesize()
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * page >> 20

    @lean
    def task(batches):
        for batch in batches:
            rows = [bytes(200) for _ in range(600_000)]  # small blocks, which the allocator keeps
            yield batch.slice(len(rows) % 1)

    before = held()
    assert [b.num_rows for b in task(iter([pa.RecordBatch.from_arrays([pa.array([1, 2])], ["a"])]))] == [2]
    assert task.__name__ == "task" and held() - before < 60
