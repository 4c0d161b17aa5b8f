"""The operators on small tables against brute force, and their defined edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import anisotropic, decontaminate, html_extract, language_id, lm_score, order_minhash, packing, sharding, shared, suffix_dedup, warc

RNG = random.Random(7)
VOCAB = ["".join(RNG.choices("abcdefgh", k=5)) for _ in range(2000)]


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


PASSAGE = text(120)
ROWS = [(i, text(RNG.randint(5, 120)), "en", "s", 1) for i in range(30)]
ROWS += [(30, PASSAGE + " " + text(50), "en", None, 1), (31, text(40) + " " + PASSAGE, "fr", "s", None), (32, None, None, None, None), (33, "", "en", "s", 0), (34, "!!! 123", "en", "s", 7)]
ROWS += [(35, "word " * 8000, "en", "s", 40000), (36, ROWS[0][1], "en", "s", 1), (36, ROWS[0][1], "en", "s", 1), (None, text(60), "en", "s", 1), (37, ROWS[1][1].replace(" ", "  ", 1) + " more", "en", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("start", F.lit(1)).withColumn("score", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, nothing):
    out = packing.pack_documents(docs, with_ids=True).collect()
    assert sum(r["length"] for r in out if r["start"] == 0) > 0 and {r["doc_id"] for r in out} == {r[0] for r in ROWS}
    assert sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out if r["start"] == 0)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)
    assert packing.pack_documents(nothing).count() == 0


def test_sharding(docs, nothing):
    out = sharding.shard_rows(docs, block_rows=5).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(ROWS) and set(counts) <= set(range(40)) and max(counts.values()) <= 1 and sharding.shard_rows(nothing).count() == 0
    few = sharding.shard_rows(docs, shards=3, block_rows=5).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in few if r["shard"] == s) == list(range(len(few) // 3 + (s < len(few) % 3)))
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in few)
    assert sizes == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)


@pytest.mark.parametrize("most", [2000, 1])
def test_repeats(docs, most):
    bodies = [(r[0], (r[1] or "").encode()) for r in ROWS]
    n = 200
    seen = Counter(b[i : i + n] for _, b in bodies for i in range(len(b) - n + 1))
    want = []
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    out = suffix_dedup.remove_repeats(docs, length=n, most_contexts=most).collect()
    assert Counter(tuple(r)[:5] for r in out) == Counter(want) and any(w[2] for w in want)
    assert all(r["n_shared"] > 0 for r in out if r["n_removed"]) and any(r["n_shared"] == 0 for r in out)


def test_repeats_of_a_passage_everywhere_take_few_rows(spark, monkeypatch):
    rng, kind = random.Random(11), type(spark.range(0))
    some = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    tail = some(170)
    rows = [(i, some(rng.randint(90, 140)) + (PASSAGE[:150] if i % 2 else PASSAGE[:20] + "~" * (i % 5) + PASSAGE[20:150]) + tail[: rng.randint(0, 170)] + some(100)) for i in range(60)]
    n, made = 100, {}
    seen = Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    want = {}
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        want[d] = "".join(c for c, x in zip(t, gone) if not x)

    def counted(self, task, *a, f=kind.mapInArrow, **b):
        total = made.setdefault(task.__name__, spark.sparkContext.accumulator(0))

        def run(batches):
            for batch in task(batches):
                total.add(batch.num_rows)
                yield batch

        return f(self, run, *a, **b)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=n, most_contexts=4, with_text=True).collect()
    assert {r["doc_id"]: r["kept_text"] for r in out} == want and sum(map(len, want.values())) < sum(len(t) for _, t in rows)
    single = sum(made[x].value for x in ("windows", "parts") if x in made)
    assert 0 < single < 0.5 * sum(c for c in seen.values() if c > 1)  # every repeated window by itself before


def test_repeats_of_nothing(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("most", [1000, 4])
def test_near_duplicates(spark, most):
    base = text(120).split()
    rows = []
    for i in range(14):
        w = list(base)
        for _ in range(2):
            w[RNG.randrange(120)] = RNG.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(20 + i, text(70) + " " + PASSAGE[:200]) for i in range(14)]
    rows += [(50, None), (51, ""), (52, ""), (53, "!!"), (54, "a b"), (55, "A b."), (None, "x y"), (None, "x y")]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    assert {got[i] for i in range(14)} == {0} and len({got[20 + i] for i in range(14)}) == 14
    assert (got[50], got[51], got[52], got[53], got[54], got[55], got[None]) == (50, 51, 51, 53, 54, 54, None)


@pytest.mark.parametrize("most,look", [(1000, 2000), (7, 0)])
def test_near_duplicates_of_mixed_similarity(spark, most, look):
    rng = random.Random(5)
    bodies, front = [], [rng.choice(VOCAB) for _ in range(50)]
    for i in range(24):  # one beginning; the second of two is near the first, some thirds are near the second alone
        w = list(bodies[-1]) if i % 3 else front + [rng.choice(VOCAB) for _ in range(50)]
        for at in rng.sample(range(50, 100), (0, 16, rng.choice((14, 30)))[i % 3]):
            w[at] = rng.choice(VOCAB)
        bodies.append(w)
    hashes = [np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64) for w in bodies]
    keys = [set(order_minhash.sketches(h, np.array([100]), 9, 5)[0].tolist()) for h in hashes]
    class_of = list(range(24))
    for i in range(24):
        for j in range(i):
            if keys[i] & keys[j] and order_minhash.alike(hashes[i], hashes[j], 0.8):
                a, b = class_of[i], class_of[j]
                class_of = [min(a, b) if c in (a, b) else c for c in class_of]
    got = order_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bodies)], "doc_id long, text string"), most=most, look=look)
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == dict(enumerate(class_of))
    assert 8 <= len(set(class_of)) < 16


def rows_of(spark, name):
    """Rows that the nodes whose description has ``name`` have made in this session."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for k in range(executions.size()):
        number = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for n in range(nodes.size()):
            node = nodes.apply(n)
            for m in range(node.metrics().size() if name in node.desc() else 0):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_a_pair_is_compared_once_however_many_keys_it_shares(spark):
    rng = random.Random(2)
    base, bodies = [rng.choice(VOCAB) for _ in range(200)], []
    for _ in range(40):  # each a ninth away from the base, so that most pairs lie below 0.8
        w = list(base)
        for at in rng.sample(range(200), 23):
            w[at] = rng.choice(VOCAB)
        bodies.append(w)
    hashes = [np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64) for w in bodies]
    keys = [set(order_minhash.sketches(h, np.array([200]), 9, 5)[0].tolist()) for h in hashes]
    class_of, shared = list(range(40)), 0
    for i in range(40):
        for j in range(i):
            shared += len(keys[i] & keys[j]) > 0
            if keys[i] & keys[j] and order_minhash.alike(hashes[i], hashes[j], 0.8):
                a, b = class_of[i], class_of[j]
                class_of = [min(a, b) if c in (a, b) else c for c in class_of]
    before = rows_of(spark, "crossed(")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keys in several tasks
    try:
        got = order_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bodies)], "doc_id long, text string"), look=10_000)
        assert {r["doc_id"]: r["class_id"] for r in got.collect()} == dict(enumerate(class_of)) and len(set(class_of)) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 0.5 * shared < rows_of(spark, "crossed(") - before <= shared


def test_near_duplicates_against_all_pairs(spark, nothing):
    rng = random.Random(11)
    bodies: list[list[str]] = []
    for i in range(140):
        if i % 4 == 0:
            w = [rng.choice(VOCAB) for _ in range(rng.randint(60, 150))]
        else:  # a copy of an earlier text, changed by up to a quarter
            w = list(rng.choice(bodies))
            for at in sorted(rng.sample(range(len(w)), int(rng.random() * 0.25 * len(w))), reverse=True):
                w[at : at + 1] = rng.choice([[rng.choice(VOCAB)], [], [w[at], rng.choice(VOCAB)]])
        bodies.append(w)
    bodies.append([rng.choice(VOCAB) for _ in range(20_000)])
    long = list(bodies[-1])
    for at in range(0, 20_000, 9):
        long[at] = "x"
    bodies.append(long)
    hashes = [np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64) for w in bodies]
    near = [(i, j) for i in range(142) for j in range(i) if order_minhash.alike(hashes[i], hashes[j], 0.8)]
    df = spark.createDataFrame([(f"d{i:03}", " ".join(w), "x", 0) for i, w in enumerate(bodies)], "doc_id string, text string, class_id string, _h int")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(df).collect()}
    same = lambda i, j: got[f"d{i:03}"] == got[f"d{j:03}"]
    assert sum(same(i, j) for i, j in near) >= 0.9 * len(near) and len(near) > 100 and same(140, 141)
    class_of = list(range(142))
    for i, j in near:
        a, b = class_of[i], class_of[j]
        class_of = [min(a, b) if c in (a, b) else c for c in class_of]
    assert all(class_of[i] == class_of[j] for i in range(142) for j in range(i) if same(i, j))
    assert order_minhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 200), (150, 200), (100, 150)]
    got = {r["node"]: r["root"] for r in order_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 100: 100, 150: 100, 200: 100}


def test_components_in_one_task_and_by_stars_agree(spark):
    rng = random.Random(4)
    links = sorted({tuple(sorted(rng.sample(range(400), 2))) for _ in range(250)})
    df = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in links], "a binary, b binary").repartition(5)
    few, stars = order_minhash.components(df), order_minhash.components(df, one_task=0)
    assert "Exchange" not in order_minhash.components(shared.cut(df, "links"))._jdf.queryExecution().executedPlan().toString()
    got = sorted((bytes(r["node"]), bytes(r["root"])) for r in few.collect())
    assert got == sorted((bytes(r["node"]), bytes(r["root"])) for r in stars.collect()) and len(got) == len({x for link in links for x in link})


def test_a_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before, conf = held(), spark.conf.get(name, None)
    out = shared.cut(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count().join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"), "kept")
    for _ in range(20):
        if not (left := held() - before):
            break
        time.sleep(0.25)
    assert not left and out.count() == 7 and spark.conf.get(name, None) == conf


def test_near_duplicates_of_the_pipeline_leave_little_on_disk(spark, docs):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before = held()
    kept = shared.cut(corpus_pipeline.near_duplicates(spark, docs, ""), "kept")
    time.sleep(1)
    assert len(held() - before) < 5 and kept.count() < len(ROWS)


def test_decontamination(spark, docs):
    items = [(1, " ".join(ROWS[3][1].split()[:5])), (2, PASSAGE), (3, text(40)), (4, None), (5, ""), (6, "word word")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(body, item):
        w, v = decontaminate.words_of(body), decontaminate.words_of(item)
        if not v or not w:
            return 0.0
        k = min(5, len(v))
        s, t = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)], Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
        m = min(sum(t.values()), len(s))
        best = 0.0
        for i in range(len(s) - m + 1):
            c = Counter(s[i : i + m])
            best = max(best, sum((c & t).values()) / sum((c | t).values()) if m else 0.0)
        return best

    got = Counter((r["doc_id"], h["item_id"], round(h["similarity"], 6)) for r in decontaminate.benchmark_hits(docs, bench).collect() for h in r["hits"])
    want = Counter((d, i, round(brute(b, t), 6)) for d, b, *_ in ROWS for i, t in items if brute(b, t) >= 0.8)
    assert got == want and len(want) >= 4
    small = decontaminate.benchmark_hits(docs, bench, item_bytes=50)  # several passes
    assert Counter((r["doc_id"], h["item_id"], round(h["similarity"], 6)) for r in small.collect() for h in r["hits"]) == want
    none = decontaminate.benchmark_hits(docs, bench.limit(0))
    assert none.filter(F.size("hits") > 0).count() == 0 and none.count() == len(ROWS)


def test_decontamination_by_shared_items(spark):
    words = [f"w{i}" for i in range(54)]
    changed = words[:27] + ["other"] + words[28:]
    bench = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words) + " !"), (None, text(60)), (4, " ".join(words[:30] + [f"v{i}" for i in range(24)]))]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, bench[3][1]), (3, " ".join(words[2:30] + ["x", "y"]))], "doc_id long, text string")
    found = []
    for size in (4 << 20, 60):  # the blocks do not matter
        out = decontaminate.benchmark_hits(docs, spark.createDataFrame(bench, "item_id long, text string"), item_bytes=size)
        found.append({(r["doc_id"], h["item_id"], round(h["similarity"], 9)) for r in out.collect() for h in r["hits"]})
    assert found[0] == found[1] and {x[:2] for x in found[0]} == {(1, 1), (1, 2), (1, 3), (2, None)}
    named = spark.createDataFrame([(None if i is None else f"i{i}", t) for i, t in bench], "item_id string, text string")
    out = decontaminate.benchmark_hits(docs.withColumn("hits", F.lit("mine")), named, item_bytes=60, hits_col="found").collect()
    assert {(r["doc_id"], h["item_id"]) for r in out for h in r["found"]} == {(1, "i1"), (1, "i2"), (1, "i3"), (2, None)} and {r["hits"] for r in out} == {"mine"}
    with pytest.raises(ValueError, match="hits_col"):
        decontaminate.benchmark_hits(docs.withColumn("hits", F.lit(1)), named)


def test_languages(spark, nothing):
    words = {"a": ["th", "er", "on", "is"], "b": ["eau", "ch", "ou", "ai"]}
    make = lambda k, n: " ".join("".join(RNG.choices(words[k], k=3)) for _ in range(n))
    rows = [(i, make("ab"[i % 2], RNG.randint(3, 60)), "ab"[i % 2]) for i in range(200)] + [(200, None, "a"), (201, "", "b"), (202, "12 !!", "a"), (203, make("a", 6000), None), (None, make("b", 9), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language_id.predict_languages(df, F.col("doc_id") < 150, with_words=True).collect()}
    assert all(out[i]["lang_pred"] == "ab"[i % 2] for i in range(200)) and out[203]["lang_pred"] == "a" and len(out[203]["word_langs"]) == 6000
    assert [out[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and out[None]["lang_pred"] == "b"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    unlabelled = language_id.predict_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"} and language_id.predict_languages(nothing).count() == 0


def test_tasks_of_scores_give_unused_memory_back(docs, monkeypatch):
    ran, kind = [], type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, task, *a, f=kind.mapInArrow, **b: ran.append(task) or f(self, task, *a, **b))
    assert lm_score.score_texts(docs, F.col("doc_id") % 3 != 1, frequent=20, fit_rows=20).count() == len(ROWS)
    assert len(ran) >= 8 and all(hasattr(task, "__wrapped__") for task in ran)


def test_scores_take_a_bounded_run_of_ids_at_a_time(docs, monkeypatch):
    import pyarrow as pa

    tasks, kind, scores, sizes = {}, type(docs), lm_score.AttentionModel.scores, []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, task, *a, f=kind.mapInArrow, **b: tasks.update({task.__name__: task}) or f(self, task, *a, **b))
    lm_score.score_texts(docs, F.col("doc_id") % 3 != 1, frequent=20, fit_rows=20)
    monkeypatch.setattr(lm_score.AttentionModel, "scores", lambda self, flat, n, *a: sizes.append(len(flat)) or scores(self, flat, n, *a))
    bodies = [text(RNG.randint(0, 900)) for _ in range(500)] + [None, "", text(40000), "A b."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies))), pa.array(bodies, pa.string()), pa.array([True] * len(bodies))], ["_id", "_text", "_train"])
    together = [r for b in tasks["score"](iter([batch])) for r in b.to_pylist()]
    assert len(sizes) > 3 and sum(sizes) > 4 << 17 and max(sizes) < 400_000
    few = [*range(0, 500, 50), *range(500, 504)]
    alone = [r for k in few for b in tasks["score"](iter([batch.slice(k, 1)])) for r in b.to_pylist()]
    assert [r["_id"] for r in together] == list(range(504)) and [r["score"] for r in alone] == pytest.approx([together[k]["score"] for k in few], rel=1e-5)
    assert [r["_n"] for r in together] == [len((t or "").split()) + 1 for t in bodies]


def test_scores(docs, nothing):
    train = F.col("doc_id") % 3 != 1
    out = lm_score.score_texts(docs, train, frequent=20, fit_rows=20).collect()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [(d, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)) + [0]) for d, t, *_ in ROWS]
    c = Counter(w for d, ws in tokens if d is not None and d % 3 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for d, ws in tokens)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    assert lm_score.score_texts(nothing, train).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 7))
    x[200:260] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 7), (302, [float("nan")] * 7), (303, [1.0, None, *[1.0] * 5]), (None, [1.0] * 7), (304, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = anisotropic.nearest_neighbours(df, F.col("vec_id") % 10 == 0, row_block=70, query_block=9).collect()
    hits = total = 0
    for q in range(0, 300, 10):
        s = [(-float(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q])), i) for i, v in enumerate(x) if i != q]
        want = [i for _, i in sorted((round(a, 12), i) for a, i in s)[:5]]
        got = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        hits, total = hits + len(set(want) & set(got)), total + 5
        if q == 10:
            assert got == want == [200, 201, 202, 203, 204]
    assert hits / total >= 0.9
    assert anisotropic.nearest_neighbours(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("kind", ["cluster", "table"])
def test_neighbours_beyond_the_shortlist(spark, data, kind):
    if kind == "cluster":  # near copies, not equal: many rows share their codes
        rng = np.random.default_rng(8)
        x = rng.normal(size=(900, 16))
        x[100:500] = x[7] + 1e-3 * rng.normal(size=(400, 16))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    else:
        df = spark.read.parquet(f"{data}/embeddings.parquet")
        x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    ids = [r["vec_id"] for r in df.select("vec_id").orderBy("vec_id").collect()]
    got = {}
    for r in anisotropic.nearest_neighbours(df, F.col("vec_id") % 10 == 0, rerank=10).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    assert set(got) == {i for i in ids if i % 10 == 0}
    for q, scores in got.items():
        cosine = np.delete(unit @ unit[ids.index(q)], ids.index(q))
        assert np.allclose(scores, np.sort(cosine)[::-1][:5], atol=1e-12, rtol=0), q


def test_revisits(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: \"x\"\r\nDate: old\r\n\r\nbody"
    head = b"HTTP/1.1 304 Not Modified\r\nETag: W/\"x\"\r\nDate: new\r\nContent-Type: other\r\n\r\n"
    record = lambda i, kind, url, time, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {i}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {time}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(
        record("1", "response", "http://WWW.e.org:80/a/?b=1&utm_x=2&a=2#f", "2024-01-01T00:00:00Z", http) + record("2", "response", "https://e.org/a?a=2&b=1", "2024-01-03T00:00:00Z", http.replace(b'"x"', b'"y"'))
        + record("3", "revisit", "https://e.org/a?b=1&a=2", "2024-03-01T00:00:00Z", head) + record("4", "revisit", "https://e.org/a?b=1&a=2", "2024-01-01T00:00:00Z", head)
        + record("5", "revisit", "https://e.org/a?b=1&a=2", "2024-01-04T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\n\r\n") + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut"
    )
    rows = warc.read_warc(spark, str(tmp_path))
    assert rows.count() == 5
    out = {r["record_id"]: r for r in warc.resolve_revisits(rows).collect()}
    assert out["3"]["source_id"] == "1" and out["3"]["headers"] == {"content-type": "text/html", "etag": 'W/"x"', "date": "new"}
    assert out["4"]["source_id"] is None and out["5"]["source_id"] == "2" and set(out) == {"3", "4", "5"}
    assert warc.resolve_revisits(rows.limit(0)).count() == 0


MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">item {i}</a></li>' for i in range(8)) + "</ul></nav>"
STORY = "".join(f"<p>{text(25)}, and it ends here.</p>" for _ in range(6))


def page(body, foot="<footer>&copy; somebody, all rights</footer>"):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{MENU}{body}{foot}</body></html>"


def test_main_texts(spark):
    long = "".join(f"<p>{text(20)}.</p>" for _ in range(4000))
    rows = [(1, page(f"<article><h1>Head</h1>{STORY}</article>")), (2, None), (3, ""), (4, page(f"<main>{long}</main>")), (5, page(f"<article>{STORY}</article>")), (5, page(f"<article>{STORY}</article>")), (None, "<p>only &amp; lonely</p>"), (6, "<a " * 300_000)]
    df = spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, h in rows], "page_id long, url string, html string, label string, u int").withColumn("_u", F.lit(1))
    out = {}
    for r in html_extract.extract_main_text(df).collect():
        assert r["n_chars"] == len(r["text"]) and out.setdefault(r["page_id"], r["text"]) == r["text"]
    plain = lambda h: re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", h)).strip()
    assert out[1] == "Head " + plain(STORY) and out[5] == plain(STORY) and out[4] == plain(long)
    assert out[2] == out[3] == out[6] == ""
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="names of the result"):
        html_extract.extract_main_text(df.withColumnRenamed("label", "text"), carry=("page_id", "text"))


def test_weights_are_learned_from_pages_that_name_their_parts(spark):
    df = spark.createDataFrame([(i, "u", page(f"<article>{STORY}</article>") + f"<!-- {i} -->") for i in range(30)], "page_id long, url string, html string")
    w = html_extract.learn_weights(df, fit_pages=20)
    names = dict(zip(html_extract.FEATURES, w))
    assert not np.allclose(w, html_extract.PRIOR) and names["links"] < 0 < names["words"]
    bare = page(f"<div>{STORY}</div>").replace("nav>", "div>").replace("footer>", "div>")  # nothing is named
    assert html_extract.content_blocks(bare, w) == html_extract.content_blocks(f"<article>{STORY}</article>", w)
    assert np.array_equal(html_extract.learn_weights(df.limit(0)), html_extract.PRIOR)


def test_the_cut_changes_labels():
    body = STORY.replace("</p><p>", '</p><p>see there</p><p>', 1)
    texts, z, keep = html_extract.labelled(page(f"<div>{body}</div>"), html_extract.PRIOR, 3.0, 1.5)
    at = texts.index("see there")
    assert z[at] < 0 and keep[at]  # a short line among paragraphs stays with them
    alone, z, keep = html_extract.labelled(page('<div><p>see there</p></div><ul><li><a href="/b">b</a></li></ul>'), html_extract.PRIOR, 3.0, 1.5)
    assert not keep[alone.index("see there")]
    cut = html_extract.labelled(page(f"<div>{body}</div>"), html_extract.PRIOR, 0.0, 0.0)
    assert cut[2] == [x > 0 for x in cut[1]]


@pytest.mark.parametrize("unit", ["<a ", "<p title='", '<div class="', "<!--", "<div>", "<b>x", "</p>", "<div></span>", "<i></b>", "&amp;<", "<script>", "<li><a href=x>y"])
def test_broken_pages_are_read_in_linear_time(unit):
    import time

    start = time.process_time()
    html_extract.content_blocks(unit * (600_000 // len(unit)))
    assert time.process_time() - start < 8


def test_attributes_by_the_rules():
    story = "<p>Hello there world, this is the story of the day.</p>"
    for tag in ('<p title="a"b">', "<p title='>'>", "<p a=b/c>", '<p x="<p>">', "<p =x=y>", "<p\n/class=z>"):
        assert html_extract.content_blocks(f"<article>{tag}Hello there world.</p>{story}</article>")[0] == "Hello there world."


def test_edges_of_other_operators(spark, nothing):
    rows = [(1, "the same words here", "en"), (1, "the same words here", "en"), (2, "½ ²", "en"), (None, None, None), (3, "das ist ein satz", "de")] + [(10 + i, f"the words of row {'abcdefghij'[i % 10] * 3}", "en") for i in range(30)] + [(50 + i, f"das ist der satz {'abcdefghij'[i % 10] * 3}", "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict_languages(df, carry=()).collect()]
    assert len(out) == len(rows) and len({x for x in out if x[0] == 1}) == 1 and {x[1] for x in out if x[0] in (2, None)} == {"und"}
    with pytest.raises(ValueError, match="names of the result"):
        language_id.predict_languages(df, carry=("score",))
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (50, [1.0, 0.1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("x"), "_v": F.lit(0), "_u": F.lit(0)})
    for block in (20_000, 1):
        got = [tuple(r) for r in anisotropic.nearest_neighbours(df, F.col("vec_id") % 50 == 0, query_block=block).orderBy("query_id", "rank").collect()]
        assert [x[:3] for x in got] == [(50, 1, 1), (50, 2, 2), (50, 3, 3), (50, 4, 1)]


def test_revisits_of_odd_records(spark):
    schema = "record_id string, type string, url string, time string, status int, headers map<string,string>, profile string, canonical string"
    full = lambda i, t, url="http://e.org/a", h=None: (i, "response", url, t, 200, h if h is not None else {"etag": '"x"'}, None, "clash")
    ask = lambda i, t, url="http://e.org/a", h=None, status=304, profile=None: (i, "revisit", url, t, status, h, profile, "clash")
    rows = [
        full("1", "2024-01-01 00:00:00"), full("2", "2024-01-01 00:00:00"), full("2", "2024-01-01 00:00:00"), full("3", None), full("4", "2024-01-02 00:00:00", None),
        ask("a", "2024-01-05 00:00:00"), ask("a", "2024-01-05 00:00:00"), ask("b", None), ask("c", "2024-01-05 00:00:00", None), ask("d", "2024-01-01 00:00:00"),
        ask("e", "2024-01-05 00:00:00", status=200, profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ask("f", "2024-01-05 00:00:00", status=None, profile="http://netpreserve.org/warc/1.1/revisit/server-not-modified"),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("time", F.to_timestamp("time"))
    got = Counter((r["record_id"], r["source_id"]) for r in warc.resolve_revisits(df).collect())
    assert got == Counter({("a", "2"): 2, ("b", None): 1, ("c", None): 1, ("d", None): 1, ("f", "2"): 1})


def test_pipeline_stages(spark, data, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert [f.name for f in out.schema] == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = docs.count()
    assert 100 < kept < 200
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_each_training_text_moves_the_model(spark):
    """Texts of the same ids and neighbours in another order: only the weights can tell."""
    rng = random.Random(3)
    rows = [(i, " ".join(["a", *(w for _ in range(40) for w in (rng.choice("bcdefg"), "a"))])) for i in range(12)]
    ask = (100, " ".join(["a b a c a g"] * 20))

    def score(texts):
        df = spark.createDataFrame([*texts, ask], "doc_id long, text string").coalesce(1)
        return lm_score.score_texts(df, F.col("doc_id") < 100, fit_rows=1).filter("doc_id = 100").first()["score"]

    as_is = score(rows)
    for k in (2, 5, 8):
        inner = rows[k][1].split()[1::2]
        turned = " ".join(["a", *(w for x in sorted(inner) for w in (x, "a"))])
        assert score([(i, turned if i == k else t) for i, t in rows]) != as_is, k


def test_a_carried_text_is_sent_once(spark):
    rows = [(i, ("abba anna " if i % 2 else "xyzz yxxz ") * 5, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.predict_languages(df, carry=("text", "lang"))
    sent = out._jdf.queryExecution().analyzed().children().apply(0).output()
    assert sent.size() == 3  # id, text, lang
    assert all(r["lang_pred"] == r["lang"] and r["text"] == rows[r["doc_id"]][1] for r in out.collect()) and out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r["lang_pred"] for r in language_id.predict_languages(df, id_col="text").collect()} == {"a", "b"}  # the text as id
