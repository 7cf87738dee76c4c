"""Fits against exact solutions and differences, bounds of what tasks hold, the chat log's history, the pipeline's rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import chat, common, labelled, langid, mixing, quality, queries, repetition, sstable, toxicity

SF = "/root/testdata/sf0.001"


# ---- 3 -----------------------------------------------------------------------------


def exact_dual(x, y, cost):
    """The dual's solution by trying which variables are 0, at their bound or between."""
    n, gram = len(y), (x @ x.T + 1) * np.outer(y, y)
    best = None
    for kind in itertools.product((0, 1, 2), repeat=n):
        alpha = np.where(np.array(kind) == 1, cost, 0.0)
        free = np.flatnonzero(np.array(kind) == 2)
        if len(free):
            solved = np.linalg.lstsq(gram[np.ix_(free, free)], 1 - gram[free] @ alpha, rcond=None)[0]
            if (solved < -1e-12).any() or (solved > cost[free] + 1e-12).any():
                continue
            alpha[free] = solved
        value = alpha.sum() - 0.5 * alpha @ gram @ alpha
        if best is None or value > best[0]:
            best = (value, alpha)
    alpha = best[1]
    return (alpha * y) @ x, (alpha * y).sum()


def test_dual_descent_reaches_the_exact_solution():
    rng = np.random.default_rng(1)
    for turn in range(8):
        n, width = 6, 9
        has = rng.random((n, width)) < 0.5
        values = rng.normal(size=width)
        y = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)
        cost = rng.uniform(0.05, 0.8, n)
        w, bias = quality.dual_descent([np.flatnonzero(h) for h in has], values, y, cost, rounds=3000, seed=turn)
        want_w, want_bias = exact_dual(has * values, y, cost)
        assert np.allclose(w, want_w, atol=1e-6) and abs(bias - want_bias) < 1e-6


def test_scores_by_hand(spark, make):
    texts = ["good words here", "bad junk there", "", "good good bad"]
    model = quality.fit([quality.features(np.frombuffer(t.encode(), np.uint8), np.zeros(quality.SIZE, bool)) for t in [f"{w} {k}" for k in range(20) for w in ("good", "bad")]], np.array([1, 0] * 20))
    got = {r.doc_id: r.score for r in quality.score(make(list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        b = t.encode()
        found = {*b} | {256 + (x << 8 | y) for x, y in zip(b, b[1:])}
        found |= {256 + 65536 + (((x << 16 | y << 8 | z) * 0x9E3779B1 & 0xFFFFFFFF) >> 15) for x, y, z in zip(b, b[1:], b[2:])}
        margin = sum(np.float32(model.weight[f]) for f in found) + model.bias
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))) < 1e-4
    assert got[0] > got[1]


# ---- 5 -----------------------------------------------------------------------------


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    model = toxicity.Model()
    model.table, model.out, model.bias = model.table.astype(float), model.out.astype(float), rng.normal(size=2)
    bucket, size = np.array([3, 9, 9, 40, 3, 77]), np.array([2, 3, 1])  # three words
    word, share, row = np.array([0, 1, 1, 2]), np.array([0.5, 0.5, 0.75, 0.25]), np.array([0, 0, 1, 1])
    label, importance = np.array([1, 0]), np.array([0.7, 1.9])

    def loss(table, out, bias):
        ends = np.cumsum(size)
        words = [table[bucket[e - n : e]].mean(0) for e, n in zip(ends, size)]
        total = 0.0
        for r in range(2):
            mean = sum(s * words[w] for w, s, k in zip(word, share, row) if k == r)
            z = mean @ out + bias
            total += importance[r] * (np.log(np.exp(z).sum()) - z[label[r]])
        return total

    table, out, bias = model.table.copy(), model.out.copy(), model.bias.copy()
    rate, eps = 1e-3, 1e-5
    model.step(bucket, size, word, share, row, label, rate, importance)

    def slope(which, at):
        sides = []
        for sign in (1, -1):
            parts = [table.copy(), out.copy(), bias.copy()]
            parts[which][at] += sign * eps
            sides.append(loss(*parts))
        return (sides[0] - sides[1]) / (2 * eps)

    # out moves before the table is read through it: the table's slope is that of the step's beginning
    for at in [(b, k) for b in (3, 9, 40, 77) for k in range(0, toxicity.WIDTH, 7)]:
        assert abs((table[at] - model.table[at]) / rate - slope(0, at)) < 1e-4
    slow = toxicity.SOFTMAX_RATE * rate / 2
    for at in [(0, 0), (3, 1), (toxicity.WIDTH - 1, 0)]:
        assert abs((out[at] - model.out[at]) / slow - slope(1, at)) < 1e-3
    for at in (0, 1):
        assert abs((bias[at] - model.bias[at]) / slow - slope(2, at)) < 1e-3
    untouched = np.setdiff1d(np.arange(len(table)), bucket)
    assert np.array_equal(model.table[untouched], table[untouched])


def test_scores_are_those_of_the_worst_passage(make, prose):
    rng = np.random.default_rng(5)
    model = toxicity.Model()
    model.table, model.slope, model.shift = rng.normal(size=model.table.shape).astype(np.float32), 2.0, -0.3
    texts = ["", "one", prose(30, 1), prose(toxicity.PASSAGE * 4 + 7, 2), "same " * 50 + prose(200, 3)]
    got = {r.doc_id: r.score for r in toxicity.score(make(list(enumerate(texts))), model).collect()}
    pull = model.collapsed()
    for k, text in enumerate(texts):
        words = [w for w, before in zip(text.split(), [None, *text.split()]) if w != before]
        values = []
        for w in words:
            data = np.frombuffer(w.encode(), np.uint8)
            bucket, which, _ = toxicity.subwords(data, np.array([0, len(data)]))
            values.append(pull[bucket].mean())
        starts = [0] if len(words) <= toxicity.PASSAGE else [*range(0, len(words) - toxicity.PASSAGE, toxicity.STRIDE), len(words) - toxicity.PASSAGE]
        worst = max((np.mean(values[a : a + toxicity.PASSAGE]) for a in starts), default=0.0) if words else 0.0
        margin = 2.0 * (worst + float(model.bias[1] - model.bias[0])) - 0.3
        assert abs(got[k] - 1 / (1 + np.exp(-margin))) < 1e-4


# ---- the labelled sample -----------------------------------------------------------


@pytest.mark.parametrize("long_first", [True, False])
def test_a_long_text_does_not_empty_the_sample(spark, make, prose, long_first):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    order = [r.k for r in spark.createDataFrame([(k,) for k in ids], "k long").orderBy(F.xxhash64("k")).collect()]
    giant = order[0] if long_first else order[-1]
    docs = make([(k, prose(20_000, 1) if k == giant else prose(80, k)) for k in ids])
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    some = labelled.sample(docs, labels, "quality", 3, 1, 3000, 20_000).collect()
    assert len(some) > 10 and giant not in {r.doc_id for r in some} and {r.label for r in some} == {0, 1}
    assert sum(len(r.text.encode()) for r in some) <= 20_000
    model = quality.fit_on(docs, labels, per_class=3000)
    assert len({round(r.score, 6) for r in quality.score(docs, model).collect()}) > 5


# ---- 8 -----------------------------------------------------------------------------


def test_learning_in_small_parts_is_the_same(make, monkeypatch, prose):
    docs = make([(k, prose(60, k), f"l{k % 5}", "s", 0) for k in range(40)])
    want = langid.learn(docs)
    monkeypatch.setattr(langid, "WAITING", 200)
    monkeypatch.setattr(langid, "SUMS", 300)
    got = langid.learn(docs)
    assert want.keys() == got.keys() and all(np.array_equal(want[k], got[k]) for k in want)


def test_profiles_of_many_languages_are_lists():
    rng = np.random.default_rng(3)
    n = langid.MOST_LANGUAGES
    pool = rng.choice(1 << 40, 200_000, replace=False).astype(np.uint64)
    profiles = {f"l{k:05d}": pool[rng.choice(len(pool), langid.TOP, replace=False)] for k in range(n - 1)}
    text = "some words that are told apart by their letters"
    profiles["mine"] = langid.top(*langid.counted(langid.grams(text)))
    own = langid.Profiles(profiles)
    assert sum(x.nbytes for x in (own.every, own.start, own.lang, own.rank)) < 64 << 20
    lang, score, far = own.predict(text)
    assert lang == "mine" and far == 0.0 and score == 1.0


def test_too_many_languages_are_told_before_learning(make, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="3 languages"):
        langid.learn(make([(k, "words", f"l{k}", "s", 0) for k in range(3)]))


# ---- 4, 6, stored steps ------------------------------------------------------------


def test_the_querys_log_holds_every_kind_of_event(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").unionByName(spark.createDataFrame([(-7, 0, "assistant", None), (-7, 1, None, "odd"), (-7, 2, "assistant", "")], "conv_id long, turn long, role string, text string"))
    log = chat.history_of(rows)
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert log.count() == 3 * rows.count() and set(kinds) == {"delta", "edit", "regenerate"} and kinds["delta"] == 2 * rows.count()
    want, got = ({r.conv_id: (r.turns, r.loss_texts) for r in chat.parse(chat.format_log(x)).collect()} for x in (chat.log_of(rows), log))
    assert want == got


def test_shards_are_bounded_by_bytes(spark, make, prose, monkeypatch, tmp_path):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 5_000)
    make([(k, prose(200, k)) for k in range(200)]).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert common.estimated_bytes(docs) > 50_000 and common.estimated_bytes(make([(1, "a")])) is None
    shards = sstable.write_shards(docs, queries.tokenizer("word_bpe_49k.json"), 1)
    assert shards.count() > 8 and sstable.read_shards(shards).count() == 200


def test_stored_steps_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_steps", [])
    places = iter(range(9))

    def scratch(_):
        common._steps.append(f"file://{tmp_path}/step-{next(places)}")
        return common._steps[-1]

    monkeypatch.setattr(common, "scratch", scratch)
    assert common.stored(spark.range(3)).count() == 3
    with pytest.raises(Exception, match="no number"):
        common.stored(spark.range(3).select(F.raise_error(F.lit("no number"))))
    assert [p.name for p in tmp_path.iterdir()] == ["step-0"]
    common.clean(spark)
    assert not list(tmp_path.iterdir())


# ---- the pipeline ------------------------------------------------------------------


def test_pipeline_stages_keep_the_right_rows(make, prose, spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    rows = [(k, prose(120 + k, 100 + k)) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # copies
    near = rows[7][1].split()
    rows += [(110, " ".join([*near[:-1], "changed"])), (111, " ".join(["a", *near]))]  # near copies
    bad = {200: None, 201: "", 202: "12 34 !!", 203: prose(10, 9), 204: "again and again " * 40, 205: "# " + "* $ " * 200 + prose(60, 4)}
    rows += list(bad.items())
    rng.shuffle(rows)
    docs, kept = make(rows), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.sparkSession.catalog.clearCache()
        out = stage(spark, docs, "unused")
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    texts = dict(rows)
    assert sorted(kept[0]) == sorted(k for k, t in rows if re.search(r"[^\W\d_]", t or ""))
    assert set(kept[0]) - set(kept[1]) == {203, 204, 205}
    assert sorted(kept[1]) == sorted(r.doc_id for r in repetition.measure_rules(make([(k, texts[k]) for k in kept[0]])).filter("kept").collect())
    assert sorted(kept[2]) == list(range(40))
    n = {k: len(texts[k].split()) for k in kept[2]}
    recipe = corpus_pipeline.RECIPE
    assert len(set(kept[3])) == len(kept[3]) and set(kept[3]) <= set(kept[2])
    assert sorted(kept[3]) == sorted(r.doc_id for r in mixing.mix(make([(k, texts[k]) for k in kept[2]]), recipe).filter("epochs > 0").collect())
    assert 0 < sum(n[k] for k in kept[3]) <= sum(n.values())
    from tokenizers import Tokenizer

    count = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {k: len(count.encode(texts[k], add_special_tokens=False).ids) + 1 for k in kept[3]}
