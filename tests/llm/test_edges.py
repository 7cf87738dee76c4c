"""Null, empty, long, tied, repeated and clashing rows for every operator; empty tables."""

import pytest

from voxloom.llm import chat, fingerprints, langid, mixing, neardup, packing, quality, queries, repetition, sstable, toxicity

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture()
def odd(make, prose):
    long = prose(6000, 1)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same words here again"), (5, "same words here again"), (7, "é 日本 <|im_end|> \\ x"), (None, "no number at all"), (9, long), (10, prose(80, 2))]
    return make(rows, extra=True), rows


def ids(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)


def wanted(rows):
    return sorted((r[0] is not None, r[0] or 0) for r in rows)


def test_fingerprints(odd, make):
    docs, rows = odd
    out = fingerprints.simhash_edits(docs).collect()
    assert ids(out) == wanted(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[4][0].fingerprint == by[9][0].fingerprint
    assert by[2][0].fingerprint == by[3][0].fingerprint == "0" * 32
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    assert fingerprints.simhash_edits(make([])).count() == 0


def test_repetition(odd, make):
    docs, rows = odd
    out = repetition.measure_rules(docs).collect()
    assert ids(out) == wanted(rows)
    assert {r.doc_id: r.kept for r in out if r.doc_id in (1, 2, 3)} == {1: False, 2: False, 3: False}
    assert repetition.measure_rules(make([])).count() == 0
    assert repetition.keep_good(docs).columns == docs.columns


def test_classifiers(odd, make, spark):
    docs, rows = odd
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module in (quality, toxicity):
        for some in (labels, none):
            out = module.score(docs, module.fit_on(docs, some)).collect()
            assert ids(out) == wanted(rows)
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
        assert module.score(make([]), module.fit_on(make([]), none)).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, n string"
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "", "x"), (2, 0, None, "a", "x"), (2, 0, None, "a", "x"), (None, None, "assistant", "b\\<|", "x"), (3, 5, "us\ner", "<|im_start|>", "x")]
    out = {r.conv_id: r for r in chat.digests(chat.parse(chat.format_log(chat.log_of(spark.createDataFrame(rows, schema))))).collect()}
    assert {k: v.n_turns for k, v in out.items()} == {1: 2, 2: 2, None: 1, 3: 1}
    assert out[None].loss_chars == 4
    assert chat.format_log(chat.log_of(spark.createDataFrame([], schema))).count() == 0


def test_shards(odd, make):
    docs, rows = odd
    out = sstable.read_shards(sstable.write_shards(docs, queries.tokenizer(WORD), 1)).collect()
    assert ids(out) == wanted(rows)
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    assert sstable.read_shards(sstable.write_shards(make([]), queries.tokenizer(WORD), 1)).count() == 0


def test_mixing(odd, make):
    docs, rows = odd
    assert ids(mixing.mix(docs).collect()) == wanted(rows)
    assert mixing.mix(make([])).count() == 0


def test_languages(odd, make):
    docs, rows = odd
    profiles = langid.learn(docs)
    out = langid.predict(docs, profiles).collect()
    assert ids(out) == wanted(rows)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.learn(make([])) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_near_duplicates(odd, make):
    docs, rows = odd
    out = neardup.near_duplicates(docs).collect()
    assert ids(out) == wanted(rows)
    by = {r.doc_id: r for r in out}
    assert by[9].component_id == 4 and not by[9].kept
    assert by[2].component_id == 2 and by[2].n_shingles == 0 and by[1].kept
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(make([])).count() == 0


def test_packing(odd, make):
    docs, rows = odd
    out = packing.pack(docs, queries.tokenizer(BYTE), 0).collect()
    assert ids([r for r in out if r.piece == 0]) == wanted(rows)
    assert packing.pack(make([]), queries.tokenizer(BYTE), 0).count() == 0


def test_repeated_doc_id_with_other_texts(make, prose):
    one, two, three = (prose(200, seed) for seed in (101, 102, 103))
    near = lambda text, k: text + f" tail{k}"
    rows = [(5, one), (7, near(one, 7)), (5, two), (9, near(two, 9)), (3, near(three, 3)), (5, three), (5, one)]
    out = {(r.doc_id, r.h): r.component_id for r in neardup.labelled(make(rows)).collect()}
    assert sorted((d, c) for (d, _), c in out.items()) == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (9, 5)]
    got = sorted((r.doc_id, r.text) for r in neardup.keep_first(make(rows, extra=True)).collect())
    assert got == sorted([(5, one), (5, one), (5, two), (3, near(three, 3))])


def thue_morse(n, a="a", b="b"):
    """Two words of 2**n letters that differ in every letter; polynomial hashes modulo 2**64 can't tell them apart."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_words_of_a_regular_pattern_are_told_apart(make):
    x, y = thue_morse(11)
    out = {r.doc_id: r for r in neardup.near_duplicates(make([(1, x), (2, y)])).collect()}
    assert out[1].kept and out[2].kept and out[2].component_id == 2
    (r,) = repetition.measure_rules(make([(1, f"{x}\n{y}")])).collect()
    assert r.n_dup_lines == 0 and r.line_coverage == 0


def test_classes_that_share_their_smallest_doc_id(make, prose):
    one, two = prose(100, 201), prose(100, 202)
    near = lambda text: " ".join(["other", *text.split()[1:]])
    out = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(make([(1, one), (1, two), (2, near(one)), (3, near(two))])).collect())
    assert out == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_blocks_of_postings_and_groups(make, prose, monkeypatch):
    """Hot keys by broadcast and postings of several blocks give what one block gives."""
    from voxloom.llm import common

    from .test_operators import brute_components, variants

    texts = variants(prose, 150, seed=3) + variants(prose, 60, 60, 12, seed=9) + [prose(40, k) for k in range(20)] * 2
    rows = list(enumerate(texts, 500))
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(neardup, "BLOCK_SIGNATURES", 13)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 19)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(make(rows)).collect()}
    assert got == brute_components(rows)


@pytest.fixture(scope="module")
def giant():
    """A text far longer than a chunk (some 1.6 MB)."""
    import random

    rng = random.Random(8)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(250_000))


def test_very_long_texts(make, giant):
    rows = [(1, giant), (2, "short text of five words"), (3, giant + " end")]
    docs = make(rows)
    prints = {r.doc_id: r for r in fingerprints.simhash_edits(docs).collect()}
    assert prints[1].n_chars == len(giant) and prints[1].near_edited > 0.5
    rules = {r.doc_id: r for r in repetition.measure_rules(docs).collect()}
    assert rules[1].n_words == 250_000 and rules[3].n_words == 250_001
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.learn(docs)).collect()} == {1: "en", 2: "en", 3: "en"}
    comps = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert comps == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_tokens for r in mixing.mix(docs).collect()} == {1: 250_000, 2: 5, 3: 250_001}


def test_fingerprints_within_the_radius(spark, monkeypatch):
    """Both levels of tables against all pairs; prints in a narrow ball, so buckets are large."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    base = int.from_bytes(rng.bytes(16), "big")
    prints = {base}
    while len(prints) < 150:
        x = base
        for p in rng.choice(128, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(p)
        prints.add(x)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "rid long, f1 long, f2 long")
    want = {(a, b) for a, p in enumerate(prints) for b, q in enumerate(prints) if a < b and (p ^ q).bit_count() <= 3}
    for split in (512, 4):
        monkeypatch.setattr(fingerprints, "SPLIT", split)
        got = [(r.a, r.b) for r in fingerprints.search(df, 3).select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_neighbours_of_fingerprints(make, prose):
    long = prose(3000, 11)
    rows = [(k, long + f" tail{k}") for k in range(6)] + [(10, long + " tail0"), (11, prose(50, 12)), (12, None), (13, "")]
    out = {r.doc_id: r for r in fingerprints.simhash_edits(make(rows)).collect()}
    prints = {r.fingerprint for r in out.values()}
    for k, r in out.items():
        near = sum(0 < (int(r.fingerprint, 16) ^ int(p, 16)).bit_count() <= 3 for p in prints)
        assert r.n_within == near, k
        assert r.print_class == min(j for j, s in out.items() if s.fingerprint == r.fingerprint)


def test_chat_ties_nulls_and_escapes(spark):
    schema = "conv_id long, seq long, kind string, turn long, role string, text string"
    rows = [
        (1, 1, "delta", 0, "user", "A"), (1, 2, "delta", 0, "user", "DELTA"), (1, 2, "edit", 0, "user", "EDIT"),
        (2, 1, "edit", 0, "user", "E1"), (2, 1, "edit", 0, "user", "E2"),
        (3, None, "delta", 0, "user", "first "), (3, 1, "delta", 0, "user", "then"), (3, 1, "delta", 0, "user", "then"),
        (4, 1, "delta", 0, "a\\nb\nc\\\n<|", "<\\|\\\\<|"),
        (5, 1, "delta", 0, "assistant", "x" * 300_000),
    ]
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.format_log(spark.createDataFrame(rows, schema))).collect()}
    assert out == {1: [("user", "EDIT")], 2: [("user", "E2")], 3: [("user", "first thenthen")], 4: [(rows[8][4], rows[8][5])], 5: [("assistant", "x" * 300_000)]}


def test_roles_come_back_exactly(spark):
    import itertools

    roles = ["".join(p) for n in range(5) for p in itertools.product("\\\nn<|", repeat=n)]
    log = spark.createDataFrame([(i, 0, "delta", 0, role, role) for i, role in enumerate(roles)], "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {r.conv_id: (r.turns[0].role, r.turns[0].text) for r in chat.parse(chat.format_log(log)).collect()}
    assert got == {i: (role, role) for i, role in enumerate(roles)}


def test_mixing_repeated_rows_and_names(make, prose):
    from pyspark.sql import functions as F

    rows = [(k, prose(20, k), "en", "src1", 1) for k in range(40)] + [(7, prose(20, 7), "en", "src1", 1)] * 30
    docs = make(rows)
    for name in ("domain", "n_tokens", "epochs", "leaf", "drawn", "cut", "row", "text_md5"):
        docs = docs.withColumn(name, F.lit(name))
    recipe = mixing.Recipe(budget_percent=50, max_epochs=1)
    out = mixing.mix(docs, recipe).collect()
    assert len(out) == 70 and len({r.epochs for r in out if r.doc_id == 7}) == 1
    kept = mixing.take(docs, recipe)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.epochs)
    assert sum(r.n_tokens for r in out if r.epochs) >= 0.5 * sum(r.n_tokens for r in out)


def test_language_profiles_by_brute_force(make):
    import unicodedata
    from collections import Counter

    texts = [(1, "Abc abd É日本 x"), (2, "abc\tabc 12 ab"), (3, None), (4, "zzz"), (4, "zzz"), (5, "...")]
    langs = {1: "en", 2: "en", 3: "en", 4: "fr", 5: None}
    rows = [(k, t, langs[k], "src1", 1) for k, t in texts]
    want: dict = {}
    for k, t, lang, *_ in rows:
        if not t or not lang:
            continue
        words = "".join(c if unicodedata.category(c).startswith("L") else " " for c in t.lower()).split()
        for w in words:
            w = f"\1{w}\1"
            for n in (1, 2, 3):
                want.setdefault(lang, Counter()).update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != "\1")
    # one word's end is the next word's beginning: it counts once in pairs of letter and end
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    got = langid.learn(make(rows))
    assert set(got) == set(want)
    for lang, grams in want.items():
        ranked = [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][: langid.TOP]
        assert got[lang].tolist() == ranked


def test_labels_null_tied_and_repeated(make, spark, prose):
    docs = make([(k, prose(30, k) + (" good" if k % 2 else " bad bad")) for k in range(60)] + [(5, "another text"), (6, None)])
    rows = [(k, k % 2, k % 2) for k in range(60)] + [(3, 1, 1), (4, 1, 1), (7, None, None), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        first, second = (sorted(map(tuple, module.score(docs, module.fit_on(docs, x)).collect())) for x in (labels, labels.orderBy("quality").repartition(3)))
        assert first == second and len(first) == 62
        assert len({s for k, _, s, _ in first if k == 8}) == 1


def test_sample_is_bounded_by_bytes(make, spark, prose):
    from voxloom.llm.labelled import sample

    docs = make([(k, prose(200, k)) for k in range(50)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    some = sample(docs, labels, "quality", 3, 1, 3000, 10_000).collect()
    assert 0 < len(some) < 20 and sum(len(r.text.encode()) for r in some) <= 10_000


def test_pipeline_stages_on_odd_rows(make, prose, spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, None), (2, ""), (3, " \n"), (None, prose(80, 3)), (5, prose(120, 5)), (5, prose(120, 5)), (6, prose(120, 5)), (7, prose(300, 7), None, None, 1)] + [(20 + k, prose(90, 20 + k)) for k in range(20)]
    for docs in (make(rows, extra=True), make([])):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "unused")
            path = f"{tmp_path}/{docs.count()}-{k}"
            out.write.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                docs = spark.read.parquet(path)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context()

    from voxloom.llm import common

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            common.scratch(Session())


def test_components_of_hubs_and_chains(spark):
    import random

    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(999, i) for i in range(200, 300)]  # the centre is the largest node
    middle = [(450, i) for i in range(400, 500)]  # neighbours on both sides, a loop among them
    bridges = [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(70)]
    edges = [*chain, *hub, *middle, *bridges, *chain[:5], (2, 1)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(parent)
    assert {r.id: r.comp for r in got} == {n: root(n) for n in parent}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
