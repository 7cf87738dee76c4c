"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import chat, fingerprints, langid, mixing, neardup, packing, quality, queries, repetition, sstable, toxicity
from voxloom.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# ---- 1 -----------------------------------------------------------------------------


def test_edits_and_likeness(spark, documents):
    out = {r.doc_id: r for r in queries.op1_document_fingerprints(spark, SF).collect()}
    assert len(out) == len(documents)
    for i, (k, text) in enumerate(documents):
        after = documents[(i + 1) % len(documents)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert out[k].n_chars == len(text)
        assert out[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    near, far = np.mean([r.near_edited for r in out.values()]), np.mean([r.near_next for r in out.values()])
    assert near > 0.7 and far < 0.6


def test_votes_by_hand(spark):
    texts = [(1, "a b c d e"), (2, "x " * 700), (3, "one two")]
    df = spark.createDataFrame(texts, "k long, text string")
    got = {r.k: (r.f1, r.f2) for r in fingerprints.fingerprints(df, ["k"], "text").collect()}
    for k, text in texts:
        w = text.split(" ")
        terms = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or [(" ".join(w), "", "")]
        rows = spark.createDataFrame(terms, "a string, b string, c string").select(F.xxhash64("a", "b", "c").alias("h")).withColumn("g", F.xxhash64("h", F.lit(1))).collect()
        for side, name in ((0, "h"), (1, "g")):
            want = sum(1 << b for b in range(64) if 2 * sum((r[name] >> b) & 1 for r in rows) > len(rows))
            assert got[k][side] & (2**64 - 1) == want


def test_radius_search(spark):
    rng = np.random.default_rng(1)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(40)]
    prints = []
    for b in base:
        prints += [b, b]
        for flips in (1, 2, 3, 4):
            x = b
            for p in rng.choice(128, flips, replace=False):
                x ^= 1 << int(p)
            prints.append(x)
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    members, pairs = fingerprints.within_radius(df, 3)
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    assert {(r.doc_id, r.rep) for r in members.collect()} == {(i, first[p]) for i, p in enumerate(prints)}
    reps = sorted(first.items(), key=lambda x: x[1])
    want = {(a, b, (p ^ q).bit_count()) for x, (p, a) in enumerate(reps) for q, b in reps[x + 1 :] if (p ^ q).bit_count() <= 3}
    got = [(r.a, r.b, r.distance) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ---- 2 -----------------------------------------------------------------------------


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup, seen = 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        return {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)}

    chars = sum(map(len, words))
    repeat = len(covered(3))
    shares = {n: sum(len(words[i]) for i in covered(n)) / max(chars, 1) for n in repetition.COVERAGE}
    seen, dup_chars = set(), 0
    for x in lines:
        dup_chars += sum(map(len, WORD.findall(x))) if x in seen else 0
        seen.add(x)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    kept = not failed and all(shares[n] <= m for n, m in repetition.COVERAGE.items()) and dup_chars <= repetition.LINE_COVERAGE * max(chars, 1) and symbols <= repetition.SYMBOLS * chars
    return len(words), chars, symbols, dup, repeat, failed, kept


def test_rules_by_brute_force(spark, documents, make, prose):
    mine = [(1000 + i, t) for i, t in enumerate(["a\na\n\na \nb", "x y z x y z x", "é　ü\x0b\x1c b", "line one\r\nline one\r\n", " \n \n", prose(60, 3) + "\n" + prose(60, 3), "q " * 200])]
    rows = documents + mine
    out = {r.doc_id: r for r in repetition.measure_rules(make(rows)).collect()}
    for k, text in rows:
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute_rules(text), (k, text[:80])


# ---- 3, 5 --------------------------------------------------------------------------


def accuracy(spark, query, column, size="/root/testdata/sf0.1"):
    scores = query(spark, size).filter("held_out").select("doc_id", "score", "predicted")
    rows = scores.join(spark.read.parquet(f"{size}/labels.parquet"), "doc_id").select("score", "predicted", F.col(column).alias("y")).collect()
    y, p = np.array([r.y for r in rows]), np.array([r.predicted for r in rows])
    return (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_quality_held_out(spark):
    right, wrong = accuracy(spark, queries.op3_quality_classifier, "quality")
    assert right > 0.9 and wrong > 0.9


def test_toxicity_held_out(spark):
    toxic, clean = accuracy(spark, queries.op5_toxicity, "toxic")
    assert toxic > 0.75 and clean > 0.95  # some 350 toxic rows to learn from, few in each language but English


def test_misspelt_words_share_subwords():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 30))
        if i % 2:
            words[int(rng.integers(30))] = rng.choice(["scoundrel", "blockhead"])
        texts.append(" ".join(words))
        labels.append(i % 2)
    model = toxicity.fit(texts, np.array(labels))
    from voxloom.llm.common import text_chunks, text_column
    import pyarrow as pa

    def score(text):
        (_, _, data, offsets), = text_chunks(text_column(pa.array([text])))
        b, w, f = toxicity.subwords(data, offsets)
        best, _ = toxicity.highest(toxicity.word_values(b, w, int(f[-1]), model.collapsed()), f)
        return model.slope * (best[0] + model.bias[1] - model.bias[0]) + model.shift

    clean = " ".join(plain[:30])
    assert score(clean + " blockheads") > 0 > score(clean)
    assert score(clean + " skoundrel") > score(clean)


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(200)]
    y = np.array([1.0 if (r < 10).sum() >= 2 else -1.0 for r in rows])
    w, b = quality.dual_descent(rows, np.ones(50), y, np.ones(200) * 5, 200)
    assert np.mean([np.sign(w[r].sum() + b) == t for r, t in zip(rows, y, strict=True)]) > 0.95


# ---- 4 -----------------------------------------------------------------------------


def fold(events):
    """The log rules, one event after the other."""
    turns = {}
    for _, kind, turn, role, text in sorted(events, key=lambda e: e[0]):
        if kind == "regenerate":
            turns = {t: v for t, v in turns.items() if t <= turn}
        if kind == "delta":
            old = turns.get(turn, (role, ""))
            turns[turn] = (role, old[1] + text)
        else:
            turns[turn] = (role, text)
    return [turns[t] for t in sorted(turns)]


def test_log_fold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(60):
        for seq in range(int(rng.integers(1, 25))):
            turn = int(rng.integers(0, 5))
            rows.append((conv, seq, str(rng.choice(["delta", "delta", "delta", "edit", "regenerate"])), turn, "user" if turn % 2 == 0 else "assistant", "".join(rng.choice(list("ab<|\\>\n"), 4))))
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.parse(chat.format_log(log)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    for conv, events in by.items():
        want = fold(events)
        assert [(t.role, t.text) for t in out[conv].turns] == want
        assert list(out[conv].loss_texts) == [t for r, t in want if r == "assistant"]


def test_loss_spans_point_into_the_rendering(spark):
    rows = chat.render(chat.messages(chat.log_of(spark.read.parquet(f"{SF}/conversations.parquet")))).collect()
    for r in rows:
        for s in r.loss:
            piece = r.formatted[s.start : s.start + s.length]
            assert r.formatted[s.start - len("assistant\n") : s.start] == "assistant\n" and "<|" not in piece
            assert r.formatted[s.start + s.length :].startswith("<|im_end|>\n")


# ---- 6, 10 -------------------------------------------------------------------------


ODD = ["", "  a  b ", "x\n\n y", "don't stop's 'S", "<|endoftext|> a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "12ab 3.5 áé É́ ÀÉ", "a\tb\x0bc d e", "İstanbul Σας ß ﬁ", "word.\nNext.\nabc", "\nabc", "a \nb", "日本 語", "a\x1cb \x85c", "a  .b ,c", "é ñ", "trailing ", " ", "\n\nA", "x\n(y) (z)\n\n#1", "it's5 'l5 5's", "\0 a\0b"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_pieces_equal_whole_texts(documents, name, kind, monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from voxloom.llm import tokens

    whole = Tokenizer.from_file(queries.tokenizer(name))
    own = Encoder(queries.tokenizer(name))
    assert own.kind == kind
    rng = random.Random(6)
    fuzz = ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "Bc", "é", "́", "3", "45", ".", ",)", "-", "'", "'s", "'re", "<|", "|>", "endoftext", "日", "\x85", "\0", "²", "×"]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts = [t for _, t in documents] + ODD + fuzz + [None]
    want = [x.ids for x in whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    ids, at = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)  # a full cache keeps what is used often, results stay
    small = Encoder(queries.tokenizer(name))
    for text, ids in zip(texts[:300] + ODD, want[:300] + want[len(documents) : len(documents) + len(ODD)], strict=True):
        assert small.ids(text).tolist() == ids


def test_other_tokenizers_take_whole_texts(tmp_path, documents):
    import json

    from tokenizers import Tokenizer

    with open(queries.tokenizer("byte_bpe_50k.json"), encoding="utf-8") as file:
        told = json.load(file)
    told["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(told, file)
    own, whole = Encoder(path), Tokenizer.from_file(path)
    assert own.kind is None
    for _, text in documents[:5]:
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_shards_read_back(spark, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    shards = sstable.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer("word_bpe_49k.json"), 1, shards=3)
    out = sorted(sstable.read_shards(shards).collect())
    start = 0
    for r, (k, text) in zip(out, documents, strict=True):
        ids = whole.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    opened = [sstable.open_shard(r.uri) for r in shards.collect()]
    known = dict(documents)
    for k in (documents[0][0], documents[77][0], documents[-1][0]):
        found = [x for s in opened for x in s.get(k)]
        assert len(found) == 1 and found[0].tolist() == whole.encode(known[k], add_special_tokens=False).ids + [1]
    assert [x for s in opened for x in s.get(10**12)] == []


def test_shard_format_with_repeated_keys(tmp_path):
    import zstandard

    keys = [None, None, -5, 0, 3, 3, 3, 9] + list(range(100, 400))
    rows = [(k, np.arange(i % 7, dtype=np.uint32) * 70_000) for i, k in enumerate(keys)]
    with open(tmp_path / "x.sst", "wb") as out:
        w = sstable.Writer(out, zstandard.ZstdCompressor(1).compress)
        w_block, sstable.BLOCK_BYTES = sstable.BLOCK_BYTES, 60
        for k, ids in rows:
            w.add(sstable.encode_key(k), ids)
        w.close()
        sstable.BLOCK_BYTES = w_block
    shard = sstable.open_shard(f"file://{tmp_path}/x.sst")
    assert [(k, x.tolist()) for k, x in shard.entries()] == [(k, x.tolist()) for k, x in rows]
    for k in dict.fromkeys(keys):
        assert [x.tolist() for x in shard.get(k)] == [x.tolist() for j, x in rows if j == k]
    assert shard.get(77) == [] and len(shard.blocks) > 5


def test_packing_is_gapless_and_tight(spark, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    out = queries.op10_best_fit_packing(spark, SF).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for k, text in documents:
        ids = whole.encode(text, add_special_tokens=False).ids + [0]
        pieces = sorted(by[k], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 2048 for r in pieces[1:])
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 2048) + 1


def test_fullest_combination_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        items = [(int(k), int(n)) for k, n in zip(rng.choice(40, 6, replace=False) + 1, rng.integers(1, 4, 6), strict=True)]
        room = int(rng.integers(1, 90))
        sums = {0}
        for k, n in items:
            sums = {s + k * c for s in sums for c in range(n + 1) if s + k * c <= room}
        got = packing.fullest(items, room)
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= dict(items)[k] for k, n in got.items())


# ---- 7 -----------------------------------------------------------------------------


def test_siblings_get_a_shortage_before_ancestors(spark):
    rows = [("a", "x", "s1", 1, 10), ("a", "y", "s2", 1, 1000), ("b", "x", "s3", 1, 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, n_rows long, tokens long")
    recipe = mixing.Recipe(budget_tokens=600, max_epochs=1, domain={"a": 1, "b": 1}, lang={"x": 1, "y": 1}, default=1)
    got = {r.source: r.given for r in mixing.leaf_budgets(leaves, recipe).collect()}
    assert got == {"s1": 10, "s2": 290, "s3": 300}
    recipe = mixing.Recipe(budget_tokens=1500, max_epochs=1, domain={"a": 10, "b": 1}, lang={"x": 1, "y": 1}, default=1)
    got = {r.source: r.given for r in mixing.leaf_budgets(leaves, recipe).collect()}
    assert got == {"s1": 10, "s2": 1000, "s3": 490}


def test_prefix_meets_the_budget(spark):
    recipe = mixing.Recipe(budget_percent=50, max_epochs=3)
    out = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), recipe)
    taken = {(r.domain, r.lang, r.source): (r.t, r.m) for r in out.groupBy("domain", "lang", "source").agg(F.sum(F.col("n_tokens") * F.col("epochs")).alias("t"), F.max("n_tokens").alias("m")).collect()}
    leaves = out.groupBy("domain", "lang", "source").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens"))
    for r in mixing.leaf_budgets(leaves, recipe).collect():
        t, m = taken[r.domain, r.lang, r.source]
        assert r.given <= t < r.given + m or t == r.given


# ---- 8 -----------------------------------------------------------------------------


def test_languages_held_out(spark):
    size = "/root/testdata/sf0.01"
    out = queries.op8_language_id(spark, size).filter("held_out").join(spark.read.parquet(f"{size}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in out if r.n_chars > 100]) > 0.97


def test_out_of_place_distance_by_hand():
    profiles = {"a": langid.top(*langid.counted(langid.grams("abab abab cd"))), "b": langid.top(*langid.counted(langid.grams("xyz xyz xy")))}
    text = "abab cd"
    own = langid.top(*langid.counted(langid.grams(text))).tolist()
    far = {}
    for name, p in profiles.items():
        p = p.tolist()
        far[name] = sum(abs(p.index(g) - i) if g in p else langid.TOP for i, g in enumerate(own)) / (langid.TOP * len(own))
    lang, _, distance = langid.Profiles(profiles).predict(text)
    assert lang == min(far, key=far.get) and abs(distance - far[lang]) < 1e-12


# ---- 9 -----------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for k, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {k: k for k in sets}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    post = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            post[g].append(k)
    pairs = {(a, b) for p in post.values() for i, a in enumerate(p) for b in p[i + 1 :]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def variants(prose, n, words=120, edits=4, seed=0):
    import random

    rng = random.Random(seed)
    base = prose(words, 77 + seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_by_brute_force(make, prose, monkeypatch):
    texts = variants(prose, 120) + variants(prose, 40, 30, 1, 5) + [prose(n, n) for n in range(3, 60)] + ["Same Few words", "same few WORDS", "a b c d e", "A B C D E"]
    rows = list(enumerate(texts, 100))
    want = brute_components(rows)
    for block in (3000, 17):  # one block a group, and many
        monkeypatch.setattr(neardup, "BLOCK_MEMBERS", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(make(rows, extra=True)).collect()}
        assert got == want


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert all(b <= a for a, b in zip(counts, counts[1:], strict=False)) and counts[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    rules = {r.doc_id for r in repetition.measure_rules(docs).filter("kept").collect()}
    assert rules == {r.doc_id for r in docs.collect()}


def test_keep_known_drops_unlearnt_and_random_text(spark):
    import random

    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    profiles = queries.learn_languages(docs)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (15, 40, 200)]
    noise.append("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem")
    noise.append("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.")
    strange = spark.createDataFrame([(-k, t, "en") for k, t in enumerate(noise, 1)], docs.schema)
    short = docs.filter("size(split(text, ' ')) >= 5").withColumn("text", F.expr("array_join(slice(split(text, ' '), 1, 5), ' ')"))
    for clean in (docs, short):
        clean = clean.filter(F.col("text").rlike("\\p{L}"))
        kept = langid.keep_known(clean.unionByName(strange), profiles)
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in clean.select("doc_id").collect())
