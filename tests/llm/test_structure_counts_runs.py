"""Operators 11 to 13 against searches by hand, the tokenizer libraries and brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import periodic, queries, repair, tokencount, tokens

SF = "/root/testdata/sf0.001"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


# ---- 11 ----------------------------------------------------------------------------


def cheapest(signature):
    """Search over all edit sequences by cost, then by their letters."""
    heap, best, seen = [(0, "", 0, "")], None, set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if (audit, at, state) in seen:
            continue
        seen.add((audit, at, state))
        if at == len(signature) and state in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        if audit.count("I") < len(signature) + 3:
            heapq.heappush(heap, (cost + 3, audit + "I", at, NEXT[state]))
        if at < len(signature):
            code, cut = signature[at].lower(), 3 * signature[at].isupper()
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if code != "-":
                heapq.heappush(heap, (cost + 3 + cut, audit + "R", at + 1, NEXT[state]))
                if code == NEXT[state] or code == "s" and not state:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, code))
    return best


def test_solver_finds_the_cheapest_first_audit():
    rng, solver = random.Random(3), repair.Solver()
    for _ in range(400):
        signature = "".join(rng.choice("suaSUAxX-uaua") for _ in range(rng.randint(0, 5)))
        assert solver.solve(signature) == cheapest(signature), signature


def test_solver_takes_long_signatures():
    rng = random.Random(4)
    signature = "".join(rng.choice("suaSUAx-") for _ in range(30_000))
    cost, audit = repair.Solver().solve(signature)
    assert sum(e != "I" for e in audit) == len(signature)
    at, told = 0, 0
    for e in audit:
        told += {"K": 0, "R": 3, "D": 4, "I": 3}[e]
        if e != "I":
            told += 3 * (signature[at].isupper() and e != "D")
            at += 1
    assert told == cost


def by_hand(rows):
    """Faults, cheapest audit and repaired turns of one conversation, (turn, role, text) in order."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, code, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        code += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = cheapest(code)
    out, at, shift = [], 0, 0
    for e in audit:
        here = ("user", "assistant")[(len(out) - shift) % 2]
        if e == "I":
            out.append((here, ""))
            continue
        role, text = rows[at][1:]
        at += 1
        if e == "K":
            shift += not out and role[:1] == "s"
            out.append((role, text))
        elif e == "R":
            out.append((here, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


CONVERSATIONS = {
    1: [(0, "system", "Be kind."), (1, "user", "Hi?"), (2, "assistant", "Yes.")],
    2: [(0, "user", "Hi"), (1, "user", "Hi"), (5, "assistant", " \n")],
    3: [(None, "user", "a."), (0, None, None), (0, "tool", "b!"), (0, "user", "a.")],
    4: [(7, "assistant", "Only this.")],
    5: [(2, "", "No role."), (2, "user", "Same turn?"), (2, "assistant", "cut")],
    None: [(0, "user", "Null id."), (1, "assistant", "Kept.")],
    6: [(k, ("user", "assistant")[k % 2], f"line {k}" + "." * (k % 3)) for k in range(5)],
    7: [(0, "user", ""), (1, "user", "\t")],
}


def test_repair_of_odd_rows(spark):
    rows = [(c, t, r, x, "clash") for c, told in CONVERSATIONS.items() for t, r, x in told]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, nth string").withColumn("code", F.lit("x"))
    ids = df.select("conv_id").unionByName(spark.createDataFrame([(99,)], "conv_id long"))
    got = {r.conv_id: r for r in repair.report(*repair.repair(df, ids)).collect()}
    assert set(got) == {*CONVERSATIONS, 99}
    for c, told in CONVERSATIONS.items():
        assert tuple(got[c])[1:] == by_hand(told), c
    assert tuple(got[99])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_alternate(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    solved, turns = repair.repair(repair.damage(df), df)
    told = {}
    for r in turns.orderBy("conv_id", "place").collect():
        told.setdefault(r.conv_id, []).append(r)
    assert set(told) == {r.conv_id for r in df.select("conv_id").distinct().collect()} == {r.conv_id for r in solved.collect()}
    for rows in told.values():
        if rows[0].place is None:
            assert len(rows) == 1
            continue
        initials = "".join(r.role[0] for r in rows)
        rest = initials.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and rest and [r.place for r in rows] == list(range(len(rows)))


def test_repair_query_by_hand(spark):
    rows = {}
    for c, t, r, x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        x = "" if hit == 1 else "".join(ch for ch in x if ch not in ".!?") if hit == 2 else x
        rows.setdefault(c, []).extend([(t, "user" if hit == 4 else r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == {c: by_hand(told) for c, told in rows.items()}


def test_hot_signature_and_no_rows(spark):
    n = 3000
    one = spark.range(n).select(F.col("id").alias("conv_id"), F.explode(F.expr("array(0L, 1L)")).alias("turn"))
    one = one.select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("turn"), F.lit(".")).alias("text"))
    solved, turns = repair.repair(one)
    assert solved.select("audit").distinct().collect() == [("KK",)] and solved.count() == n and turns.count() == 2 * n
    assert repair.report(*repair.repair(one.limit(0), one.limit(0))).count() == 0


# ---- 12 ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(prose):
    rng = random.Random(8)
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))
    return [
        (1, prose(300, 1)), (2, None), (3, ""), (4, " \n\t "), (5, prose(300, 1)), (6, "  " + prose(300, 1).replace(" ", " \n ") + " "), (7, cjk), (8, "a <|endoftext|> b<|startoftext|>"),
        (9, "é ́x ÉÀ"), (None, "no id here"), (5, "x" * 5000), (10, "It's 2024, isn't it? #tag $5 ｆｕｌｌ　ｗｉｄｔｈ\x0b\x0cend"), (11, "<|ENDOFTEXT|>"),
    ]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, make, texts, name):
    path = queries.tokenizer(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(model.encode(x))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    got = sorted(map(tuple, tokencount.count_tokens(make(texts, extra=True), path, limit=200).collect()), key=repr)
    want = [(k, len((x or "").encode()), count(x or ""), count(x or "") > 200) for k, x in texts]
    assert got == sorted(want, key=repr)
    assert tokencount.count_tokens(make([]), path).count() == 0


def test_only_misses_are_encoded(spark, make, texts, tmp_path):
    cache, path = f"file://{tmp_path}/counts", queries.tokenizer("word_bpe_49k.json")
    stored = lambda: sorted(map(tuple, spark.read.parquet(cache).select("digest", "n_tokens").collect()))
    tokencount.count_tokens(make(texts[:8]), path, cache).count()
    first = stored()
    assert len(first) == 4  # copies, other blanks and texts without a word are one content each
    # what the cache says is taken, so nothing known is encoded again
    spark.createDataFrame([(first[-1][0], first[-1][1], tokencount.version_of(path))], tokencount.CACHE).write.mode("append").partitionBy("version").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(make(texts), path, cache).collect() if r.doc_id != 5}
    assert got[1] == got[6] and got[2] == got[3] == got[4] == 0
    assert len(stored()) == len({*stored()}) + 1 and {*first} < {*stored()}
    # counts of another version aren't met
    other = [(d, 777, "other") for d, _ in stored()]
    spark.createDataFrame(other, tokencount.CACHE).write.mode("append").partitionBy("version").parquet(cache)
    assert {r.n_tokens for r in tokencount.count_tokens(make(texts), path, cache).collect()}.isdisjoint({777})
    wrong = [(d, 777, tokencount.version_of(path)) for d in [bytes(32)]]
    spark.createDataFrame(wrong, tokencount.CACHE).write.mode("append").partitionBy("version").parquet(cache)
    assert len({r.n_tokens for r in tokencount.count_tokens(make(texts), path, cache).collect()} & {777}) == 0


def test_many_misses_meet_by_shuffle(spark, make, texts, monkeypatch):
    path = queries.tokenizer("word_bpe_49k.json")
    want = sorted(map(tuple, tokencount.count_tokens(make(texts), path).collect()), key=repr)
    monkeypatch.setattr(tokencount, "BROADCAST_MISSES", 0)
    assert sorted(map(tuple, tokencount.count_tokens(make(texts), path).collect()), key=repr) == want


def test_piece_cache_is_bounded_by_bytes(monkeypatch):
    rng = random.Random(9)
    paragraphs = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(rng.randint(3, 1200))) for _ in range(300)]
    cyrillic = [" ".join("".join(chr(0x430 + rng.randrange(32)) for _ in range(rng.randint(1, 60))) for _ in range(400)) for _ in range(40)]
    whole = ["".join(rng.choice(["ab", "12", ",,", "é", "日本"]) for _ in range(600_000))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = queries.tokenizer(name)
        encoder = tokens.Encoder(path)
        monkeypatch.setattr(tokens, "CACHE_IDS", 40_000)
        for told in (paragraphs, cyrillic, whole, paragraphs[:50]):
            for text in told:
                ids = encoder.ids(text)
                assert encoder.pieces.filled <= 40_000 + tokens.TOGETHER
                if len(text) < 10_000:
                    assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(whole[0]).tolist() == encoder.tokenizer.encode(whole[0], add_special_tokens=False).ids
        assert int(encoder.pieces.size[: encoder.pieces.n].max()) <= tokens.LONG_PIECE


# ---- 13 ----------------------------------------------------------------------------


def runs_by_hand(w, least=12):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 20]), rng.randint(0, 140)
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)] + w[: rng.randint(0, 20)]
    return w


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = random_words(rng)
        assert periodic.find_runs(periodic.word_ids([b"%d" % x for x in w])) == runs_by_hand(w), w


def test_lag_counts_of_heavy_and_light_words(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(periodic, "PAIRS", 500)
    for n in (1, 13, 300, 2500):
        w = np.array([rng.choice([0, 0, 0, 1, 2, rng.randrange(50)]) for _ in range(n)])
        m = periodic.lag_matches(periodic.word_ids([b"%d" % x for x in w]), n // 2)
        assert m.tolist() == [0] + [int((w[:-q] == w[q:]).sum()) for q in range(1, n // 2 + 1)]


def test_one_word_is_one_scan():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_runs_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        if len((text or "").split()) > 1500:
            continue
        w = [x.decode() for x in (text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = runs_by_hand(w), got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        left = [x for i, x in enumerate(w) if not any(a + c <= i < a + b for a, b, c in runs)]
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(left).encode()).hexdigest()


def test_runs_of_odd_rows(make):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a " * 30), (4, "x\x1cy " * 20), (4, "x\x1cy " * 20), (5, "é b " * 7)]
    out = periodic.report(periodic.detect(make(rows, extra=True))).collect()
    told = sorted([(r.doc_id, r.n_runs, r.length, r.period) for r in out], key=repr)
    assert told == sorted([(1, 0, None, None), (2, 0, None, None), (3, 0, None, None), (None, 1, 30, 1), (4, 1, 20, 1), (4, 1, 20, 1), (5, 1, 14, 2)], key=repr)
    assert next(r for r in out if r.doc_id == 1).collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic.report(periodic.detect(make([]))).count() == 0
