"""Toxicity (operator 5): subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes with word ends marked) and
itself, hashed into one embedding table; a passage of ``PASSAGE`` words is the average of
its words' averages; a linear softmax over two classes reads the average. Table and
softmax are trained jointly in numpy by stochastic gradients. A misspelt word shares most
n-gram vectors with the word it comes from.

A few words make a long document toxic, so a document counts as its most toxic passage,
in training as in scoring: after rounds on whole documents, training goes on with the
highest passage of each document (and further ones of label-0 documents, in which every
passage has label 0).

The fit takes at most ``PER_CLASS`` labelled rows of either class and ``SAMPLE_BYTES`` of text
(labelled.py), whole texts, which are all that reaches the driver. In scoring, embedding
and softmax collapse to one number for each n-gram, so every row is scored where it lies.

Defined results: null and blank texts score as an empty passage (the bias); with no
labelled row of a class the score is the smoothed share of label 1; a null label is no label; a
doc_id labelled twice counts once with each different label; equal texts get equal
scores; every row, repeated or not, is scored; a text of any length is read whole; an empty table
gives no row; extra columns of any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ranges, span_hash, text_chunks, text_column, word_spans
from .labelled import fold, sample
from .quality import logistic_curve

PER_CLASS = 2000
BUCKETS, WIDTH, PASSAGE, STRIDE, GRAMS = 1 << 17, 8, 8, 4, (3, 4, 5)

#: Step of the embedding table in the first round, and the softmax's share of it.
RATE, SOFTMAX_RATE = 20.0, 0.02

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in b".,;:!?\"()[]{}<>|\t\n\r\x0b\x0c":
    _FOLD[_c] = 32


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every subword, words in text order, and the first word of each document."""
    lengths = np.diff(offsets)
    own = np.full(len(data) + len(lengths) + 1, 32, np.uint8)
    own[np.arange(len(data)) + np.repeat(np.arange(len(lengths)) + 1, lengths)] = _FOLD[data]
    start, end, first = word_spans(own, np.append(offsets[:-1] + np.arange(len(lengths)), len(own)))
    bucket = [(span_hash(own, start, end) >> np.uint64(64 - 17)).astype(np.int64)]
    word = [np.arange(len(start))]
    wide = own.astype(np.uint64)
    for n in GRAMS:
        counts = np.maximum(end - start + 3 - n, 0)  # windows of n bytes over the word with a blank at either end
        which = np.repeat(np.arange(len(start)), counts)
        at = start[which] - 1 + ranges(counts)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | wide[at + k]
        bucket.append((mix(code) >> np.uint64(64 - 17)).astype(np.int64))
        word.append(which)
    return np.concatenate(bucket), np.concatenate(word), first


def word_values(bucket: np.ndarray, word: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Mean of the table over the subwords of each of n words."""
    return np.bincount(word, table[bucket], n) / np.maximum(np.bincount(word, minlength=n), 1)


def passages(n_words: int) -> np.ndarray:
    """First words of the passages of a document; the last passage ends with the document."""
    if n_words <= PASSAGE:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n_words - PASSAGE, STRIDE), n_words - PASSAGE)


def runs(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that differ from the word before them, and the first such word of each document.

    A word said ten times over is one word of a passage, not a passage of its own.
    """
    keep = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    keep[first[:-1][first[:-1] < len(values)]] = True
    return np.flatnonzero(keep), np.append(0, np.cumsum(keep))[first]


def highest(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest passage mean of each document, and the passage's first word."""
    upto = np.append(0, np.cumsum(values))
    best, place = np.zeros(len(first) - 1), np.zeros(len(first) - 1, np.int64)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            at = a + passages(b - a)
            means = (upto[np.minimum(at + PASSAGE, b)] - upto[at]) / min(PASSAGE, b - a)
            k = int(means.argmax())
            best[d], place[d] = means[k], at[k]
    return best, place


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
        self.out = np.zeros((WIDTH, 2), np.float32)
        self.out[:, 1] = rng.normal(0, 0.3, WIDTH)
        self.out[:, 0] = -self.out[:, 1]
        self.bias = np.zeros(2, np.float32)
        self.slope, self.shift = 1.0, 0.0

    def collapsed(self) -> np.ndarray:
        return self.table @ (self.out[:, 1] - self.out[:, 0])

    def step(self, bucket: np.ndarray, size: np.ndarray, word: np.ndarray, share: np.ndarray, row: np.ndarray, label: np.ndarray, rate: float, importance: np.ndarray) -> None:
        """One joint gradient step.

        bucket: the subwords of the words used, size of them a word, one word after the other;
        word, share, row: which word is which share of which row's average.
        """
        n, m = len(label), len(size)
        of = np.repeat(np.arange(m), size)
        vectors = self.table[bucket]
        words = np.stack([np.bincount(of, vectors[:, k], m) for k in range(WIDTH)], axis=1) / size[:, None]
        mean = np.stack([np.bincount(row, words[word, k] * share, n) for k in range(WIDTH)], axis=1)
        logits = mean @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), label] -= 1
        p *= importance[:, None]
        pull = p @ self.out.T
        slow = np.float32(SOFTMAX_RATE * rate / n)
        self.out -= slow * (mean.T @ p).astype(np.float32)
        self.bias -= slow * p.sum(axis=0).astype(np.float32)
        change = np.stack([np.bincount(word, pull[row, k] * share, m) for k in range(WIDTH)], axis=1) / size[:, None]
        touched, where = np.unique(bucket, return_inverse=True)
        moved = np.stack([np.bincount(where, change[of, k], len(touched)) for k in range(WIDTH)], axis=1)
        self.table[touched] -= (rate * moved).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, rounds: tuple[int, int] = (3, 10), batch: int = 64, seed: int = 5) -> Model:
    model, rng = Model(), np.random.default_rng(seed)
    labels = (np.asarray(labels) > 0).astype(np.int64)
    if not len(labels) or labels.min() == labels.max():
        p = (labels.sum() + 1) / (len(labels) + 2)
        model.table[:] = 0
        model.shift = float(np.log(p / (1 - p)))
        return model
    vocabulary: dict[bytes, int] = {}
    own = [[vocabulary.setdefault(w, len(vocabulary)) for w in t.encode().translate(_FOLD.tobytes()).split()] for t in texts]
    first = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int64)
    token = np.fromiter((w for x in own for w in x), np.int32, int(first[-1]))
    del own
    at, first = runs(token, first)
    token = token[at]
    flat = np.frombuffer(b" ".join(vocabulary), np.uint8)
    bucket, word, _ = subwords(flat, np.array([0, len(flat)]))
    order = np.argsort(word, kind="stable")
    bucket, word, per_word = bucket[order], word[order], np.bincount(word, minlength=len(vocabulary))
    begin = np.append(0, np.cumsum(per_word))
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def bags(docs: np.ndarray, lo: np.ndarray, hi: np.ndarray, rate: float) -> None:
        keep = hi > lo
        docs, lo, hi = docs[keep], lo[keep], hi[keep]
        if not len(docs):
            return
        row = np.repeat(np.arange(len(docs)), hi - lo)
        # a word of a row once, with its share of the row's words
        pair, times = np.unique(row * len(vocabulary) + token[np.repeat(lo, hi - lo) + ranges(hi - lo)], return_counts=True)
        row, words = np.divmod(pair, len(vocabulary))
        used, which = np.unique(words, return_inverse=True)
        size = per_word[used]
        model.step(bucket[np.repeat(begin[used], size) + ranges(size)], size, which, times / (hi - lo)[row], row, labels[docs], rate, balance[docs])

    whole, single = rounds
    for turn in range(whole + single):
        rate = RATE * (1 - turn / (whole + single)) + 0.5
        if turn >= whole:
            _, place = highest(word_values(bucket, word, len(vocabulary), model.collapsed())[token], first)
        perm = rng.permutation(len(labels))
        for lo in range(0, len(perm), batch):
            docs = perm[lo : lo + batch]
            a, b = first[docs], first[docs + 1]
            if turn < whole:
                bags(docs, a, b, rate * 2)
                continue
            bags(docs, place[docs], np.minimum(place[docs] + PASSAGE, b), rate)
            calm = docs[labels[docs] == 0]
            if len(calm):
                a, b = first[calm], first[calm + 1]
                at = a + (rng.random(len(calm)) * np.maximum(b - a - PASSAGE + 1, 1)).astype(np.int64)
                bags(calm, at, np.minimum(at + PASSAGE, b), rate * 0.5)
    best, _ = highest(word_values(bucket, word, len(vocabulary), model.collapsed())[token], first)
    model.slope, model.shift = logistic_curve(best + float(model.bias[1] - model.bias[0]), np.where(labels > 0, 1.0, -1.0))
    return model


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", of: int = 5, out: int = 0, per_class: int = PER_CLASS) -> Model:
    rows = sample(docs, labels, label_col, of, out, per_class).toPandas().sort_values(["doc_id", "label"], kind="stable")
    return fit([x or "" for x in rows["text"]], rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, of: int = 5, out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    table, bias = model.collapsed().astype(np.float32), float(model.bias[1] - model.bias[0])
    slope, shift = model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for _, _, data, offsets in text_chunks(text_column(batch.column(1)), 1 << 18):
                bucket, word, first = subwords(data, offsets)
                values = word_values(bucket, word, int(first[-1]), table)
                at, first = runs(values, first)
                best, _ = highest(values[at], first)
                scores.append(1 / (1 + np.exp(-np.clip(slope * (best + bias) + shift, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), of) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
