"""Language ID (operator 8): rank-order n-gram profiles.

A profile is the list of a language's ``TOP`` most frequent letter n-grams (1 to 3, word
ends marked), counted over every learning row. A document's own most frequent n-grams are
compared with each profile by the out-of-place distance: the sum of rank differences,
``TOP`` for an n-gram that the profile lacks.

Counts are summed in each task, within one budget of n-grams over all languages, and then by Spark
on (language, n-gram); only the finished profiles, TOP rows a language, reach the driver. A
document meets the profiles through lists of (language, rank) under each n-gram, so what a task
holds is TOP entries a language: some 50 MB at MOST_LANGUAGES.

Letters keep their own code points in an n-gram, so no two n-grams share a code.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when
nothing was learnt. Ties go to the n-gram with the smaller code and to the language first
in order. Texts are used whole, whatever their length; repeated rows count and are answered
each; a null language isn't learnt from; an empty table gives no row and no profile; extra columns
of any name are left out (keep_known keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges, relieve, stored, text_column
from .labelled import fold

TOP, UNKNOWN = 300, "und"
#: Largest out-of-place distance of a known language. On sf0.01 rows with letters are at most 0.55 away and pieces of two to
#: 40 words at most 0.63; eight or more words of random letters are at least 0.68 away, Polish, Finnish and Turkish 0.74.
FARTHEST = 0.66
#: Languages that may be learnt: their profiles (TOP n-grams each) go to the driver and to every task.
MOST_LANGUAGES = 10_000
#: N-grams of all languages that a learning task buffers, and distinct ones whose sums it holds (8 and 16 bytes each).
WAITING, SUMS = 2_000_000, 4_000_000
_letters: list[np.ndarray] = []
_EDGE = 1  # the code of a word's end


def letter_codes() -> np.ndarray:
    """Each letter's own code point, 0 for a code point that isn't a letter."""
    if not _letters:
        letter = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(letter, np.arange(0x110000, dtype=np.uint32), np.uint32(0)))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of the text as 64-bit codes, 21 bits a letter, unsorted; empty if it has no letter."""
    a = letter_codes()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    a = np.concatenate([[0], a, [0]])
    keep = a != 0
    keep[1:] |= a[:-1] != 0
    a = a[keep]
    if not len(a):
        return np.zeros(0, np.uint64)
    a = np.append(0, a).astype(np.uint64)  # runs of letters, one zero between them and at either end
    letter = a != 0
    a[~letter] = _EDGE
    shift = np.uint64(21)
    two = a[:-1] << shift | a[1:]
    three = (two[:-1] << shift | a[2:])[letter[1:-1]]
    return np.concatenate([a[letter], two, three])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


def top(keys: np.ndarray, counts: np.ndarray, most: int = TOP) -> np.ndarray:
    """The most frequent n-grams, by falling count, then by code."""
    if len(keys) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:most]


def learn(docs: DataFrame, most: int = TOP) -> dict[str, np.ndarray]:
    """Profiles from all rows with a text and a language: language → n-grams by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(lang: str) -> None:
            keys, counts = counted(np.concatenate(waiting.pop(lang)))
            if lang in totals:
                old_keys, old_counts = totals[lang]
                union = np.union1d(keys, old_keys)
                total = np.zeros(len(union), np.int64)
                total[np.searchsorted(union, keys)] += counts
                total[np.searchsorted(union, old_keys)] += old_counts
                keys, counts = union, total
            totals[lang] = (keys, counts)

        def told() -> Iterator[pa.RecordBatch]:
            for lang in list(waiting):
                settle(lang)
            for lang, (keys, counts) in totals.items():
                for lo in range(0, len(keys), 50_000):
                    part = keys[lo : lo + 50_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(counts[lo : lo + 50_000], pa.int64())], ["lang", "gram", "n"])
            totals.clear()

        held = 0
        for batch in batches:
            for text, lang in zip(text_column(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = grams(text.as_py())
                if not len(found):
                    continue
                waiting.setdefault(lang, []).append(found)
                held += len(found)
                if held > WAITING:
                    for key in list(waiting):
                        settle(key)
                    held = 0
                    if sum(len(keys) for keys, _ in totals.values()) > SUMS:
                        yield from told()
        yield from told()

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    named = docs.select(F.col("lang").cast("string").alias("lang")).filter("lang is not null").distinct()  # no text is read for it
    if (n := named.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages to learn, more than {MOST_LANGUAGES}")
    sums = stored(rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = sums.withColumn("rank", rank).filter(F.col("rank") <= most).orderBy("lang", "rank").toPandas()
    return {str(k): part["gram"].to_numpy().astype(np.uint64) for k, part in found.groupby("lang")}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], most: int = TOP):
        self.most, self.langs = most, sorted(profiles)
        own = [profiles[lang] for lang in self.langs]
        gram = np.concatenate([*own, np.zeros(0, np.uint64)])
        order = np.argsort(gram, kind="stable")
        self.lang = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])[order]
        self.rank = np.concatenate([*[np.arange(len(x), dtype=np.int32) for x in own], np.zeros(0, np.int32)])[order]
        self.every, self.start = np.unique(gram[order], return_index=True)
        self.start = np.append(self.start, len(gram))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, out-of-place distance of it from 0 to 1)."""
        found = grams(text) if text else ()
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0, 1.0
        own = top(*counted(found), self.most)
        at = np.minimum(np.searchsorted(self.every, own), len(self.every) - 1)
        met = np.flatnonzero(self.every[at] == own)
        first, count = self.start[at[met]], self.start[at[met] + 1] - self.start[at[met]]
        place = np.repeat(first, count) + ranges(count)
        gain = self.most - np.abs(self.rank[place] - np.repeat(met, count))
        far = (self.most * len(own) - np.bincount(self.lang[place], gain, len(self.langs))) / (self.most * len(own))
        k = int(far.argmin())
        if len(far) == 1:
            return self.langs[k], float(1 - far[k]), float(far[k])
        second = float(np.partition(far, 1)[1])
        return self.langs[k], second / (far[k] + second) if second else 0.5, float(far[k])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], of: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(profiles)
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], ["doc_id", "lang_pred", "score", "distance"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, distance double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), of) == out, F.lit(False)).alias("held_out"), "lang_pred", "score", "distance")


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], farthest: float = FARTHEST) -> DataFrame:
    """The rows of docs that are in one of the languages, columns unchanged; no shuffle.

    Rejected: no letter at all, or n-grams so unlike every profile that the text is in none.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(profiles)
        for batch in batches:
            relieve()
            found = [own.predict(x.as_py()) for x in batch.column(at)]
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[2] <= farthest for x in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
