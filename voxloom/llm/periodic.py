"""Periodic run detection (operator 13): heavy/light lag counting.

A run is a maximal stretch of words with smallest period q (words q apart are identical) that
is at least ``max(LEAST, 2 * q)`` words long. For every lag q up to half the text the matches
(places i where the words i and i + q are identical) are counted exactly:

* heavy words, those found often, by one autocorrelation: the power spectra of their
  indicators add up and one inverse transform gives all lags at once; the counts are whole
  numbers, so rounding makes them exact;
* light words by the differences of all pairs of their places, in blocks of bounded size.

A run with period q holds at least ``max(LEAST - q, q)`` matches at its lag, so only lags with
that many are scanned for islands (stretches of consecutive matches). Lags are taken in
ascending order, and the matches at the multiples of a found run's period, which that run
explains, are taken off: a text of one word only costs one scan. An island counts if its
first q words have no smaller period; by the theorem of Fine and Wilf such a one divides q.

Words are told apart by themselves, not by hashes. A document is the work of one row;
memory is linear in its words, time is near n^1.5 at worst.

Defined results: null, empty and blank texts have no words, no run and the hash of the empty
text; a null identifier plants nothing; repeated rows each get their row; an empty table
gives no row; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ranges

#: A run is at least so many words long.
LEAST = 12
#: Pairs of places whose differences are held at once.
PAIRS = 1 << 20
#: Words around an anchor that are compared before an island is followed to its ends.
PROBE = 8

Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> np.ndarray:
    """The place of each word's first use."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, k) for k, w in enumerate(words)), np.int64, len(words))


def lag_matches(ids: np.ndarray, top: int) -> np.ndarray:
    """For each lag up to top the number of places i with ids[i] == ids[i + lag] (0 at lag 0)."""
    n = len(ids)
    out = np.zeros(top + 1, np.int64)
    place = np.argsort(ids, kind="stable")
    edges = np.flatnonzero(np.diff(ids[place], prepend=-1))
    count = np.diff(edges, append=n)
    least = max(32, int((n * np.log2(max(n, 2))) ** 0.5))
    heavy = count > least
    if heavy.any():
        size = 1 << int(n + top).bit_length()
        power = np.zeros(size // 2 + 1)
        for a, c in zip(edges[heavy].tolist(), count[heavy].tolist(), strict=True):
            found = np.zeros(size)
            found[place[a : a + c]] = 1
            spectrum = np.fft.rfft(found)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)
    light = place[np.repeat(~heavy, count)]
    count = count[~heavy]
    later = np.repeat(count, count) - 1 - ranges(count)  # places of the same word behind each
    upto = np.append(0, np.cumsum(later))
    lo = 0
    while lo < len(light):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        first = np.repeat(np.arange(lo, hi), later[lo:hi])
        lags = light[first + 1 + ranges(later[lo:hi])] - light[first]
        out += np.bincount(lags[lags <= top], minlength=top + 1)
        lo = hi
    out[0] = 0
    return out


def _reach(same: np.ndarray) -> int:
    """How many leading values are true."""
    return len(same) if same.all() else int(same.argmin())


def island(ids: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """First and last match + 1 of the consecutive matches around the match at ``at``."""
    most, start, end, step = len(ids) - lag, at, at + 1, PROBE
    while end < most:
        part = ids[end : min(end + step, most)] == ids[end + lag : min(end + step, most) + lag]
        took = _reach(part)
        end += took
        if took < len(part):
            break
        step *= 2
    step = PROBE
    while start > 0:
        lo = max(start - step, 0)
        part = ids[lo:start] == ids[lo + lag : start + lag]
        took = _reach(part[::-1])
        start -= took
        if took < len(part):
            break
        step *= 2
    return start, end


def islands(ids: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """All stretches of at least so many consecutive matches at this lag.

    Each of them covers an anchor, a place that is one less than a multiple of ``least``,
    and on one side of its first anchor goes on for half its length.
    """
    most = len(ids) - lag
    at = np.arange(least - 1, most, least)
    at = at[ids[at] == ids[at + lag]]
    side = min(PROBE, (least - 1) // 2)
    if side and len(at):
        steps = np.arange(1, side + 1)
        right, left = np.minimum(at[:, None] + steps, most - 1), np.maximum(at[:, None] - steps, 0)
        at = at[(ids[right] == ids[right + lag]).all(1) | (ids[left] == ids[left + lag]).all(1)]
    done = 0
    for k in at.tolist():
        if k < done:
            continue
        start, done = island(ids, lag, k)
        if done - start >= least:
            yield start, done


def prime_divisors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < least:
        return []
    top = n // 2
    matches = lag_matches(ids, top)
    lags = np.arange(top + 1)
    enough = np.maximum(least - lags, lags)
    found: list[Run] = []
    for q in np.flatnonzero(matches >= np.maximum(enough, 1)).tolist():
        if q and matches[q] >= enough[q]:  # what runs of smaller periods explain has been taken off
            for start, end in islands(ids, q, int(enough[q])):
                root = ids[start : start + q]
                if any((root[p:] == root[:-p]).all() for p in (q // r for r in prime_divisors(q))):
                    continue
                length = end - start + q
                found.append((start, length, q))
                multiples = np.arange(2 * q, min(top + 1, length), q)
                matches[multiples] -= length - multiples
    return sorted(found, key=lambda run: (run[0], run[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the document, one in ten with a periodic tail that its identifier fixes."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay when of each run its first period stays."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def detect(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, the runs and the text without their repetitions, for every whole text.

    plant: give one document in ten the periodic tail of ``planted`` first.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if plant:
                    words = planted(words, doc_id)
                runs = find_runs(word_ids(words))
                if runs:
                    stays = kept_words(len(words), runs)
                    words_left = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
                else:
                    words_left = words
                out.append((doc_id, len(words), [{"start": a, "length": b, "period": c} for a, b, c in runs], b" ".join(words_left).decode()))
                size += len(out[-1][3])
                if size > 1 << 22:
                    yield _rows(out, kind)
                    out, size = [], 0
            if out:
                yield _rows(out, kind)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, RUNS)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), kind, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "runs", "collapsed"])


def report(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of the runs and of the text that is left."""
    from pyspark.sql import functions as F

    # the longest, then the first start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
