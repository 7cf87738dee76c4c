"""Quality rules (operator 2): repetition coverage from rolling hashes.

Every document is measured whole: words, symbols, repeated lines, and for several
n-gram lengths the share of its word characters inside n-grams that occur twice or
more in the same document. All counting is vectorised over the bytes of an Arrow
batch; nothing is shuffled, so one row never meets another and skew cannot arise.

Defined results: null or blank text has no words, fails the base rule (fewer than
``min_words`` words) and is not kept. A text of any length is one unit of work.
Repeated rows each get their own result. Extra input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, span_hash, text_chunks, text_column, window_hash, word_spans

#: Largest share of word characters inside repeated n-grams, first occurrences included.
COVERAGE = {5: 0.30, 7: 0.26, 10: 0.20}
#: Largest share of word characters in lines equal to an earlier line.
LINE_COVERAGE = 0.30
#: Largest share of word characters that are symbols.
SYMBOLS = 0.10
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 50, 3, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_coverage double, ngram_coverage double"
)


def repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more with the same owner."""
    own = mix(keys ^ mix(owner.astype(np.uint64)))
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    return twice[at] == own


def covered(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more in their document."""
    out = np.zeros(len(words) + 1, np.int64)
    if len(words) >= n:
        inside = owner[: len(words) - n + 1] == owner[n - 1 :]
        at = np.flatnonzero(inside)
        at = at[repeated(window_hash(words, n)[at], owner[at])]
        np.add.at(out, at, 1)
        np.add.at(out, at + n, -1)
    return np.cumsum(out[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    start, end, first = word_spans(data, offsets)
    words = span_hash(data, start, end)
    owner = np.repeat(np.arange(n), np.diff(first))
    head = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = head[end] - head[start]
    per_doc = lambda values: np.diff(np.append(0, np.cumsum(values))[first])
    symbols = np.append(0, np.cumsum(_SYMBOL[data]))

    is_break = data == 10
    line_start = np.union1d(offsets[:-1], np.flatnonzero(is_break) + 1)
    line_start = line_start[line_start < len(data)].astype(np.int64)
    next_break = np.append(np.flatnonzero(is_break), len(data))
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(next_break[np.searchsorted(next_break, line_start)], offsets[line_doc + 1])
    w0, w1 = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    full = w1 > w0
    line_start, line_end, line_doc, w0, w1 = (x[full] for x in (line_start, line_end, line_doc, w0, w1))
    line_key = span_hash(data, line_start, line_end)
    twice = np.flatnonzero(repeated(line_key, line_doc))
    dup_lines, dup_chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(twice):
        pair = mix(line_key[twice] ^ mix(line_doc[twice].astype(np.uint64)))
        _, earliest = np.unique(pair, return_index=True)
        later = np.ones(len(twice), bool)
        later[earliest] = False
        later = twice[later]
        upto = np.append(0, np.cumsum(chars))
        np.add.at(dup_lines, line_doc[later], 1)
        np.add.at(dup_chars, line_doc[later], upto[w1[later]] - upto[w0[later]])

    repeat = covered(words, owner, REPEAT_WINDOW)
    n_words, word_chars, n_repeat = np.diff(first), per_doc(chars), per_doc(repeat)
    coverage = np.zeros(n)
    excess = np.zeros(n, bool)
    some = n_repeat[owner] > 0  # a longer repeated window holds a repeated short one
    for length, most in COVERAGE.items():
        share = np.zeros(n)
        if some.any():
            inside = covered(words[some], owner[some], length) * chars[some]
            np.add.at(share, owner[some], inside)
        share /= np.maximum(word_chars, 1)
        coverage = np.maximum(coverage, share)
        excess |= share > most
    lines = dup_chars / np.maximum(word_chars, 1)
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    kept = ~failed & ~excess & (lines <= LINE_COVERAGE) & (n_symbols <= SYMBOLS * word_chars)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": kept, "line_coverage": lines, "ngram_coverage": coverage,
    }


def measure_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_chunks(text_column(batch.column(1))):
                out = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *map(pa.array, out.values())], ["doc_id", *out])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text passes all rules, columns unchanged.

    The verdict is taken where the row is, so no join and no shuffle is needed.
    """
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(text_column(batch.column(at))):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(measure(data, offsets)["kept"]))

    return docs.mapInArrow(run, schema)
